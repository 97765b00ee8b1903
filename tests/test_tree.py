import pytest
from data import rows

from tierlake.operators import live, tree, views
from tierlake.operators.views import SmartFolder, View

NODES = [
    ("n", "/geo", "directory", None),
    ("n", "/geo/eu", "directory", None),
    ("n", "/geo/eu_x", "directory", None),
    ("n", "/geo/eu/r1", "link_target", "target:r1"),
    ("n", "/geo/eu/cpu", "link_poller", "poller:r1/cpu"),
    ("n", "/geo/eu/lost", "link_target", "target:gone"),
    ("n", "/geo/eu/bad", "link_target", "nonsense"),
    ("m", "/geo/eu/r1", "link_target", "target:r1"),
]
VIEWS = [
    View("site", "/geo/{label:site}/{name}", "target"),
    View("flat", "/{name}", "target", filter_expr="label:flat", priority=60),
    View("off", "/off/{name}", "target", enabled=False),
    View("elsewhere", "/m/{name}", "target", namespace="m"),
]
FOLDERS = [SmartFolder("/geo/eu", "label:site = eu"), SmartFolder("/smart", "label:site in [eu, us]")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "namespace string, path string, node_type string, link_ref string")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame(
        [("n", "r1", {"site": "eu"}), ("n", "r2", {"site": "us", "flat": "1"}), ("n", "r3", None)],
        "namespace string, name string, labels map<string,string>",
    )


def pollers(spark):
    return spark.createDataFrame([("n", "r1", "cpu"), ("n", "r1", "mem")], "namespace string, target string, name string")


def test_children_and_subtree_are_literal(nodes):
    assert [r["path"] for r in tree.tree_children(nodes, "n", "/geo").collect()] == ["/geo/eu", "/geo/eu_x"]
    assert [r["path"] for r in tree.tree_children(nodes, "n", "/").collect()] == ["/geo"]
    below = [p for p, in rows(tree.tree_subtree(nodes, "n", "/geo/eu"), "path")]
    assert below == ["/geo/eu", "/geo/eu/bad", "/geo/eu/cpu", "/geo/eu/lost", "/geo/eu/r1"]
    assert rows(tree.tree_ancestors(nodes), "namespace", "path") == [
        ("m", "/geo"), ("m", "/geo/eu"), ("n", "/geo"), ("n", "/geo/eu"),
    ]


def test_browse_priorities(spark, nodes, targets):
    got = {r["name"]: r for r in tree.tree_browse(nodes, targets, VIEWS, FOLDERS, "n", "/geo/eu").collect()}
    # The static link, the view link and the smart link of r1 share a name: static wins.
    assert got["r1"]["source"] == "static" and got["r1"]["priority"] == 100
    root = {r["name"]: (r["type"], r["source"]) for r in tree.tree_browse(nodes, targets, VIEWS, FOLDERS, "n", "/").collect()}
    assert root == {"geo": ("directory", "static"), "r2": ("link_target", "view")}
    names = [r["name"] for r in tree.tree_browse(nodes, targets, VIEWS, FOLDERS, "n", "geo").collect()]
    assert names == ["eu", "eu_x", "us"]


def test_every_directory_at_once(spark, nodes, targets):
    whole = tree.tree_browse_all(nodes, targets, VIEWS, FOLDERS).where("namespace = 'n'")
    columns = ["name", "path", "type", "link_ref", "priority", "source"]
    for path in ("/", "/geo", "/geo/eu", "/geo/us", "/smart", "/off"):
        one = tree.tree_browse(nodes, targets, VIEWS, FOLDERS, "n", path)
        assert rows(one, *columns) == rows(whole.where(f"parent = '{path}'"), *columns), path


def test_links(spark, nodes, targets):
    lost = tree.dangling_links(nodes.where("namespace = 'n'"), targets, pollers(spark))
    assert rows(lost, "path") == [("/geo/eu/bad",), ("/geo/eu/lost",)]
    assert rows(tree.links_to(nodes, "n", "r1"), "path") == [("/geo/eu/r1",)]
    assert rows(tree.links_to(nodes, "n", "r1", "cpu"), "path") == [("/geo/eu/cpu",)]
    assert rows(tree.links_to(nodes, "n", "r1", with_pollers=True), "path") == [("/geo/eu/cpu",), ("/geo/eu/r1",)]


def test_path_resolve(spark, nodes):
    asked = ["/targets/r1", "targets/r1/cpu/", "/targets/r1/cpu/x", "/tree/geo/eu", "/tree/geo/eu/cpu", "/tree/geo//eu/r1", "/tree/no", "/"]
    df = spark.createDataFrame([("n", p) for p in asked], "namespace string, path string")
    got = {r["path"]: (r["type"], r["target"], r["poller"]) for r in tree.path_resolve(df, nodes).collect()}
    assert [got[p] for p in asked] == [
        ("target", "r1", None), ("poller", "r1", "cpu"), (None, None, None), ("directory", None, None),
        ("poller", "r1", "cpu"), ("target", "r1", None), (None, None, None), (None, None, None),
    ]


def test_subscriptions(spark, nodes):
    requests = spark.createDataFrame(
        [
            ("s", "n", "r1", None, None), ("s", "n", "r1", "cpu", None), ("s", "n", "r1", "fan", None), ("s", "n", "r9", "", None),
            ("s", "n", None, None, "/targets/r1/mem"), ("s", "n", None, None, "/tree/geo/eu"),
        ],
        "subscriber string, namespace string, target string, poller string, path string",
    )
    got = rows(live.subscriptions_resolve(requests, pollers(spark), nodes), "request", "poller", "valid")
    assert got == [
        ("/targets/r1/mem", "mem", True), ("/tree/geo/eu", None, False), ("r1/*", "cpu", True), ("r1/*", "mem", True),
        ("r1/cpu", "cpu", True), ("r1/fan", "fan", False), ("r9/*", None, False),
    ]


def test_fanout_delivers_once(spark):
    subs = spark.createDataFrame(
        [("a", "n", "r1", None), ("a", "n", "r1", "cpu"), ("a", "n", "r1", ""), ("b", "n", "r1", "mem")],
        "subscriber string, namespace string, target string, poller string",
    )
    found = spark.createDataFrame([("n", "r1", "cpu", 1), ("n", "r1", "mem", 2), ("n", "r2", "cpu", 3)], "namespace string, target string, poller string, seq int")
    assert rows(live.fanout(found, subs), "subscriber", "seq") == [("a", 1), ("a", 2), ("b", 2)]


def test_groups_and_status_folders(spark, targets):
    assert rows(views.view_group_counts(targets, "site", "flat"), "level", "first", "second", "targets") == [
        (1, "eu", None, 1), (1, "us", None, 1), (2, "us", "1", 1),
    ]
    info = spark.createDataFrame(
        [("n", "t", "a", 1, 10, "", None, "enabled"), ("n", "t", "b", 2, 10, "x", 950, "enabled"), ("n", "t", "c", 0, 0, "", None, "disabled")],
        "namespace string, target string, poller string, polls_failed bigint, polls_total bigint, last_error string, last_poll_at bigint, admin_state string",
    )
    got = rows(views.smart_folder_status(info, 1_000, recent_ms=100), "poller", "folder")
    assert got == [("b", "high-error-rate"), ("b", "recent-errors"), ("c", "disabled")]


def test_browse_all_sorts_only_shuffled_pieces(spark, nodes, targets):
    """What has to sort stands above the shuffle by name, not in the tasks that read the inputs."""
    plan = tree.tree_browse_all(nodes, targets, VIEWS, FOLDERS)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Exchange hashpartitioning(namespace")
    assert "SortAggregate" in above and below and "SortAggregate" not in below
