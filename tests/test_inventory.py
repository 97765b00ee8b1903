import glob
from pathlib import Path

import pytest
from data import rows
from pyspark.sql import functions as F

from tierlake.functions.labels import label_filter, saved_query, template_path
from tierlake.functions.paths import glob_regex, normalise_path
from tierlake.operators import inventory as inv, tags
from tierlake.operators.config import config_violations, effective_config
from tierlake.session import scratch_path
from tierlake.sources import demo, tagstore

LABELS = [None, {}, {"zone": "north"}, {"zone": "south", "os": "bsd"}, {"os": "linux"}, {"zone": "", "os": "bsd"}]
# Which of the label sets each filter keeps.
KEPT = {
    "": [0, 1, 2, 3, 4, 5],
    "label:zone": [2, 3, 5],
    "label:os = bsd": [3, 5],
    "label:os = BSD": [],
    "label:os in [plan9, bsd]": [3, 5],
    "label:zone in [north]": [2],
    "label:zone AND label:os": [3, 5],
    "label:zone = south OR label:os = linux": [3, 4],
    # AND splits first, so this reads (os = linux OR zone) AND os.
    "label:os = linux OR label:zone AND label:os": [3, 4, 5],
    "label:zone AND label:os AND label:cpu": [],
    "zone is north": [],
}


def test_label_filter(spark):
    df = spark.createDataFrame(list(enumerate(LABELS)), "i int, labels map<string,string>")
    for text, want in KEPT.items():
        assert sorted(r["i"] for r in df.where(label_filter(text)).collect()) == want, text


def test_saved_query_selects_all_when_it_is_no_label_test(spark):
    df = spark.createDataFrame([({"a": "1"},), ({"a": "2"},), (None,)], "labels map<string,string>")
    counts = [df.where(saved_query(q)).count() for q in ("label:a = 1", "label:a in [1, 2]", "label:a", "whatever")]
    assert counts == [1, 2, 3, 3]


@pytest.mark.parametrize(
    "template,labels,want",
    [
        ("/z/{label:zone}/{name}", {"zone": "north"}, "/z/north/gw7"),
        ("/{label:os}-{label:zone}/{name}", {"zone": "n", "os": "bsd"}, "/bsd-n/gw7"),
        ("/z/{label:zone}/{name}", {"os": "bsd"}, None),
        ("/z/{label:zone}", {"zone": ""}, None),
        ("/fixed", None, "/fixed"),
    ],
)
def test_target_template(spark, template, labels, want):
    df = spark.createDataFrame([("gw7", labels)], "name string, labels map<string,string>")
    assert df.select(template_path(template, F.col("name"), F.col("labels"))).first()[0] == want


@pytest.mark.parametrize("labels,want", [({"zone": "north"}, "/z/north/gw7/temp"), ({}, None)])
def test_poller_template(spark, labels, want):
    df = spark.createDataFrame([("temp", "gw7", labels)], "name string, target string, labels map<string,string>")
    path = template_path("/z/{target:zone}/{target}/{name}", F.col("name"), F.col("labels"), F.col("target"))
    label_in_poller = template_path("/x/{label:zone}/{name}", F.col("name"), F.col("labels"), F.col("target"))
    assert tuple(df.select(path, label_in_poller).first()) == (want, None)


def test_globs(spark):
    hosts = ["10.0.0.1", "10.0.0.12", "db-1", "db-2", "a/b", "a.b", "d[b", "10a0a0a1"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    want = {
        "10.0.0.*": ["10.0.0.1", "10.0.0.12"], "10.0.0.?": ["10.0.0.1"], "db-[2-9]*": ["db-2"], "a*b": ["a.b"],
        "a.b": ["a.b"], "db-1": ["db-1"], "db-[12]": [], "*": [h for h in hosts if "/" not in h], "db-[^1]*": ["db-2"],
    }
    for pattern, hits in want.items():
        assert sorted(r[0] for r in inv.host_glob(df, pattern).collect()) == sorted(hits), pattern
    assert glob_regex("a+b(c)*") == "^a\\+b\\(c\\)[^/]*$"


def test_glob_escapes(spark):
    texts = ["a*b", "axb", "a]b", "a-b", "a\\b", "ab"]
    df = spark.createDataFrame([(t,) for t in texts], "host string")
    want = {
        "a\\*?": ["a*b"], "a[*x]b*": ["a*b", "axb"], "a[\\]]b*": ["a]b"], "a[]]b*": ["a]b"], "a[x*": [], "a*\\": [],
        "a[^x*-]b*": ["a\\b", "a]b"], "a\\\\b*": ["a\\b"], "a[+--]b*": ["a-b"],
    }
    for pattern, hits in want.items():
        assert sorted(r[0] for r in inv.host_glob(df, pattern).collect()) == sorted(hits), pattern


def test_paths(spark):
    cases = {"//": "/", "x/y/": "/x/y", "/x///y//z": "/x/y/z", "q": "/q", "/q r/": "/q r", "": "/"}
    df = spark.createDataFrame(list(cases.items()), "path string, want string")
    assert df.where(normalise_path(F.col("path")) != F.col("want")).count() == 0


def inventory(spark):
    numbers = "interval_ms int, timeout_ms int, retries int, buffer_size int"
    texts = "community string, security_name string, security_level string, auth_protocol string, auth_password string, " \
        "priv_protocol string, priv_password string"
    n = spark.createDataFrame([("prod", ("public", *[None] * 6, None, 3000, None, None))], f"name string, defaults struct<{texts}, {numbers}>")
    t = spark.createDataFrame(
        [("prod", "router-01", "10.0.0.1", ("", *[None] * 6, 2000, None, None, 0))],
        f"namespace string, name string, host string, defaults struct<{texts}, {numbers}>",
    )
    p = spark.createDataFrame(
        [
            ("prod", "router-01", "cpu", '{"oid": "1.3"}', (None, 1000, None, None)),
            ("prod", "router-01", "bad name", "{}", (0, None, 0, None)),
        ],
        f"namespace string, target string, name string, protocol_config string, polling struct<{numbers}>",
    )
    return n, t, p


def test_inheritance(spark):
    server = {"timeout_ms": 5000, "retries": 2, "interval_ms": 1000, "buffer_size": 3600}
    config = effective_config(*inventory(spark), server)
    row = config.where("poller = 'cpu'").first()
    assert (row["timeout_ms"], row["retries"], row["interval_ms"], row["buffer_size"]) == (1000, 2, 2000, 3600)
    sources = [row[c + "_source"] for c in ("timeout_ms", "retries", "interval_ms", "buffer_size", "community")]
    assert sources == ["poller:cpu", "server", "target:router-01", "server", "namespace:prod"]
    zero = config.where("poller = 'bad name'").first()
    assert (zero["interval_ms"], zero["scheduled_interval_ms"], zero["retries"], zero["retries_source"]) == (
        2000, 0, 0, "poller:bad name",
    )
    bare = effective_config(*inventory(spark)).where("poller = 'cpu'").first()
    assert (bare["retries"], bare["retries_source"]) == (2, "default")
    bad = config_violations(config).collect()
    assert [(r["poller"], r["reasons"]) for r in bad] == [("bad name", ["OID is required", "invalid poller name"])]


def tagged(spark):
    return spark.createDataFrame(
        [
            ("n", "r1", ["type/network/router", "site/dc1"]),
            ("n", "s1", ["type/network/switch", "site/dc1"]),
            ("n", "net", ["type/network"]),
            ("n", "srv", ["type/networking", "site/dc2/rack"]),
            ("n", "bare", None),
        ],
        "namespace string, name string, tags array<string>",
    )


def test_stored_tags_equal_the_scan_and_read_asked_tags_only(spark):
    df = tagged(spark)
    # A repeated row, many blocks of targets, and tags that most, few and none of them carry.
    many = spark.range(70_000, numPartitions=2).select(
        F.lit("m").alias("namespace"),
        F.col("id").cast("string").alias("name"),
        F.expr("array('all/x', concat('mod/', id % 7), if(id % 30000 = 5, 'rare', 'site/dc1'), '', '/top', 'a//b')").alias("tags"),
    )
    df = df.unionByName(df.where("name = 'r1'")).unionByName(many)
    root = scratch_path(spark, "test-tags")
    tagstore.write_tag_index(df, root)
    asked = [["rare"], ["type/network"], ["mod/3", "rare"], ["mod/3", "site/dc1", "all"], ["nothing"], ["nothing", "all"], [""], ["a/"], [],
             ["rare", "rare"]]
    for wanted in asked:
        for stored, scanned in ((tagstore.with_all_tags, tags.tag_query_and), (tagstore.with_any_tag, tags.tag_query_or)):
            found = stored(spark, root, wanted)
            assert found.exceptAll(scanned(df, wanted)).count() == 0 == scanned(df, wanted).exceptAll(found).count(), wanted
    want = tags.tag_query_and(df, ["rare", "mod/3"]).count()
    rare = spark.read.parquet(f"{root}/postings").where("tag in ('rare', 'mod/3')").select("folder").distinct().collect()
    kept = {r["folder"] for r in rare}
    for file in glob.glob(f"{root}/postings/*/*.parquet"):
        if int(Path(file).parent.name.partition("=")[2]) not in kept:
            Path(file).write_bytes(b"broken")
            Path(file).with_name(f".{Path(file).name}.crc").unlink(missing_ok=True)
    found = tagstore.with_all_tags(spark, root, ["rare", "mod/3"])
    assert found.count() == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(tag, [mod/3,rare])" in plan


def test_stored_tags_of_no_targets(spark):
    root = scratch_path(spark, "test-no-tags")
    tagstore.write_tag_index(tagged(spark).where("false"), root)
    assert tagstore.with_tag(spark, root, "type").count() == 0


def test_tags(spark):
    df = tagged(spark)

    def names(out):
        return sorted(r["name"] for r in out.collect())

    assert names(tags.tag_query(df, "type/network")) == ["net", "r1", "s1"]
    assert names(tags.tag_query_and(df, ["type/network", "site/dc1"])) == ["r1", "s1"]
    assert names(tags.tag_query_and(df, [])) == [] == names(tags.tag_query_or(df, []))
    assert names(tags.tag_query_or(df, ["site/dc2", "type/network/router"])) == ["r1", "srv"]
    assert dict(tags.tag_counts(df).collect())["type"] == 4
    children = rows(tags.tag_children(df, "type/network"), "kind", "name")
    assert children == [("dir", "router"), ("dir", "switch"), ("target", "net")]
    assert [c for c in rows(tags.tag_children(df), "kind", "name")] == [("dir", "site"), ("dir", "type")]
    assert rows(tags.has_tag(df, "site/dc1"), "name", "has_tag") == [
        ("bare", False), ("net", False), ("r1", True), ("s1", True), ("srv", False),
    ]


def test_update_tags(spark):
    updates = spark.createDataFrame(
        [
            ("n", "r1", ["b", ""], ["site/dc1"], []),
            ("n", "s1", ["x"], [], ["z", "a"]),
            ("n", "bare", ["new"], None, None),
        ],
        "namespace string, name string, add array<string>, remove array<string>, set array<string>",
    )
    got = {r["name"]: r["tags"] for r in tags.update_tags(tagged(spark), updates).collect()}
    assert got["r1"] == ["b", "type/network/router"]
    assert got["s1"] == ["a", "z"] and got["bare"] == ["new"] and got["net"] == ["type/network"]


def test_pages(spark, sf):
    targets = demo.targets(spark, sf)
    seen, cursor = [], None
    while True:
        page = inv.page_targets(targets, "ASIA", cursor, 7).collect()
        seen += [r["name"] for r in page]
        cursor = page[0]["next_cursor"]
        if cursor is None:
            break
        assert cursor == page[-1]["name"] and len(page) == 7
    assert seen == [r["name"] for r in inv.list_targets(targets, "ASIA").collect()]


def test_a_page_is_as_long_as_wished(spark):
    df = spark.range(1500).select(F.lit("n").alias("namespace"), F.format_string("t%05d", "id").alias("name"))
    page = inv.page_targets(df.withColumn("labels", F.lit(None).cast("map<string,string>")), "n", None, 1200)
    got = page.collect()
    assert len(got) == 1200 and got[0]["next_cursor"] == "t01199"


def test_two_updates_of_one_target(spark):
    df = spark.createDataFrame([("n", "a", {"x": "1"}, ["t"]), ("n", "b", None, None)], "namespace string, name string, labels map<string,string>, tags array<string>")
    updates = spark.createDataFrame(
        [("n", "a", {"x": "2"}, ["u"], None, None, 1), ("n", "a", {"x": "3"}, ["v"], None, None, 2)],
        "namespace string, name string, labels map<string,string>, add array<string>, remove array<string>, set array<string>, at int",
    )
    got = {r["name"]: r["labels"] for r in inv.set_labels(df, updates, order="at").collect()}
    assert got == {"a": {"x": "3"}, "b": None}
    assert [r["tags"] for r in tags.update_tags(df, updates, order="at").orderBy("name").collect()] == [["t", "v"], None]
    for run in (inv.set_labels, tags.update_tags):
        with pytest.raises(Exception, match="several updates"):
            run(df, updates).collect()


def test_set_labels(spark):
    df = spark.createDataFrame(
        [("n", "a", {"x": "1", "y": "2"}), ("n", "b", None), ("n", "c", {"x": "1"})],
        "namespace string, name string, labels map<string,string>",
    )
    updates = spark.createDataFrame([("n", "a", {"y": "3"}), ("n", "b", {"z": "4"})], df.schema)
    replaced = {r["name"]: r["labels"] for r in inv.set_labels(df, updates).collect()}
    merged = {r["name"]: r["labels"] for r in inv.set_labels(df, updates, merge=True).collect()}
    assert replaced == {"a": {"y": "3"}, "b": {"z": "4"}, "c": {"x": "1"}}
    assert merged == {"a": {"x": "1", "y": "3"}, "b": {"z": "4"}, "c": {"x": "1"}}


def test_filters_are_a_true_conjunction(spark):
    df = spark.createDataFrame(
        [("n", "a", "up", "snmp", "10.0.0.1", ["t/x"]), ("n", "b", "up", "ping", "10.0.0.2", ["t/y"])],
        "namespace string, name string, state string, protocol string, host string, tags array<string>",
    )
    assert inv.filter_targets(df).count() == 2
    assert inv.filter_targets(df, state="up", tags=["t"]).count() == 2
    # A filter that matches nothing empties the result.
    assert inv.filter_targets(df, state="down", protocol="snmp").count() == 0
    assert inv.filter_targets(df, protocol="snmp", host="10.0.0.?").count() == 1
    assert dict(inv.index_counts(df).collect()) == {
        "states": 1, "protocols": 2, "hosts": 2, "state_up": 2, "protocol_snmp": 1, "protocol_ping": 1,
    }
