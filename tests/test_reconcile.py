import random

import pytest
from data import rows
from pyspark.sql import functions as F

from tierlake.operators import reconcile as rec

KEYS = ["namespace", "name"]
SCHEMA = "namespace string, name string, description string, labels map<string,string>, source string, version int"
FIELDS = ["namespace", "name", "description", "labels"]


def side(spark, entries):
    return rec.content_hash(spark.createDataFrame(entries, SCHEMA), FIELDS)


def both(spark):
    declared = [("n", f"t{i}", "new" if i == 2 else "x", {"b": "1", "a": "2"}, "yaml", 1) for i in range(6)]
    stored = [("n", f"t{i}", "x", {"a": "2", "b": "1"}, "api" if i == 5 else "yaml", 4) for i in range(2, 6)]
    return side(spark, declared), side(spark, stored + [("n", "old", "x", {}, "yaml", 2)])


def test_hash(spark):
    cases = [
        ("n", "t", "ab", {"x": "1", "y": "2"}), ("n", "t", "ab", {"y": "2", "x": "1"}), ("n", "ta", "b", {"x": "1", "y": "2"}),
        ("n", "t", None, {"x": "1"}), ("n", "t", "", {"x": "1"}), ("n", "t", "a", {"x": "1=2"}), ("n", "t", "a", {"x=1": "2"}),
        ("n", "t", "a", None), ("n", "t", "a", {}),
    ]
    df = rec.content_hash(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, namespace string, name string, description string, labels map<string,string>"), FIELDS)
    h = {r["i"]: r["content_hash"] for r in df.collect()}
    assert h[0] == h[1] and h[7] == h[8]
    assert len(set(h.values())) == len(cases) - 2


def actions(diff):
    return {r["name"]: (r["action"], r["reason"]) for r in diff.collect()}


def test_policies(spark):
    declared, stored = both(spark)
    diffs = {p: actions(rec.inventory_diff(declared, stored, KEYS, p)) for p in rec.POLICIES}
    assert diffs["create-only"]["t2"] == ("skip", "policy: create-only")
    assert diffs["full-sync"]["old"] == ("delete", "orphan (not in yaml)")
    assert diffs["source-aware"]["t2"] == ("update", "content changed")
    assert diffs["ignore"]["t0"] == ("skip", "policy: ignore")
    assert diffs["merge"]["t2"][0] == "update" and "old" not in diffs["merge"]
    for policy, diff in diffs.items():
        assert ("old" in diff) == (policy == "full-sync")
    with pytest.raises(ValueError):
        rec.inventory_diff(declared, stored, KEYS, "sometimes")


def test_source_aware_keeps_what_the_api_made(spark):
    declared, stored = both(spark)
    foreign = stored.withColumn("source", F.lit("api"))
    assert actions(rec.inventory_diff(declared, foreign, KEYS, "source-aware"))["t2"] == ("skip", "policy: source-aware (source=api)")


def test_counts(spark):
    declared, stored = both(spark)
    summary = rec.diff_summary(rec.inventory_diff(declared, stored, KEYS, "full-sync")).first()
    assert (summary["create"], summary["update"], summary["delete"], summary["skip"]) == (2, 1, 1, 3)
    assert summary["total"] == 7 and summary["has_changes"] is True


@pytest.mark.parametrize("policy", rec.POLICIES)
def test_nothing_left_to_do_after_apply(spark, policy):
    declared, stored = both(spark)
    diff = rec.inventory_diff(declared, stored, KEYS, policy)
    new = rec.inventory_apply(diff, declared, stored, KEYS)
    again = rec.inventory_diff(declared, new, KEYS, policy)
    assert rec.diff_actionable(again).count() == 0
    got = {r["name"]: (r["source"], r["version"]) for r in new.collect()}
    if policy == "full-sync":
        assert got == {"t0": ("yaml", 1), "t1": ("yaml", 1), "t2": ("yaml", 5), "t3": ("yaml", 4), "t4": ("yaml", 4), "t5": ("api", 4)}
        assert rec.sync_unchanged({"t": declared}, {"t": new}).first()["unchanged"] is True
    if policy == "ignore":
        assert rows(new, *KEYS) == rows(stored, *KEYS)
        assert rec.sync_unchanged({"t": declared}, {"t": new}).first()["unchanged"] is False


def test_policy_route(spark):
    rules = spark.createDataFrame([("a", "full-sync"), ("a.b.c", "ignore")], "path string, policy string")
    paths = spark.createDataFrame([(p,) for p in ("a.b.c", "a.b.c.d", "a.b", "a", "ab.c", "z")], "path string")
    got = dict(rec.policy_route(paths, rules, "merge").collect())
    assert got == {"a.b.c": "ignore", "a.b.c.d": "ignore", "a.b": "full-sync", "a": "full-sync", "ab.c": "merge", "z": "merge"}


def test_policy_route_against_every_rule(spark):
    rng = random.Random(8)
    names = [".".join(rng.choice(["a", "ab", "b-", "c", ""]) for _ in range(rng.randint(1, 6))) for _ in range(600)]
    rules = {n: f"p{i}" for i, n in enumerate(rng.sample(sorted(set(names)), 40))}
    rules |= {"a": "root"}
    asked = spark.createDataFrame([(n,) for n in [*names, None, "é.a", "a.a.a.a.a.a.a.a"]], "path string").repartition(5)
    given = spark.createDataFrame([*rules.items(), (None, "x"), ("a.c", None), ("a", "r")], "path string, policy string")
    got = {r["path"]: r["policy"] for r in rec.policy_route(asked, given, "none").collect()}
    assert set(got) == {*names, "é.a", "a.a.a.a.a.a.a.a"}
    for name, policy in got.items():
        above = [r for r in rules if name == r or name.startswith(r + ".")]
        assert policy == (rules[max(above, key=len)] if above else "none"), name
    assert {r["policy"] for r in rec.policy_route(asked, given.where("false")).collect()} == {"create-only"}
    assert rec.policy_route(asked.where("false"), given).count() == 0


def test_orphans_and_changes(spark):
    names = spark.createDataFrame([("n",)], "name string")
    targets = spark.createDataFrame([("n", "t"), ("gone", "t")], "namespace string, name string")
    pollers = spark.createDataFrame([("n", "t", "p"), ("n", "u", "p")], "namespace string, target string, name string")
    assert rows(rec.orphan_entities(names, targets, pollers), "entity", "namespace", "target", "name") == [
        ("poller", "n", "u", "p"), ("target", "gone", "", "t"),
    ]
    declared, stored = both(spark)
    got = {r["name"]: (r["event"], r["changed_fields"]) for r in rec.entity_changes(stored, declared, KEYS, ["description", "labels"]).collect()}
    assert got == {"t0": ("create", []), "t1": ("create", []), "t2": ("update", ["description"]), "old": ("delete", [])}


def test_apply_keeps_columns_that_only_the_store_has(spark):
    declared, stored = both(spark)
    stored = stored.withColumn("health", F.lit("up"))
    diff = rec.inventory_diff(declared, stored, KEYS, "full-sync")
    new = rec.inventory_apply(diff, declared, stored, KEYS)
    assert new.columns == stored.columns
    created = {r["name"] for r in diff.where("action = 'create'").collect()}
    assert created and {r["name"]: r["health"] for r in new.collect()} == {
        r["name"]: None if r["name"] in created else "up" for r in new.collect()
    }
