import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from tierlake.llm import catalog, manifest
from llm_tools import ASCII_LOWER, COLUMNS, ODD


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root of some nodes, and for each of them what stands left and right of its way up."""
    ways, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        upper, owned = [], []
        for b in range(0, len(nodes), 8):
            run = nodes[b : b + 8]
            for j in range(len(run)):
                for i in owners[b + j]:
                    ways[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            upper.append(digest("".join(run)))
            owned.append(sum(owners[b : b + 8], []))
        nodes, owners = upper, owned
    return nodes[0], ways


def brute(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = []
    for g in names:
        found = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        inner.append((found, *climb([leaf(r) for r in found])))
    root, tops = climb([s for _, s, _ in inner])
    out = []
    for (found, subroot, ways), top in zip(inner, tops):
        for r, way in zip(found, ways):
            way, now = way + top, leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                now = leaf((*r[:4], r[4] and r[4].translate(ASCII_LOWER)))
            for left, right in way:
                now = digest(left + now + right)
            out.append((r[0], leaf(r), subroot, root, digest("".join(a + b for a, b in way)), now, now == root))
    return sorted(out, key=repr)


def verify(df, rows):
    got = sorted((tuple(r) for r in manifest.manifest(df).collect()), key=repr)
    assert got == brute(rows)
    return got


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    q = catalog.QUERIES["op12_manifest"]
    text, _, good = check.compare(spark, con, sf, "op12_manifest", q.run, q.sql)
    assert good and "types" not in text, text


def test_odd_rows(odd, empty):
    verify(odd, [(r[0], r[3], r[2], r[4], r[1]) for r in ODD])
    assert manifest.manifest(empty).count() == 0


@pytest.mark.parametrize("sizes", [[1], [2, 8, 9], [64, 65, 1, 7], [512, 513], [4_200]])
def test_sizes(spark, sizes):
    """Runs that are full, short or single, groups of one block and of several, and the tree above the groups."""
    rows, i = [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i * 7 % 10_007 - 50, f"s{i % 3}", f"l{g}", i, f"Text {i}" if i % 11 else None))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = verify(df.select("doc_id", "text", "lang", "source", "n_chars").repartition(5), rows)
    assert sizes == [1] or {r[-1] for r in got} == {True, False}


def test_many_groups(spark):
    rows = [(i, "s", f"g{i % 70}" if i % 70 else None, 1, "A" * (i % 5)) for i in range(700)]
    verify(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), rows)


def test_a_repeated_row_is_not_one_task(spark):
    """Rows that are equal in everything are dealt out by range, and blocks keep their size."""
    df = spark.range(6_000).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit("T").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"),
        F.lit(1).cast("long").alias("n_chars"),
    )
    ranked, sizes = manifest.with_rank(manifest.leaves(df), ["doc_id", "leaf"], "test")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(6_000)) and sizes.first()["size"] == 6_000
    nodes = ranked.join(sizes.select("size")).select("grp", "size", "rank", F.col("leaf").alias("hash"), F.lit(None).cast("string").alias("carried"))
    made = manifest.blocks(nodes)
    assert made.count() == 12 and made.agg(F.max(F.size("tree"))).first()[0] == 8
    verify(df, [(1, "s", "en", 1, "T")] * 6_000)
