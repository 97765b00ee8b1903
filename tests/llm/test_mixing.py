import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from tierlake.llm import catalog, mixing
from llm_tools import ODD, words


def fill(sizes):
    """Targets by the rounds of the contract: who is above twice the size stops there, the rest is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, total = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > 2 * sizes[s]]
        if not above:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in above}


def sizes_of(rows):
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    return dict(sizes)


def verify(df, rows):
    sizes = sizes_of(rows)
    want, taken = fill(sizes), defaultdict(int)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for r in mixing._mixed(mixing._line(df, mixing.Settings(), "doc_id", "text", "source"), mixing.Settings()).collect():
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert {s: taken[s] for s in sizes} == {s: round(t) for s, t in want.items()}
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df).collect()))


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    q = catalog.QUERIES["op8_mixing"]
    text, _, good = check.compare(spark, con, sf, "op8_mixing", q.run, q.sql)
    assert good and "types" not in text, text


def test_odd_rows(odd, empty):
    verify(odd, ODD)
    assert mixing.mix(empty).count() == 0


def test_many_small_sources(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 9), "en", rng.choice(["a", "b", "Z", "é", "", None, f"s{i % 40}"]), 1) for i in range(400)]
    verify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows)


def test_schedule_keeps_shares(spark):
    """After any number of slots each source has had its share to within a few."""
    blocks = {0: 500, 1: 300, 2: 199, 3: 1}
    total = sum(blocks.values())
    df = spark.createDataFrame(list(blocks.items()), "n long, blocks long")
    rows = sorted((r.slot, r.n, r["rank"]) for r in mixing.schedule(df, total).collect())
    drawn = defaultdict(int)
    for slot, n, rank in rows:
        assert rank == drawn[n]
        drawn[n] += 1
        if slot < total:
            assert all(abs(drawn[k] - (slot + 1) * b / total) < 5 for k, b in blocks.items())
    assert dict(drawn) == blocks


def test_the_mix_itself(spark, documents):
    taken = {r.doc_id: r.taken for r in mixing.mix(documents).collect()}
    size = lambda t: F.size(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = mixing.mixed_documents(documents)
    assert rows.columns == documents.columns
    got = {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(F.sum(size("text")).alias("n")).collect()}
    assert got == {d: n for d, n in taken.items() if n}


def test_the_mix_comes_in_the_order_of_the_schedule(spark):
    """After any number of rows each source has had its share, and a document's second pass is far from its first."""
    size = {"a": 5, "b": 5, "c": 4}
    rows = [(i, "w " * size[s], "en", s, 1) for i, s in enumerate("a" * 100 + "b" * 200 + "c" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = [(r.source, len(words(r.text)), r.doc_id) for r in mixing.mixed_documents(df).collect()]
    total, drawn, seen = sum(n for _, n, _ in got), defaultdict(int), {}
    want = {s: sum(n for x, n, _ in got if x == s) for s in size}
    done = 0
    for k, (s, n, doc) in enumerate(got):
        drawn[s] += n
        done += n
        assert all(abs(drawn[x] - done * want[x] / total) < 25 for x in size)
        assert k - seen.get(doc, -100) > 5
        seen[doc] = k
    assert len(got) > len(seen)


def test_cut_texts_keep_their_white_space(spark):
    """Of a document taken in part, what is taken is the text itself up to the end of its last word."""
    texts = ["\n a\tb\n\n  c \U0001f600d\r\n" * 9, "é  f\n\ng h\u00a0i  " * 7, "k\n" * 11, "  l  m\n" * 9, "n\n\to " * 5]
    rows = [(i, t, "en", f"s{i}", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken, cuts = {r.doc_id: r.taken for r in mixing.mix(df).collect()}, 0
    got = defaultdict(list)
    for r in mixing.mixed_documents(df).collect():
        got[r.doc_id].append(r.text)
    for i, text in enumerate(texts):
        parts = sorted(got[i], key=len)
        assert sum(len(words(p)) for p in parts) == taken[i]
        assert all(p == text for p in parts[1:]) and text.startswith(parts[0])
        if parts[0] != text:
            cuts += 1
            assert parts[0] == text[: [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)][len(words(parts[0])) - 1]]
    assert cuts
