import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import check
from tierlake.llm import catalog, collocations
from llm_tools import ASCII_LOWER, COLUMNS, ODD


def brute(rows, least=30, longest=4, top=2000):
    """`lang, rank, phrase, a, l, r, n, score` by plain counting; rows are (text, lang)."""
    counts, totals = {}, Counter()
    for text, lang in rows:
        f = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        longer = Counter()
        for p, a in often.items():
            for k in range(1, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in often.items():
            if len(p) > 1 and 100 * longer[p] < 80 * a:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    q = catalog.QUERIES["op11_collocations"]
    text, _, good = check.compare(spark, con, sf, "op11_collocations", q.run, q.sql)
    assert good and "types" not in text, text


@pytest.mark.parametrize("least", [1, 2, 30])
def test_odd_rows(odd, empty, least):
    settings = collocations.Settings(least=least)
    got = rows_of(collocations.collocations(odd, settings))
    assert got == brute([(r[1], r[2]) for r in ODD], least)
    assert collocations.collocations(empty, settings).count() == 0


def test_ties_subsumption_and_pieces(spark):
    rng = random.Random(3)
    words = "a b c d É é ß 中 x' the".split()
    seps = [" ", "  ", "\t", ". ", ",", "\n", " ! ", "\x0b", ";x:"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice(seps[:3] * 5 + seps) for _ in range(rng.randint(0, 60)))
        rows.append((i, rng.choice(["New York City hall ", ""]) + text, rng.choice(["en", "en", "en", "und", None, ""]), "s", 1))
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    for least, longest, top in ((5, 4, 2000), (5, 3, 7), (20, 2, 2000)):
        settings = collocations.Settings(longest=longest, least=least, top=top)
        want = brute([(r[1], r[2]) for r in rows], least, longest, top)
        assert rows_of(collocations.collocations(df, settings)) == want and want
    phrases = {r[2] for r in brute([(r[1], r[2]) for r in rows], 20)}
    assert "new york city hall" in phrases and "new york" not in phrases


def test_a_full_screen_drops_nothing(spark, documents):
    """With every bit set, or with few bits, the stripes hold more, and the rows are the same."""
    settings = collocations.Settings(least=12)
    want = rows_of(collocations.collocations(documents, settings))
    assert want and rows_of(collocations.collocations(documents, collocations.Settings(least=12, screen_bits=17))) == want
    texts = documents.selectExpr("coalesce(lang, 'und') AS lang", "cast(text AS binary) AS text")
    whole = [np.full(1 << 14, 255, dtype=np.uint8)] * 2
    stripes = collocations.added(collocations.local_stripes(texts, whole, settings), settings)
    assert rows_of(collocations.ranked(stripes, settings)) == want


def test_exact_beyond_64_bits(spark):
    """Counts near 10^15: scores and subsumption stay exact."""
    big = 9 * 10**15
    rows = [
        ("en", "", 0, 3 * big, [("p", big), ("q", big + 7)]),
        ("en", "p", 0, big, [("q", big - 3)]),
        ("en", "p q", 0, big, [("r", big * 8 // 10 - 5)]),
        ("en", "q", 0, big, [("r", big - 1)]),
        ("en", "", 1, 5, [("r", big + 1)]),
    ]
    schema = "lang string, prefix string, part int, total bigint, followers array<struct<next:string,f:bigint>>"
    got = {r.phrase: r for r in collocations.ranked(spark.createDataFrame(rows, schema), collocations.Settings()).collect()}
    assert set(got) == {"p q", "q r", "p q r"} and {r.n for r in got.values()} == {3 * big + 5}
    assert got["p q"].score == 2_000_000 * (big - 3) // (2 * big + 7)
    assert got["p q r"].score == min(2_000_000 * (big * 8 // 10 - 5) // s for s in (2 * big - 1, 2 * big - 2))


def test_a_hot_prefix_is_dealt_over_parts(spark):
    text = " ".join(f"the w{i}" for i in range(3_000))
    df = spark.createDataFrame([(i, text, "en", "s", 1) for i in range(2)], COLUMNS)
    settings = collocations.Settings(least=1)
    texts = df.selectExpr("lang", "cast(text AS binary) AS text")
    screens = [collocations.next_screen(texts, [], settings)]
    screens.append(collocations.next_screen(texts, screens, settings))
    stripes = collocations.added(collocations.local_stripes(texts, screens, settings), settings).where("prefix = 'the'").collect()
    assert len(stripes) > 200 and max(len(r.followers) for r in stripes) < 60
    assert sum(r.total for r in stripes) == 6_000
