"""The registered queries: one for each operator, over its whole table, with the SQL that gives the same rows.

Each query applies its operator with production parameters and derives the agreed columns from what it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.llm import collocations, forest, license_scan, manifest, mixing, near_dedup, packing, pii, quality_classifier
from tierlake.llm import quality_rules, ring, toxicity, url_rules
from tierlake.plans.registry import Query

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under a name."""

    def add(run):
        QUERIES[name] = Query(name, run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op3_ring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard(table(spark, sf_dir, "documents"))


# The rules of the query.
URL_RULES = """VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')"""

OP4_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    row_number() OVER () AS r
  FROM pages),
rules(h, p, v) AS ({rules}),
won AS (
  SELECT r, arg_max(h || p, 1000 * length(h) + length(p)) AS rule, arg_max(v, 1000 * length(h) + length(p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN won USING (r)
""".replace("{rules}", URL_RULES)


@query("op4_url_rules", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {URL_RULES} AS rules(host, path, verdict)")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_rules.judge(table(spark, sf_dir, "documents"), labels)


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality_classifier.score_documents(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS hash, row_number() OVER () AS r
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n
  FROM docs GROUP BY source),
weighted AS (SELECT *, [3, 1, 2][(n % 3 + 1)::INTEGER] AS w, 2 * source_size AS most FROM sources),
-- Rounds: whoever is above the limit stops there, and the rest is shared anew.
rounds AS (
  SELECT 0 AS k, source, source_size, n, w, most, false AS full,
    1.5 * sum(source_size) OVER () * w / sum(w) OVER () AS target
  FROM weighted
  UNION ALL
  SELECT k + 1, source, source_size, n, w, most, target >= most,
    CASE WHEN target >= most THEN most
    ELSE (1.5 * sum(source_size) OVER () - sum(CASE WHEN target >= most THEN most ELSE 0 END) OVER ()) * w
      / sum(CASE WHEN target >= most THEN 0 ELSE w END) OVER () END
  FROM rounds WHERE k < 1 + (SELECT count(*) FROM sources)),
aims AS (
  SELECT source, source_size::BIGINT AS source_size, target::DOUBLE AS target, round(target)::BIGINT AS words
  FROM rounds WHERE k = (SELECT max(k) FROM rounds)),
line AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY hash, doc_id, size, r
    ROWS UNBOUNDED PRECEDING) - size AS b
  FROM docs)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
  (greatest(0, least(b + size, words) - b)
    + greatest(0, least(b + size + source_size, words) - b - source_size))::BIGINT AS taken
FROM line JOIN aims ON line.source IS NOT DISTINCT FROM aims.source
"""


@query("op8_mixing", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


@query("op9_forest")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return forest.search(vectors, vectors.where("vec_id % 50 = 0"))


@query("op10_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("content")


OP11_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM places, (VALUES (1), (2), (3), (4)) AS sizes(k)
  WHERE i + k - 1 <= len(w)
  GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
frequent AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE f >= 30),
-- Every shorter phrase inside a frequent one.
inside AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, k, w, f, m, unnest(range(1, k - m + 2)) AS s
    FROM frequent, (VALUES (2), (3)) AS sizes(m) WHERE m < k)
  GROUP BY ALL),
candidates AS (
  SELECT c.lang, c.phrase, c.k, c.w, c.f AS a
  FROM frequent c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase
  WHERE c.k > 1 AND (i.longer IS NULL OR 100 * i.longer < 80 * c.f)),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (2000000 * c.a) // (x.f + y.f) AS score
  FROM cuts c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
best AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _manifest_sql(levels: int) -> str:
    """SQL for trees of up to 8^levels leaves: level by level, a run's digest and what stands beside each node."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    leaf = "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = []
    for name, group in (("d", "lang"), ("t", "one")):
        steps.append(f"{name}0 AS (SELECT *, way AS way0, hash AS hash0 FROM {name})")
        for k in range(1, levels + 1):
            # The nodes of a level, once each, and their runs.
            steps.append(
                f"{name}n{k} AS (SELECT {group} AS g, rank // {8 ** (k - 1)} AS pos, any_value(hash{k - 1}) AS h,"
                f" count(*) OVER (PARTITION BY {group}) > 1 AS many"
                f" FROM {name}{k - 1} GROUP BY {group}, rank // {8 ** (k - 1)})"
            )
            steps.append(
                f"{name}r{k} AS (SELECT g, pos // 8 AS run, list(h ORDER BY pos) AS hs, bool_and(many) AS many FROM {name}n{k} GROUP BY ALL)"
            )
            place = f"((x.rank // {8 ** (k - 1)}) % 8)"
            steps.append(
                f"{name}{k} AS (SELECT x.* EXCLUDE (way{k - 1}, hash{k - 1}),"
                f" CASE WHEN many THEN list_append(way{k - 1},"
                f" {{'l': array_to_string(hs[1:{place}], ''), 'r': array_to_string(hs[{place} + 2:], '')}})"
                f" ELSE way{k - 1} END AS way{k},"
                f" CASE WHEN many THEN sha256(array_to_string(hs, '')) ELSE hash{k - 1} END AS hash{k}"
                f" FROM {name}{k - 1} x JOIN {name}r{k} y ON x.{group} IS NOT DISTINCT FROM y.g AND x.rank // {8**k} = y.run)"
            )
        if name == "d":
            steps.append(f"subroots AS (SELECT lang, any_value(hash{levels}) AS subroot FROM d{levels} GROUP BY lang)")
            steps.append(
                "t AS (SELECT lang, subroot, 1 AS one, subroot AS hash, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank,"
                " []::STRUCT(l VARCHAR, r VARCHAR)[] AS way FROM subroots)"
            )
    return (
        "WITH leaves AS (SELECT doc_id, lang, "
        + leaf.replace("{text}", "text")
        + " AS leaf, CASE WHEN (xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''),"
        " lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],"
        " lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)) % 3 = 0 THEN "
        + leaf.replace("{text}", low)
        + " END AS altered FROM documents),"
        " d AS (SELECT *, leaf AS hash, []::STRUCT(l VARCHAR, r VARCHAR)[] AS way,"
        " row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM leaves), "
        + ", ".join(steps)
        + f", proofs AS (SELECT doc_id, leaf, altered, subroot, t{levels}.hash{levels} AS root,"
        f" list_concat(d{levels}.way{levels}, t{levels}.way{levels}) AS way"
        f" FROM d{levels} JOIN t{levels} ON d{levels}.lang IS NOT DISTINCT FROM t{levels}.lang),"
        " ended AS (SELECT *, list_reduce(list_prepend(coalesce(altered, leaf), list_transform(way, lambda s: s.l || '|' || s.r)),"
        " lambda h, s: sha256(replace(s, '|', h))) AS folded_root FROM proofs)"
        " SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: s.l || s.r), '')) AS proof_sha256,"
        " folded_root, folded_root = root AS verified FROM ended"
    )


# Up to 8^5 leaves a language, which is what the SQL is run on.
OP12_SQL = _manifest_sql(5)


@query("op12_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
