"""Personal data by patterns, and by contexts that bootstrap from what the patterns find."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlake.session import materialise

#: Code points on either side of a span in which its neighbouring words are looked for.
CONTEXT = 64

KINDS = ("email", "ip", "card", "phone")

# What counts as each kind. Starts are tied to where a run of characters begins, and repetitions don't
# give back what they took; neither changes the matches, but both keep the time linear in the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What might be one: the candidates among which contexts find further identifiers.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}(?:@| ?[\[(]at[\])] ?| at (?=[A-Za-z0-9-]{1,64} dot ))[A-Za-z0-9-]{1,64}"
    r"(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]{1,64}){0,8}",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.(-])\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){1,4}(?![0-9A-Za-z])",
}
# Fixed value: a dotted address whose parts are at most 255.
_ADDRESS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
_SPACE = r"[\x20\x09-\x0D]"


# Digits that are a date or a range of years, and no telephone number.
_YEAR, _MONTH, _DAY = "(?:1[5-9]|20)[0-9]{2}", "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])"
_DATE = (
    rf"^\(?(?:{_YEAR}[\x20./-]+{_MONTH}[\x20./-]+{_DAY}|{_DAY}[\x20./-]+{_MONTH}[\x20./-]+{_YEAR}"
    rf"|{_MONTH}[\x20./-]+{_DAY}[\x20./-]+{_YEAR}|{_YEAR}(?:[\x20./-]+{_YEAR})+)(?![0-9])"
)


@dataclass(frozen=True)
class Settings:
    """Rounds of scoring, and what a context and an instance must reach.

    A context counts for a kind when decided instances of that kind worth `support` stand in it, and they are at least
    the share `precision` of all decided instances in it: base instances and those accepted so far, of any kind. To
    these, each undecided candidate of the kind adds `unlike` if no base instance of the kind has its shape.
    Instances are accepted from the score `accepted` on.
    """

    rounds: int = 3
    support: float = 8.0
    precision: float = 0.9
    accepted: float = 0.9
    unlike: float = 0.5


def _settled(df: DataFrame) -> DataFrame:
    """The same rows; the columns so far are computed once here, not anew wherever a later expression names them."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """The checksum of the digits: every second one from the right counts twice, less 9 if above 9."""
    backwards = F.reverse(_digits(value))

    def worth(i: Column) -> Column:
        digit = backwards.substr(i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    places = F.sequence(F.lit(1), F.length(backwards))
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    """Whether a base match passes its check."""
    n = F.length(_digits(value))
    return (
        F.when(kind == 0, True)
        .when(kind == 1, value.rlike(_ADDRESS))
        .when(kind == 2, n.between(16, 19) & F.when(n.between(16, 19), _luhn(value)).otherwise(False))
        .otherwise(n.between(8, 15))
    )


def _plausible(kind: Column, value: Column) -> Column:
    """Whether a loose match may be an identifier: enough digits for its kind, and no date or range of years."""
    n = F.length(_digits(value))
    return F.when(kind == 2, n.between(12, 19)).when(kind == 3, n.between(7, 15) & ~value.rlike(_DATE)).otherwise(True)


def _shape(kind: Column, value: Column) -> Column:
    """The runs of digits of a card or telephone number, each digit as 0; the separator of an address.

    Addresses of mail are all alike, whichever way they write the at and the dots.
    """
    runs = F.regexp_replace(F.regexp_replace(value, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+", "-")
    return F.when(kind == 0, "@").when(kind == 1, F.when(value.contains(":"), ":").otherwise(".")).otherwise(F.regexp_replace(runs, "[0-9]", "0"))


def _known_shapes(edges: DataFrame) -> DataFrame:
    """`kind, shape` of the base instances, and of the ends of telephone numbers that begin with other runs."""
    shapes = edges.where("base").select("kind", _shape(F.col("kind"), F.col("value")).alias("shape")).distinct()
    runs = F.split("shape", "-")
    ends = F.transform(F.sequence(F.lit(1), F.size(runs)), lambda i: F.array_join(F.slice(runs, i, F.size(runs)), "-"))
    return shapes.select("kind", F.explode(F.when(F.col("kind") == 3, ends).otherwise(F.array("shape"))).alias("shape")).distinct()


def _word(near: Column, pattern: str) -> Column:
    """A neighbouring word without outer punctuation, in lower case, its digits as 0; null if there is none."""
    word = F.lower(F.regexp_extract(near, pattern, 1))
    word = F.regexp_replace(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), "[0-9]+", "0")
    return F.when(word != "", word)


def _matches(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with `hits`: for each pattern that matches a text, the matches and the text between them, by length."""
    patterns = [(k, True, BASE[kind]) for k, kind in enumerate(KINDS)] + [(k, False, LOOSE[kind]) for k, kind in enumerate(KINDS)]
    content = F.coalesce(F.col(text), F.lit(""))
    may_have = {0: F.col("_text").contains("@") | F.lower("_text").contains("at"), 3: F.col("_digit")}
    rows = _settled(docs.withColumn("_text", content))
    rows = _settled(rows.withColumn("_digit", F.col("_text").rlike("[0-9]")))
    values = []
    for n, (kind, base, pattern) in enumerate(patterns):
        gate = {(0, True): F.col("_text").contains("@"), (3, True): F.col("_text").contains("+")}.get((kind, base))
        if gate is None:
            gate = may_have[0] if kind == 0 else (F.col("_text").contains(":") if (kind, base) == (1, False) else F.col("_digit"))
        rows = rows.withColumn(f"_m{n}", F.when(gate, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))))
    rows = _settled(rows)
    for n, (kind, base, pattern) in enumerate(patterns):
        found = F.col(f"_m{n}")
        gaps = F.transform(
            F.split("_text", pattern, -1),
            lambda p: F.struct(
                F.length(p).alias("n"),
                F.right(p, F.lit(CONTEXT)).alias("left"),
                F.left(p, F.lit(CONTEXT)).alias("right"),
            ),
        )
        hit = F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), found.alias("values"), gaps.alias("gaps"))
        values.append(F.when(F.size(found) > 0, hit))
    rows = rows.withColumn("hits", F.array_compact(F.array(*values)))
    return rows.drop("_text", "_digit", *(f"_m{n}" for n in range(len(patterns))))


def _spans(found: DataFrame) -> DataFrame:
    """`row, kind, base, start, end, value, left, right` of every match that passes its check.

    Candidates that touch a base span go. Those of different kinds may overlap or be one span.
    """
    hits = found.select("row", F.explode("hits").alias("hit")).select("row", "hit.kind", "hit.base", "hit.values", "hit.gaps")
    after = F.concat(F.slice("gaps", 2, F.greatest(F.size("gaps") - 1, F.lit(0))), F.array(F.lit(None)))
    parts = F.arrays_zip(F.col("values").alias("value"), F.col("gaps").alias("gap"), after.alias("next"))
    rows = hits.select("row", "kind", "base", F.posexplode(parts).alias("k", "part")).where("part.value is not null")
    along = Window.partitionBy("row", "kind", "base").orderBy("k")
    rows = rows.withColumn("end", F.sum(F.col("part.gap.n") + F.length("part.value")).over(along)).select(
        "row",
        "kind",
        "base",
        (F.col("end") - F.length("part.value")).alias("start"),
        "end",
        F.col("part.value").alias("value"),
        _word(F.col("part.gap.left"), f"([^\\x20\\x09-\\x0D]+){_SPACE}*$").alias("left"),
        _word(F.col("part.next.right"), f"^{_SPACE}*([^\\x20\\x09-\\x0D]+)").alias("right"),
    )
    rows = rows.where(F.when(F.col("base"), _valid(F.col("kind"), F.col("value"))).otherwise(_plausible(F.col("kind"), F.col("value"))))
    around = Window.partitionBy("row").orderBy("start", F.desc("base"), "end", "kind")
    before, behind = around.rowsBetween(Window.unboundedPreceding, -1), around.rowsBetween(1, Window.unboundedFollowing)
    firm = F.col("base")
    apart = (F.coalesce(F.max(F.when(firm, F.col("end"))).over(before), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(F.when(firm, F.col("start"))).over(behind), F.col("end")) >= F.col("end")
    )
    return rows.withColumn("apart", apart).where("base or apart").drop("apart")


def learn(spans: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`kind, value` of the candidates that their contexts show to be identifiers.

    Instances (kind and value) and contexts (the word before or after) make a graph. Base instances have score 1 for
    their kind, candidates are undecided until they are accepted. In each round a context's precision for a kind is the
    summed score of its decided instances of that kind among all its decided instances, and a candidate's score is the
    chance that not all its trusted contexts are wrong. Undecided candidates that have the shape of a base instance of
    their kind say nothing about a context, however many stand in it; those of other shapes count against it with a
    smoothed weight, so a word before unlike strings is not trusted. Copies of a text add nothing, since instances are
    distinct.
    """
    return _scores(spans, settings).select("kind", "value")


def _scores(spans: DataFrame, settings: Settings) -> DataFrame:
    """`kind, value, score` of what `learn` accepts."""
    spark = spans.sparkSession
    sides = F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("word")), F.struct(F.lit("r").alias("side"), F.col("right").alias("word")))
    edges = spans.select("kind", "base", "value", F.explode(sides).alias("context")).where("context.word is not null")
    edges = edges.groupBy("context", "kind", "value").agg(F.max("base").alias("base"))
    edges = edges.select(F.concat("context.side", F.lit(":"), "context.word").alias("context"), "kind", "value", "base")
    edges = edges.withColumn("shape", _shape(F.col("kind"), F.col("value")))
    known = _known_shapes(edges).withColumn("known", F.lit(True))
    edges = edges.join(known, ["kind", "shape"], "left").withColumn("alike", F.col("base") | F.coalesce("known", F.lit(False)))
    edges = materialise(spark, edges.drop("shape", "known"), "contexts")
    scores = spark.createDataFrame([], "kind int, value string, score double")
    for _ in range(settings.rounds):
        accepted = scores.where(F.col("score") >= settings.accepted)
        decided = edges.join(accepted, ["kind", "value"], "left").withColumn(
            "score", F.when(F.col("base"), F.lit(1.0)).otherwise(F.col("score"))
        )
        unlike = F.count_if(F.col("score").isNull() & ~F.col("alike")) * settings.unlike
        trusted = (
            decided.groupBy("context", "kind")
            .agg(F.sum("score").alias("worth"), F.count("score").alias("n"), unlike.alias("unlike"))
            .withColumn("precision", F.col("worth") / (F.sum("n").over(Window.partitionBy("context")) + F.col("unlike")))
            .where((F.col("worth") >= settings.support) & (F.col("precision") >= settings.precision))
        )
        wrong = F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(1e-6))))
        scores = (
            edges.where("not base")
            .join(trusted.select("context", "kind", "precision"), ["context", "kind"])
            .groupBy("kind", "value")
            .agg((1 - F.exp(wrong)).alias("score"))
        )
        scores = materialise(spark, scores, "instances")
    return scores.where(F.col("score") >= settings.accepted)


def _resolved(spans: DataFrame) -> DataFrame:
    """`row, span` of accepted candidates (`row, kind, start, end, score`): of those that overlap, best score first.

    Of equal scores the longer one goes first, then the earlier one, then the kind. Only runs of spans that hang
    together are held at a time.
    """
    along = Window.partitionBy("row").orderBy("start", "end", "kind")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("opens", F.when(before > F.col("start"), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("kind", "start", "end")
    ranked = F.struct((-F.col("score")).alias("score"), (F.col("start") - F.col("end")).alias("length"), "start", "kind", place.alias("span"))
    ordered = F.transform(F.array_sort(F.collect_list(ranked)), lambda r: r["span"])
    runs = runs.groupBy("row", "run").agg(ordered.alias("ordered"))
    none = F.slice("ordered", 1, 0)

    def step(kept: Column, s: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

    kept = F.when(F.size("ordered") == 1, F.col("ordered")).otherwise(F.aggregate("ordered", none, step))
    return runs.select("row", F.explode(kept).alias("span"))


def find(
    docs: DataFrame, settings: Settings = Settings(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns `keep` of every row, `base` and `spans`: arrays of `kind, start, end`, by kind (its place in `KINDS`) and start.

    Base spans are the valid matches of `BASE` in the whole text, leftmost first and without overlap within a kind; a
    match that fails its check is dropped without another try. `spans` has the base spans and those of candidates
    (`LOOSE`) that the contexts of base spans, scored over all rows, show to be identifiers as well; where accepted
    candidates overlap, the one of better score stays. Places count code points from 0, the end exclusive.

    Null and empty texts have empty arrays. Rows that repeat each get their spans. Without base spans there are no
    others. Columns whose names clash with results are not kept unless named. An empty table gives no rows. Texts are
    read once; what is held of a text afterwards are its matches and the `CONTEXT` code points around them.
    """
    spark = docs.sparkSession
    picked = docs.select(*(F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)), F.col(text).alias("_content"))
    found = _matches(picked.withColumn("row", F.monotonically_increasing_id()), "_content").drop("_content")
    found = materialise(spark, found, "matches")
    spans = materialise(spark, _spans(found), "spans")
    learned = _scores(spans, settings)
    place = F.struct("kind", "start", "end")
    base = spans.where("base").select("row", place.alias("span"), F.lit(True).alias("base"))
    accepted = spans.where("not base").join(learned, ["kind", "value"]).select("row", "kind", "start", "end", "score")
    more = _resolved(accepted).withColumn("base", F.lit(False))
    gathered = base.union(more).groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), F.col("span")))).alias("base"),
        F.array_sort(F.collect_list("span")).alias("spans"),
    )
    none = F.array().cast(gathered.schema["spans"].dataType)
    return found.drop("hits").join(gathered, "row", "left").select(
        *(F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)),
        F.coalesce("base", none).alias("base"),
        F.coalesce("spans", none).alias("spans"),
    )


def written(spans: Column) -> Column:
    """Spans as `kind:start:end`, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """A text with every span replaced by its kind in brackets; what overlaps becomes one span of the first kind."""
    kinds = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, s: Column) -> Column:
        between = F.substring(text, done["at"] + 1, (s["start"] - done["at"]).cast("int"))
        apart = s["start"] >= done["at"]
        return F.struct(
            F.when(apart, F.concat(done["out"], between, F.lit("["), F.element_at(kinds, s["kind"] + 1), F.lit("]"))).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], s["end"]).alias("at"),
        )

    def last(done: Column) -> Column:
        return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))

    return F.when(F.size(ordered) > 0, F.aggregate(ordered, start, step, last)).otherwise(text)
