"""Mixing sources to target weights by a low-discrepancy schedule over shuffled equal-token blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlake.session import materialise

# Fixed value: the fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Parts of a source's shuffled order that are summed on their own: the first three hexadecimal digits of its hash.
DIGITS = 3
#: Consecutive slots that are ranked together.
RANKED = 1 << 16
#: Cells of the unit interval by which points find their source.
CELLS = 4096


@dataclass(frozen=True)
class Settings:
    """Share of all sizes that the mix takes, most passes over a source, and how long a block is.

    Blocks are `block` words, shorter where the mix would otherwise have fewer than `least_slots` of them.
    """

    share: float = 1.5
    passes: int = 2
    weights: tuple[int, ...] = (3, 1, 2)
    block: int = 1 << 16
    least_slots: int = 1 << 16
    seed: str = "mix"


def words(text: Column) -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`source, source_size, target, words` for `sizes` (`source, source_size`): what the mix takes of each source.

    Sources in order of code points, null last, have the weights in turn and share `share` of all sizes. A target
    stops at `passes` times its source's size, and the rest is shared by weight among the others until none is above:
    sources fill up in the order of their limit for each unit of weight, and the level at which the first one stays
    below its limit is the level of all that follow. `words` is the target in whole words. One row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, settings.weights))
    ranked = sizes.withColumn("n", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(weights, (F.col("n") % len(settings.weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("limit", F.col("source_size") * settings.passes)
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "n")
    before, whole = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(settings.share) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    leveled = ranked.withColumn("level", level).withColumn("below", F.col("level") * F.col("weight") < F.col("limit"))
    first = F.first(F.when(F.col("below"), F.col("level")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, 0)
    )
    final = leveled.withColumn("final", first)
    target = F.when(F.col("final").isNull(), F.col("limit").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return final.select(
        "source", "n", "source_size", F.least(target, F.col("limit").cast("double")).alias("target")
    ).withColumn("words", F.round("target").cast("long"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """`slot, n, rank`: which source each slot of the mix draws from, and its how-manieth draw it is.

    `sources` has `n, blocks`, at least one block each, `slots` in all. Slot i is the golden-ratio point frac(i * g),
    mapped through the cumulative shares of the blocks: after any number of slots each source has had its share, to
    within a few. Four times as many points are laid as slots are needed, since then an interval of the width of one
    slot has surely been met; the first `blocks` draws of a source count, the others go.
    """
    spark = sources.sparkSession
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    shares = sources.withColumn("until", F.sum("blocks").over(upto) / F.lit(slots)).withColumn(
        "from", (F.sum("blocks").over(upto) - F.col("blocks")) / F.lit(slots)
    )
    last = F.least(F.floor(F.col("until") * CELLS), F.lit(CELLS - 1))
    celled = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * CELLS), last)))
    points = spark.range(4 * slots).withColumnRenamed("id", "slot").withColumn("at", F.col("slot") * F.lit(GOLDEN) % 1.0)
    points = points.withColumn("cell", F.floor(F.col("at") * CELLS))
    drawn = points.join(celled, "cell").where("at >= from and at < until").select("slot", "n", "blocks")
    # Ranks from counts of runs of slots, so that a source with most of the slots is not ranked in one task.
    drawn = materialise(spark, drawn.withColumn("run", F.floor(F.col("slot") / RANKED)), "slots")
    counts = drawn.groupBy("n", "run").agg(F.count("*").alias("drawn"))
    runs = counts.withColumn(
        "before", F.sum("drawn").over(Window.partitionBy("n").orderBy("run")) - F.col("drawn")
    ).drop("drawn")
    ranked = drawn.join(runs, ["n", "run"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("n", "run").orderBy("slot")) - 1
    )
    return ranked.where("rank < blocks").select("slot", "n", "rank")


def mix(
    docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """`doc_id, size, source_size, target, taken` for every row of `docs`: how many of its words the mix takes.

    Each source's documents are shuffled by a hash of their id and laid end to end, as often as a source may be passed
    over. This line is cut into blocks of equal length. The schedule's k-th draw from a source takes its k-th block,
    the last draw only up to the target, so a source gives its target in whole words and no document more than
    `passes` times its size. `taken` counts repeats.

    Sums along a line are made from those of its parts (`DIGITS`), so that a source of any size is no single task.
    Null and empty texts have size 0 and are taken 0 times. A null source is a source. Rows that repeat are separate
    documents, next to each other in the line. Reruns agree, also for rows without an id. Other columns are ignored.
    An empty table gives no rows.
    """
    return _mixed(_line(docs, settings, doc_id, text, source), settings).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def mixed_documents(
    docs: DataFrame,
    settings: Settings = Settings(),
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    stored: bool = False,
) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each time that words of a document are taken.

    Texts are moved once: the schedule works on sizes and on where each row lies in its file, and the rows then meet
    what is taken of them. That deals them out evenly at random. Each partition is sorted by the slots that draw its rows
    first, so any stretch of a partition has each source's share to within a few blocks and documents, and the passes over
    a document are apart. Documents that are not taken go. Of one taken in part, which is at most one in each source, the
    text stays as it is up to the end of the last word that is taken; the words behind it are beyond the source's target.

    `stored` says that `docs` are the rows of files as they are; others are written to files first.
    """
    docs = docs if stored else materialise(docs.sparkSession, docs, "unmixed")
    place = F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index")
    rows = _line(docs, settings, doc_id, text, source, place)
    _, pieces = _pieces(rows, settings)
    passes = pieces.groupBy("row", "pass").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"))
    taken = passes.groupBy("row").agg(F.collect_list(F.struct("slot", "pass", "taken")).alias("draws"))
    taken = rows.select("row", "_file", "_index", F.col("size").alias("_size")).join(taken, "row")
    carried = [F.col(c).alias(f"_doc{k}") for k, c in enumerate(docs.columns)]
    whole = docs.select(*place, *carried).join(taken, ["_file", "_index"]).withColumn("_draw", F.explode("draws"))
    content = F.col(f"_doc{docs.columns.index(text)}")
    # Pieces and gaps alternate; a text that begins with a gap has an empty piece before it.
    lengths = F.transform(F.split(content, r"[\x20\x09-\x0D]+"), lambda p: F.length(p))
    gaps = F.transform(F.regexp_extract_all(content, F.lit(r"[\x20\x09-\x0D]+"), F.lit(0)), lambda g: F.length(g))
    upto = F.col("_draw.taken").cast("int") + F.when(F.element_at(lengths, 1) == 0, 1).otherwise(0)
    total = F.concat(F.slice(lengths, 1, upto), F.slice(gaps, 1, upto - 1))
    first = F.left(content, F.aggregate(total, F.lit(0), lambda a, b: a + b))
    cut = F.when(F.col("_draw.taken") < F.col("_size"), first).otherwise(content)
    rows = whole.sortWithinPartitions("_draw.slot", "row", "_draw.pass")
    return rows.select(*((cut if c == text else F.col(f"_doc{k}")).alias(c) for k, c in enumerate(docs.columns)))


def _line(docs: DataFrame, settings: Settings, doc_id: str, text: str, source: str, place: tuple[Column, ...] = ()) -> DataFrame:
    """The documents with their size and place in the shuffled order, without texts, written once."""
    number = F.col(doc_id).cast("long")
    rows = docs.select(
        number.alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        words(F.col(text)).alias("size"),
        F.md5(F.concat(F.lit(settings.seed + ":"), F.coalesce(number.cast("string"), F.lit("")))).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
        *place,
    )
    return materialise(docs.sparkSession, rows, "line")


def _mixed(rows: DataFrame, settings: Settings) -> DataFrame:
    aimed, pieces = _pieces(rows, settings)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return aimed.join(taken, "row", "left").select(
        "row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def _pieces(rows: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The documents with their source's target, and `row, pass, slot, words` of the words that each slot draws from them."""
    spark = rows.sparkSession
    aims = materialise(spark, targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), settings), "targets")
    total = aims.agg(F.sum("words")).first()[0] or 0
    block = max(1, min(settings.block, total // settings.least_slots))
    wanted = aims.withColumn("blocks", F.ceil(F.col("words") / F.lit(block))).where("blocks > 0").select("n", "blocks")
    slots = wanted.agg(F.sum("blocks")).first()[0] or 0

    part = F.substring("hash", 1, DIGITS)
    parts = rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("sum"))
    parts = parts.withColumn(
        "before", F.sum("sum").over(Window.partitionBy("source").orderBy("part")) - F.col("sum")
    ).withColumnRenamed("source", "_source")
    placed = rows.withColumn("part", part).join(
        parts.withColumnRenamed("part", "_part"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part"))
    )
    within = Window.partitionBy("source", "part").orderBy("hash", "doc_id", "size", "row")
    placed = placed.withColumn("begin", F.col("before") + F.sum("size").over(within) - F.col("size"))
    aimed = placed.select("row", "doc_id", "source", "size", "begin").join(
        aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    )
    # Where a document lies on the repeated line, and the blocks that it touches there.
    begin = F.col("begin") + F.col("pass") * F.col("source_size")
    lying = (
        aimed.where("size > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(settings.passes - 1))))
        .withColumns({"begin": begin, "until": F.least(begin + F.col("size"), F.col("words"))})
        .where("begin < until")
        .select("row", "pass", "n", "begin", "until")
        .withColumn(
            "rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("until") - 1) / block)))
        )
    )
    pieces = F.least(F.col("until"), (F.col("rank") + 1) * block) - F.greatest(F.col("begin"), F.col("rank") * block)
    drawn = lying.withColumn("words", pieces).join(schedule(wanted, int(slots)), ["n", "rank"])
    return aimed, drawn.select("row", "pass", "slot", "words")
