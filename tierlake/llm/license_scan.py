"""License scans: ordered signature rules behind a keyword gate, with containment and priority among detections."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlake.session import materialise

# What parts words, before A-Z is lower-cased; and the base phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_SCORE = 0.5


@dataclass(frozen=True)
class Rule:
    """A signature over words joined by single spaces: it is tried on texts that contain the keyword."""

    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


# Licenses by label: their names in words, a closing "licen" standing for license and licence, and the versions.
NAMED = {
    "apache": (("apache licen", "apache software licen", "apache public licen"), ("1 0", "1 1", "2 0")),
    "gpl": (("gpl", "general public licen"), ("1 0", "2 0", "2 1", "3 0")),
    "lgpl": (("lgpl", "lesser general public licen", "library general public licen"), ("2 0", "2 1", "3 0")),
    "agpl": (("agpl", "affero general public licen"), ("1 0", "3 0")),
    "fdl": (("gfdl", "fdl", "free documentation licen"), ("1 1", "1 2", "1 3")),
    "mpl": (("mpl", "mozilla public licen"), ("1 0", "1 1", "2 0")),
    "epl": (("epl", "eclipse public licen"), ("1 0", "2 0")),
    "cddl": (("cddl", "common development and distribution licen"), ("1 0", "1 1")),
    "cpl": (("cpl", "common public licen"), ("0 5", "1 0")),
    "eupl": (("eupl", "european union public licen"), ("1 0", "1 1", "1 2")),
    "afl": (("academic free licen",), ("1 1", "2 0", "3 0")),
    "osl": (("open software licen",), ("1 0", "2 0", "3 0")),
    "artistic": (("artistic licen",), ("1 0", "2 0")),
    "bsl": (("boost software licen",), ("1 0",)),
    "ofl": (("open font licen",), ("1 0", "1 1")),
    "odbl": (("odbl", "open database licen"), ("1 0",)),
    "zpl": (("zope public licen",), ("1 1", "2 0", "2 1")),
    "lppl": (("latex project public licen",), ("1 0", "1 2", "1 3")),
    "psf": (("python licen", "python software foundation licen"), ("2 0", "3 0")),
    "php": (("php licen",), ("3 0", "3 01")),
    "mit": (("mit licen", "expat licen", "x11 licen"), ()),
    "isc": (("isc licen",), ()),
    "zlib": (("zlib licen", "zlib libpng licen"), ()),
    "unlicense": (("unlicense",), ()),
    "wtfpl": (("wtfpl", "do what the fuck you want to public licen"), ()),
    "bsd": (("bsd licen", "bsd style licen"), ()),
    "ncsa": (("ncsa open source licen", "university of illinois open source licen"), ()),
    "ms-pl": (("microsoft public licen",), ()),
    "ms-rl": (("microsoft reciprocal licen",), ()),
    "postgresql": (("postgresql licen",), ()),
}
# Words that may come before a name: they widen the detection.
LEADING = r"(?:gnu |the |sil |(?:2|3|4|two|three|four) clause )?"
# Creative Commons: the parts of a licence and its versions.
COMMONS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
COMMONS_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:atives|s)", "nc": "non ?commercial"}
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Sentences of licence texts and of reserved rights, each with its label, keyword and score.
SENTENCES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("isc", "permission to use copy", r"permission to use copy modify and(?: or)? distribute this software for any purpose", 0.9),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification", 0.95),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it", 0.9),
    ("zlib", "as is", r"this software is provided as is without any express or implied warranty in no event", 0.8),
    ("wtfpl", "you just do", r"you just do what the fuck you want to", 0.9),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 0.95),
    ("public-domain", "public domain", r"(?:dedicated|released|placed) (?:in|into|to) the public domain", 0.8),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.9),
    ("cc0", "no rights reserved", r"no rights reserved", 0.7),
    ("some-reserved", "some rights reserved", r"some rights reserved", 0.7),
    ("reserved", "all rights reserved", r"all rights(?: are)? reserved(?: worldwide)?", 0.6),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 0.5),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)", 0.8),
    ("proprietary", "may not be", r"may not be (?:reproduced|copied|redistributed)(?: or (?:reproduced|copied|redistributed))? without", 0.7),
)


def _version(words: str) -> str:
    """A version as words: a zero at the end may be left out."""
    number = words.removesuffix(" 0")
    rest = "(?: 0)?" if number != words else ""
    return rf"(?: (?:version|ver))?(?: v)?(?: |(?<=v)){number}{rest}"


def _named(label: str, written: str, versions: tuple[str, ...]) -> list[Rule]:
    """Rules of one name: notices come before plain names, versions before names without one."""
    open_end = written.endswith("licen")
    keyword = f" {written}" if open_end else f" {written} "
    name = LEADING + written + "[cs]e" * open_end
    notice = r"(?:licen[cs]ed|released|distributed|available|published) under (?:(?:the )?terms of )?(?:the |an? )?"
    rules = []
    for version in (*versions, None):
        full = name + (_version(version) if version else "")
        tag = f"{label}-{version.replace(' ', '.')}" if version else label
        rules.append(Rule(tag, keyword, notice + full, 40 + 10 * bool(version), 0.95 if version else 0.85))
        rules.append(Rule(tag, keyword, full, 20 + 10 * bool(version), 0.9 if version else 0.75))
        if version:
            rules.append(Rule(tag, keyword, full + r" (?:or|and)(?: any)? later(?: versions?)?", 35, 0.9))
    return rules


def _glued(label: str, written: str, versions: tuple[str, ...]) -> list[Rule]:
    """Rules of a short name with its version in one word, such as GPLv3 and LGPLv2.1."""
    notice = r"(?:licen[cs]ed|released|distributed|available|published) under (?:(?:the )?terms of )?(?:the |an? )?"
    found = []
    for version in versions:
        number = version.removesuffix(" 0")
        full = rf"{LEADING}{written}v?{number}" + "(?: 0)?" * (number != version)
        tag, keyword = f"{label}-{version.replace(' ', '.')}", f" {written}"
        found.append(Rule(tag, keyword, notice + full, 50, 0.95))
        found.append(Rule(tag, keyword, full, 30, 0.9))
        found.append(Rule(tag, keyword, full + r" (?:or|and)(?: any)? later(?: versions?)?", 35, 0.9))
    return found


def rules() -> list[Rule]:
    """All signatures in their order, the first of equal priority before the rest."""
    found = []
    for label, (names, versions) in NAMED.items():
        for written in names:
            found += _named(label, written, versions)
            if " " not in written:
                found += _glued(label, written, versions)
        found.append(Rule(label, " spdx licen", rf"spdx licen[cs]e identifier {label.replace('-', ' ')}(?: [0-9]+)*(?: only| or later)?", 60, 1.0))
    for parts, version in product(COMMONS, COMMONS_VERSIONS):
        words = " ".join(COMMONS_WORDS[p] for p in parts.split())
        tag = f"cc-{parts.replace(' ', '-')}"
        number = _version(version)
        found.append(Rule(f"{tag}-{version.replace(' ', '.')}", f" cc {parts}", rf"(?:licen[cs]ed under )?(?:a )?cc {parts}{number}", 50, 0.95))
        found.append(
            Rule(f"{tag}-{version.replace(' ', '.')}", "creative commons", rf"creative commons {words}{number}(?: international| unported| generic)?(?: licen[cs]e)?", 50, 0.95)
        )
    for parts in COMMONS:
        words = " ".join(COMMONS_WORDS[p] for p in parts.split())
        found.append(Rule(f"cc-{parts.replace(' ', '-')}", f" cc {parts} ", rf"cc {parts}", 25, 0.8))
        found.append(Rule(f"cc-{parts.replace(' ', '-')}", "creative commons", rf"creative commons {words}(?: licen[cs]e)?", 25, 0.85))
    found += [Rule(label, keyword, pattern, 10, score) for label, keyword, pattern, score in SENTENCES]
    return sorted(found, key=lambda r: -r.priority)


def normal(text: Column) -> Column:
    """The words of a text, each between single spaces; one space if there are none."""
    joined = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " "))
    return F.when(joined == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _whole(pattern: str) -> str:
    """A pattern for whole words; without a flag for Unicode, case is ignored for A-Z only."""
    return f"(?i)(?<= )(?:{pattern})(?= )"


def _settled(df: DataFrame) -> DataFrame:
    """The same rows; the columns so far are computed once here, not anew wherever a later expression names them."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _kept(kept: Column, s: Column) -> Column:
    """The kept spans and, if it overlaps none of them, one more."""
    clash = F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))


def scan(docs: DataFrame, signatures: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score` for every row's whole text.

    The base phrases count wherever their words stand in a row. The signatures add labels. A text is tried with the
    signatures whose keyword it contains.
    Detections are spans of the normalised text. One that lies within another goes (of equal spans the one of lower
    priority); of the others those stay, by falling priority, that overlap none of those that stay already. `score` is the best among what is left, the
    base phrases included, and 0 without any.

    Null and empty texts have no words, no labels ("") and score 0. Rows that repeat, also in their id, or have no id
    are scanned each. Other columns are ignored. An empty table gives no rows. Detections are ordered in one window
    for each text, which is bounded by the text.
    """
    signatures = rules() if signatures is None else signatures
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), normal(F.col(text)).alias("norm"), F.monotonically_increasing_id().alias("row")
    )
    rows = _settled(_settled(rows).withColumn("low", F.lower("norm")))

    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        pieces = F.when(F.col("low").contains(f" {phrase} "), F.split("norm", _whole(phrase)))
        counts.append(F.coalesce(F.size(pieces) - 1, F.lit(0)))
        firsts.append(_spaces(F.element_at(pieces, 1)) - 1)
        lasts.append(_spaces(F.col("norm")) - _spaces(F.element_at(pieces, -1)) - len(phrase.split()))
        labels.append(F.when(pieces.isNotNull() & (F.size(pieces) > 1), F.lit(label)))
    base = rows.select(
        "row",
        "doc_id",
        "norm",
        "low",
        F.greatest(_spaces(F.col("norm")) - 1, F.lit(0)).cast("long").alias("n_words"),
        sum(counts, F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base_labels"),
    )

    # The table of signatures stays one constant column; of a text's signatures only lengths are kept.
    keywords = sorted({s.keyword for s in signatures})
    table = F.array(
        *(
            F.struct(F.lit(k).alias("rule"), F.lit(keywords.index(s.keyword)).alias("keyword"), F.lit(_whole(s.pattern)).alias("pattern"))
            for k, s in enumerate(signatures)
        )
    )
    gate = F.array(*(F.col("low").contains(k) for k in keywords))
    hits = F.filter(
        F.transform(
            F.filter(table, lambda r: F.element_at(F.col("gate"), r["keyword"] + 1)),
            lambda r: F.struct(
                r["rule"].alias("rule"),
                F.transform(F.regexp_extract_all("norm", r["pattern"], F.lit(0)), lambda m: F.length(m)).alias("lengths"),
                F.transform(F.split("norm", r["pattern"]), lambda p: F.length(p)).alias("gaps"),
            ),
        ),
        lambda h: F.size(h["lengths"]) > 0,
    )
    gated = _settled(base.withColumn("gate", gate).drop("low"))
    found = gated.withColumn("hits", F.when(F.array_contains("gate", True), hits)).drop("norm", "gate")
    found = materialise(spark, found, "licenses")

    spans = found.select("row", F.explode("hits").alias("hit")).select(
        "row", "hit.rule", F.posexplode(F.arrays_zip(F.col("hit.gaps").alias("gap"), F.col("hit.lengths").alias("length"))).alias("k", "span")
    )
    spans = spans.where("span.length is not null").select("row", "rule", "k", "span.gap", "span.length")
    along = Window.partitionBy("row", "rule").orderBy("k")
    spans = spans.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(along))
    spans = spans.withColumn("start", F.col("end") - F.col("length"))
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "rule")
    covered = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    outer = spans.withColumn("covered", covered).where("covered is null or covered < end")
    # Signatures are numbered by falling priority, and what is left has rising starts and ends.
    opens = F.when(F.lag("end").over(order) > F.col("start"), 0).otherwise(1)
    runs = outer.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("rule", "start", "end")))
    runs = runs.groupBy("row", "run").agg(ordered.alias("ordered"))
    kept = F.when(F.size("ordered") == 1, F.col("ordered")).otherwise(F.aggregate("ordered", F.slice("ordered", 1, 0), _kept))
    kept = runs.select("row", F.explode(F.transform(kept, lambda s: s["rule"])).alias("rule"))
    names = F.array(*(F.lit(s.label) for s in signatures))
    scores = F.array(*(F.lit(s.score) for s in signatures))
    kept = kept.groupBy("row").agg(
        F.collect_set(F.element_at(names, F.col("rule") + 1)).alias("more"), F.max(F.element_at(scores, F.col("rule") + 1)).alias("best")
    )
    out = found.drop("hits").join(kept, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))), ","
        ).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0)).alias("score"),
    )
