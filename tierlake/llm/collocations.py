"""Phrase collocations by stripes: every prefix keys a counter of the words that follow it.

A stripe is a row `lang, prefix, part` with the words that follow the prefix and how often. Tasks build stripes of their
own texts for prefixes of no word up to three; the shuffle brings the stripes of a prefix together, where they are
added element by element. From the added stripes follow all that is asked: an element of a prefix's stripe is the
frequency of the phrase, the sum of the stripe of no word is the number of words, and the largest element of a phrase's
own stripe is its most frequent extension. A stripe is cut into parts by the hash of the next word, so that a prefix
with very many followers is no single row, group or task.

A phrase can only be frequent if all shorter phrases in it are. So some passes go before the stripes: one counts all pairs
of neighbouring words, the next all phrases of three words whose two pairs are frequent, and so on. Phrases are counted by
46 bits of their hash, and the frequent ones marked in a bitmap of fixed size, which goes to all tasks. What meets no mark, and any
longer phrase with it, is left out of the stripes. That drops nothing that could be a candidate: phrases that share a hash
or a bit are only let through. If marks ever filled a bitmap, the stripes would hold more rows, which the least frequency
removes after they are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlake.llm.words import HASHES, windows
from tierlake.session import materialise

#: The byte that stands between pieces; it occurs in no UTF-8 text.
_MARK = b"\xff"
_PIECES = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", _MARK * 10)
#: Bytes of text that a task turns into stripes at a time, and rows it hands over at a time.
_HELD = 8 << 20
_ROWS = 1 << 15
#: Bits of a phrase's hash that choose its part, and the bits behind them that tell phrases of a part apart.
_PART_BITS, _REST_BITS = 14, 32
#: Phrases that a task adds up before it hands them over, or holds of one part before it adds them up.
_COUNTED = 1 << 21
#: Parts of a stripe by the number of words in its prefix.
_PARTS = (256, 256, 16, 16)
#: Copies of a single word's row that share the requests for it.
_SALTS = 16
# Scale of the score, and the share at which a longer phrase takes the place of a shorter one.
SCALE = 2_000_000
SHARE, OF = 80, 100


@dataclass(frozen=True)
class Settings:
    """Longest phrase in words, least frequency of a candidate, rows for each language, and bits of a screen."""

    longest: int = 4
    least: int = 30
    top: int = 2000
    screen_bits: int = 26

    def __post_init__(self):
        if not 2 <= self.longest <= len(_PARTS) or not _PART_BITS + 3 <= self.screen_bits <= _PART_BITS + _REST_BITS:
            raise ValueError("phrases have two to four words, and the screen 2^17 to 2^46 bits")


class _Ids(dict):
    """Numbers words in the order in which they come; the mark is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """`lang, ids, words` of some texts of one language at a time: word numbers in order, 0 between pieces and texts."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def numbered():
        for lang, texts in held.items():
            tokens = _MARK.join(texts).lower().translate(_PIECES).replace(_MARK, b" \xff ").split()
            ids = _Ids({_MARK: 0})
            yield lang, np.fromiter(map(ids.__getitem__, tokens), dtype=np.int64, count=len(tokens)), list(ids)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_py()
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= _HELD:
                    yield from numbered()
                    held, size = {}, 0
    yield from numbered()


def _hashes(lang: str, ids: np.ndarray, words: list[bytes]) -> np.ndarray:
    """A hash for each word, other ones in each language."""
    return (HASHES.of(words) ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))[ids]


def _marked(screen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = (keys >> np.uint64(64 - (len(screen).bit_length() + 2))).astype(np.int64)
    return (screen[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)


def _open(hashes: np.ndarray, ids: np.ndarray, screens: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of two up to `size` words at each place: their hash, and whether the screens let them pass.

    The screens are those of two words, of three, and so on; a phrase passes with all the shorter ones in it.
    """
    passes = ids != 0
    for words in range(2, size + 1):
        keys = windows(hashes, words)
        passes = passes[:-1] & passes[1:]
        if words - 2 < len(screens):
            passes = passes & _marked(screens[words - 2], keys)
        yield keys, passes


def _summed(keys: list[np.ndarray], counts: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each once, with the sum of its counts or `most`."""
    joined = np.concatenate(keys)
    order = np.argsort(joined)
    joined = joined[order]
    first = np.flatnonzero(np.append(True, joined[1:] != joined[:-1])) if len(joined) else np.zeros(0, dtype=np.int64)
    sums = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first) if len(first) else first
    return joined[first], np.minimum(sums, most).astype(np.uint8)


def next_screen(texts: DataFrame, screens: list[np.ndarray], settings: Settings) -> np.ndarray:
    """A bit for each range of hashes, set if a frequent phrase lies there: a fixed 8 MB for 2^26 bits.

    `screens` are those of two words, of three, and so on; the next one is for one word more. `texts` has `lang` and
    `text` as bytes. Tasks count phrases up to the least frequency (or 255, if that is less). The shuffle brings the
    counts of a part of all hashes together, which are added up phrase by phrase.
    """
    shared, size = texts.sparkSession.sparkContext.broadcast(screens), len(screens) + 2
    enough = min(settings.least, 255)
    slice_bits = settings.screen_bits - _PART_BITS

    def parted(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """A row for each part, with the rests of its phrases and their counts."""
        part = (keys >> np.uint64(_REST_BITS)).astype(np.int32)
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        offsets = np.append(begin, len(keys)).astype(np.int32)

        def column(values: np.ndarray) -> pa.Array:
            at = pa.py_buffer((offsets * values.itemsize).astype(np.int32))
            return pa.Array.from_buffers(pa.binary(), len(begin), [None, at, pa.py_buffer(values)])

        rest = keys.astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(part[begin], pa.int32()), column(rest), column(counts)], ["part", "phrases", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for lang, ids, words in _texts(batches):
            *_, (phrases, passes) = _open(_hashes(lang, ids, words), ids, shared.value, size)
            some, n = np.unique(phrases[passes] >> np.uint64(64 - _PART_BITS - _REST_BITS), return_counts=True)
            keys.append(some)
            counts.append(np.minimum(n, enough).astype(np.uint8))
            held += len(some)
            if held >= _COUNTED:
                yield parted(*_summed(keys, counts, enough))
                keys, counts, held = [], [], 0
        if held:
            yield parted(*_summed(keys, counts, enough))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits of each part; the rows of a part come one after another."""
        now, keys, counts, held = None, [], [], 0

        def bits() -> pa.RecordBatch:
            some, n = _summed(keys, counts, enough)
            marks = np.zeros(1 << slice_bits, dtype=bool)
            marks[some[n >= enough] >> np.uint32(_REST_BITS - slice_bits)] = True
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([np.packbits(marks).tobytes()], pa.binary())], ["part", "bits"]
            )

        for batch in batches:
            for part, phrases, n in zip(batch.column("part").to_pylist(), batch.column("phrases"), batch.column("counts")):
                if part != now:
                    if now is not None:
                        yield bits()
                    now, keys, counts, held = part, [], [], 0
                keys.append(np.frombuffer(phrases.as_py(), dtype=np.uint32))
                counts.append(np.frombuffer(n.as_py(), dtype=np.uint8))
                held += len(keys[-1])
                if held >= 2 * _COUNTED:
                    some, sums = _summed(keys, counts, enough)
                    keys, counts, held = [some], [sums], 0
        if now is not None:
            yield bits()

    counted = texts.mapInArrow(count, "part int, phrases binary, counts binary")
    met = counted.repartition("part").sortWithinPartitions("part")
    width = 1 << slice_bits - 3
    screen = np.zeros(width << _PART_BITS, dtype=np.uint8)
    for row in met.mapInArrow(add, "part int, bits binary").toLocalIterator():
        screen[row.part * width : (row.part + 1) * width] = np.frombuffer(row.bits, dtype=np.uint8)
    return screen


def local_stripes(texts: DataFrame, screens: list[np.ndarray], settings: Settings) -> DataFrame:
    """`lang, prefix, part, next, counts`: stripes of the texts that a task held together."""
    shared, longest = texts.sparkSession.sparkContext.broadcast(screens), settings.longest

    def rows(lang: str, prefixes, of: np.ndarray, following: np.ndarray, counts: np.ndarray, words, part_of, size: int):
        """Stripes from elements (rank of the prefix, next word, count), parted by the next word."""
        part = part_of[following] % _PARTS[size]
        order = np.lexsort((following, part, of))
        of, part, following, counts = of[order], part[order], following[order], counts[order]
        start = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (part[1:] != part[:-1])))
        for first in range(0, len(start), _ROWS):
            begin = start[first : first + _ROWS]
            until = start[first + _ROWS] if first + _ROWS < len(start) else len(of)
            offsets = pa.array(np.append(begin - begin[0], until - begin[0]), pa.int32())
            here = slice(begin[0], until)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(lang, pa.string()), len(begin)),
                    prefixes(of[begin]),
                    pa.array(part[begin], pa.int32()),
                    pa.ListArray.from_arrays(offsets, words.take(pa.array(following[here]))),
                    pa.ListArray.from_arrays(offsets, pa.array(counts[here], pa.int64())),
                ],
                ["lang", "prefix", "part", "next", "counts"],
            )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, listed in _texts(batches):
            if not ids.any():
                continue
            words = pa.array(listed, pa.binary())
            part_of = (HASHES.of(listed) >> np.uint64(20)).astype(np.int64) & 0xFFFF
            counts = np.bincount(ids, minlength=len(listed))[1:]
            seen = np.arange(1, len(listed))
            empty = lambda of: pa.repeat(pa.scalar(b"", pa.binary()), len(of))
            yield from rows(lang, empty, np.zeros(len(seen), dtype=np.int64), seen, counts, words, part_of, 0)
            # rank: the number of the phrase of `size` words that begins at a place.
            rank, prefixes = ids, words
            opened = _open(_hashes(lang, ids, listed), ids, shared.value, longest)
            for size, (_, passes) in enumerate(opened, start=1):
                places = np.flatnonzero(passes)
                if not len(places):
                    break
                elements, inverse, counts = np.unique(
                    rank[places] << 32 | ids[places + size], return_inverse=True, return_counts=True
                )
                of, following = elements >> 32, elements & 0xFFFFFFFF
                known = prefixes
                yield from rows(
                    lang, lambda of: known.take(pa.array(of)), of, following, counts, words, part_of, size  # noqa: B023
                )
                prefixes = pc.binary_join_element_wise(
                    known.take(pa.array(of)), words.take(pa.array(following)), pa.scalar(b" ", pa.binary())
                )
                rank = np.full(len(ids), -1, dtype=np.int64)
                rank[places] = inverse

    schema = "lang string, prefix binary, part int, next array<binary>, counts array<bigint>"
    return texts.mapInArrow(build, schema)


def added(stripes: DataFrame, settings: Settings) -> DataFrame:
    """`lang, prefix, part, total, followers`: stripes added element by element, with the followers that are frequent.

    The stripes of a prefix and part meet in one partition, where their elements are summed without a further shuffle.
    """
    met = stripes.repartition("lang", "prefix", "part")
    elements = met.select("lang", "prefix", "part", F.explode(F.arrays_zip("next", "counts")).alias("e"))
    summed = elements.groupBy("lang", "prefix", "part", F.col("e.next").alias("next")).agg(F.sum("e.counts").alias("f"))
    frequent = F.when(F.col("f") >= settings.least, F.struct(F.col("next").cast("string").alias("next"), "f"))
    return (
        summed.groupBy("lang", "prefix", "part")
        .agg(F.sum("f").alias("total"), F.collect_list(frequent).alias("followers"))
        .withColumn("prefix", F.col("prefix").cast("string"))
        .where((F.size("followers") > 0) | (F.col("prefix") == ""))
    )


def _wide(number: Column) -> Column:
    """A count as a decimal, so that its products are exact beyond 64 bits."""
    return number.cast("decimal(20,0)")


def collocations(
    docs: DataFrame, settings: Settings = Settings(), lang: str = "lang", text: str = "text"
) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: the strongest phrases of two to `longest` words of each language.

    Texts are lower-cased in A-Z and cut into pieces at `[.,;:!?\\x0A-\\x0D]`; words are `[^\\x20\\x09]+`. `a` is the
    frequency of a phrase within pieces, overlaps included. Cut after its first words it has parts of frequencies `l`
    and `r`, and scores floor(2000000 a / (l + r)); the cut that scores least counts, the first of equal ones. Phrases
    that lie in a longer frequent one with at least 80 % of their frequency are left out. `n` counts all words.

    A null or empty text has no words. A null language is `und`, together with texts that say so. Rows that repeat
    count each time, doc_id and other columns are ignored. Ties in the score go by frequency, then by the phrase's
    bytes. An empty table, or a language without frequent phrases, gives no rows.
    """
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")
    )
    screens: list[np.ndarray] = []
    for _ in range(2, settings.longest + 1):
        screens.append(next_screen(texts, screens, settings))
    stripes = added(local_stripes(texts, screens, settings), settings)
    return ranked(materialise(docs.sparkSession, stripes, "stripes"), settings)


def ranked(stripes: DataFrame, settings: Settings) -> DataFrame:
    """The collocations that follow from added stripes."""
    phrase = F.when(F.col("prefix") == "", F.col("e.next")).otherwise(F.concat_ws(" ", "prefix", "e.next"))
    grams = stripes.select("lang", F.explode("followers").alias("e"), "prefix").select(
        "lang", phrase.alias("phrase"), F.col("e.f").alias("f")
    )
    grams = grams.withColumn("words", F.split("phrase", " ", -1)).withColumn("size", F.size("words"))
    totals = stripes.where("prefix = ''").groupBy("lang").agg(F.sum("total").alias("n"))

    # The most frequent longer phrase: to the right it is in the phrase's own stripe, to the left in those that end so.
    # A phrase two words longer holds one that is one word longer and at least as frequent.
    to_right = stripes.where("prefix like '% %'").select(
        "lang", F.col("prefix").alias("phrase"), F.array_max(F.col("followers.f")).alias("longer")
    )
    tail = F.array_join(F.slice("words", F.lit(2), F.col("size") - 1), " ")
    to_left = grams.where("size > 2").select("lang", tail.alias("phrase"), F.col("f").alias("longer"))
    longer = to_right.unionByName(to_left).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    candidates = (
        grams.where("size > 1")
        .join(longer, ["lang", "phrase"], "left")
        .where(F.coalesce(_wide(F.col("longer")) * OF < _wide(F.col("f")) * SHARE, F.lit(True)))
        .select("lang", "phrase", F.col("f").alias("a"), "words", "size")
    )

    # Each part of each cut asks for its frequency. A single word may be asked for by very many phrases: its row is
    # copied, and the requests are dealt over the copies.
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    sides = F.array(
        F.struct(F.lit("l").alias("side"), F.slice("words", F.lit(1), F.col("cut")).alias("w")),
        F.struct(F.lit("r").alias("side"), F.slice("words", F.col("cut") + 1, F.col("size") - F.col("cut")).alias("w")),
    )
    asked = cuts.select("lang", "phrase", "a", "cut", F.explode(sides).alias("s"))
    salt = F.when(F.size("s.w") == 1, F.pmod(F.hash("phrase"), F.lit(_SALTS))).otherwise(0)
    asked = asked.select(
        "lang", "phrase", "a", "cut", F.col("s.side").alias("side"), F.array_join("s.w", " ").alias("part"), salt.alias("salt")
    )
    copies = F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = grams.where(F.col("size") < settings.longest).select(
        "lang", F.col("phrase").alias("part"), F.explode(copies).alias("salt"), "f"
    )
    answered = asked.join(known, ["lang", "part", "salt"])
    parted = answered.groupBy("lang", "phrase", "a", "cut").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r")
    )
    product = F.lit(SCALE).cast("decimal(10,0)") * _wide(F.col("a"))
    total = _wide(F.col("l")) + _wide(F.col("r"))
    score = F.call_function("div", product, total).cast("long")
    best = parted.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = (
        best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= settings.top)
    )
    return first.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
