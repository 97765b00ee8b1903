"""Cost-balanced packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are tokenised and handed on together.
ROWS = 512
#: White-space-free chunks of text, and parts of them, whose ids each Python worker remembers.
CACHED_CHUNKS = 300_000
CACHED_PARTS = 200_000

# How the vocabulary cuts lower-cased text, for ASCII and Latin letters with marks (U+00C0 to U+017F).
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-ſ]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-ſ]+")
# Chunks of these characters are cut by PARTS; all others go through the whole tokenizer.
PLAIN = re.compile("[\x21-\x7e\xc0-įĲ-ſ]*")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 is itself, the rest follows U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder(dict):
    """From a chunk of UTF-8 text without white space to its ids, as little-endian 32-bit bytes.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its chunks in a row, and
    most chunks are words that come again. Chunks of plain characters are cut into parts here and each part is merged
    by the tokenizer's model; every other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            ids = b"".join(map(self._part, PARTS.findall(text.lower())))
        else:
            ids = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) < CACHED_CHUNKS:
            self[chunk] = ids
        return ids

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            letters = part.encode().decode("latin-1").translate(self.letters)
            ids = _packed([t.id for t in self.tokenizer.model.tokenize(letters)])
            if len(self.parts) < CACHED_PARTS:
                self.parts[part] = ids
        return ids

    def ids(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if text else b""


def _packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def tokens(
    docs: DataFrame, path: str | None = None, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`doc_id, ids` for every row: the ids of the whole text and the end id, as little-endian unsigned 32-bit numbers.

    `path` is a tokenizer file that every executor finds; without it the installed public vocabulary is used. It must
    be of the kind of `word_bpe_49k.json` (see `Encoder`). Null and empty texts have the end id alone.
    """

    encoded = functools.partial(_encoded, path, end_id)
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(encoded, "doc_id long, ids binary")


def _encoded(path: str | None, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path or _public_vocabulary())
    last = end_id.to_bytes(4, "little")
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids = [encoder.ids(t.as_py()) + last for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])


def _public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Settings:
    """Sequence length, ids that one balancing round holds at most, and the cost of a piece of n ids: n*linear + n*n*quadratic."""

    length: int = 2048
    round_ids: int = 1 << 20
    linear: float = 2048.0
    quadratic: float = 1.0


def balance(lengths: list[int], settings: Settings) -> list[tuple[int, int, int, int, int]]:
    """Pieces `(document, start, length, sequence, offset)` of documents no longer than a sequence.

    As few sequences as can hold all ids are open. Documents come in descending length; each goes to the sequence of
    lowest cost among those with room. One that fits nowhere any more is cut to fill the rooms left, largest first.
    """
    sequences = -(-sum(lengths) // settings.length)
    cost, room = np.zeros(sequences), np.full(sequences, settings.length)
    found = []
    for document in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        start, n = 0, lengths[document]
        while n:
            fits = room >= n
            row = int(np.where(fits, cost, np.inf).argmin() if fits.any() else room.argmax())
            piece = min(n, int(room[row]))
            found.append((document, start, piece, row, settings.length - int(room[row])))
            room[row] -= piece
            cost[row] += piece * settings.linear + piece * piece * settings.quadratic
            start, n = start + piece, n - piece
    return found


def _pack(settings: Settings, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = iter(range(TaskContext.get().partitionId() << 40, 1 << 62))
    width = 4 * settings.length
    held: list[tuple[int | None, int, bytes, int]] = []  # document, start, ids, ids of the document

    def flush() -> pa.RecordBatch:
        rows = balance([len(ids) // 4 for _, _, ids, _ in held], settings)
        names = {s: next(numbers) for s in sorted({r[3] for r in rows})}
        out = []
        for k, start, n, sequence, offset in rows:
            doc, first, ids, total = held[k]
            out.append((doc, first + start, ids[4 * start : 4 * (start + n)], total, names[sequence], offset))
        held.clear()
        return _batch(out, with_ids)

    size = 0
    for batch in batches:
        full = []
        for doc, ids in zip(batch.column(0), batch.column(1)):
            doc, ids = doc.as_py(), ids.as_py()
            total, whole = len(ids) // 4, len(ids) // width
            for k in range(whole):
                full.append((doc, k * settings.length, ids[k * width : (k + 1) * width], total, next(numbers), 0))
            rest = ids[whole * width :]
            if rest:
                held.append((doc, whole * settings.length, rest, total))
                size += len(rest) // 4
            if size >= settings.round_ids:
                yield flush()
                size = 0
        if full:
            yield _batch(full, with_ids)
    if held:
        yield flush()


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc, start, ids, total, sequence, offset = zip(*rows)
    columns = [doc, start, [len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids], total, sequence, offset]
    arrays = [pa.array(c, pa.int64()) for c in columns] + ([pa.array(ids, pa.binary())] if with_ids else [])
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    return pa.RecordBatch.from_arrays(arrays, names=names)


def pack(ids: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pieces of the documents of `tokens`, each with its place: `sequence_id` and `offset`, and its ids.

    Every part of a document that fills a sequence gets one to itself. The rest of each document is balanced by cost
    within rounds of `round_ids` ids that lie in one partition, so nothing is shuffled and a task holds one round at a
    time. A round opens as few sequences as its ids need and cuts a document only when no sequence has room for it, so
    only the last ids of a round leave padding: less than one sequence.

    Sequence numbers begin with the partition's, so they are unique, and a repeated task gives the same numbers. Rows
    that repeat are packed each; rows without ids give no piece; an empty table gives no rows.
    """
    rows = ids.where("length(ids) > 0").select("doc_id", "ids")
    return rows.mapInArrow(functools.partial(_pack, settings, True), PIECES + ", ids binary")


def pack_documents(
    docs: DataFrame,
    settings: Settings = Settings(),
    path: str | None = None,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`tokens` and `pack` in one pass of one Python worker for each task, without the ids themselves.

    Null and empty texts are one piece of the end id. Columns of `docs` other than the id and the text are ignored.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack(settings, False, _encoded(path, end_id, batches))

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(both, PIECES)
