import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tierlake.llm import packing

PATH = packing._public_vocabulary()


def expected(text):
    return np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


def check(df):
    """Every id of every row lies in one piece, sequences are gapless and short enough; returns padding and sequences."""
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    whole = defaultdict(list)
    tokenizer = Tokenizer.from_file(PATH)
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        whole[doc].append(ids.tobytes())
    pieces, places = defaultdict(list), defaultdict(list)
    for p in packing.pack(packing.tokens(df)).collect():
        assert p.length * 4 == len(p.ids) and zlib.crc32(p.ids) == p.ids_crc32
        pieces[p.doc_id].append((p.start, bytes(p.ids), p.doc_tokens))
        places[p.sequence_id].append((p.offset, p.length))
    for doc, texts in whole.items():
        # Repeated ids: the pieces of each length of document must make up as many documents.
        for size in {len(t) // 4 for t in texts}:
            same = [t for t in texts if len(t) // 4 == size]
            assert sum(len(i) for _, i, n in pieces[doc] if n == size) == sum(map(len, same))
            if len(set(same)) == 1:
                for start, ids, n in pieces[doc]:
                    assert n != size or same[0][4 * start : 4 * start + len(ids)] == ids
    lean = Counter(tuple(r) for r in packing.pack_documents(df).collect())
    assert lean == Counter(tuple(r) for r in packing.pack(packing.tokens(df)).drop("ids").collect())
    used = 0
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 2048
        used += at
    return 2048 * len(places) - used, len(places)


def test_whole_table(documents):
    padding, sequences = check(documents)
    assert padding < 2048 * 8


def test_odd_rows(odd):
    check(odd)


def test_empty(empty):
    assert packing.pack(packing.tokens(empty)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aZ'stre 0.é́ıİſẞ中|<>endoftextΣς\n\x85", max_size=40))
def test_chunks_give_the_tokenizers_ids(text):
    encoder = packing._encoder(PATH)
    try:
        raw = text.encode()
    except UnicodeEncodeError:
        return
    assert encoder.ids(raw) == expected(text)[:-1].tobytes()


def test_special_tokens_inside_words():
    for text in ("a<|endoftext|>b", "<|startoftext|> x", "<|ENDOFTEXT|>"):
        assert packing._encoder(PATH).ids(text.encode()) == expected(text)[:-1].tobytes()


def plain(lengths, cap, cost):
    """The method spelled out: descending lengths, lowest cost with room, else cut into the largest room."""
    rows = [[0.0, cap] for _ in range(-(-sum(lengths) // cap))]
    out = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        start, n = 0, lengths[k]
        while n:
            fit = [r for r in range(len(rows)) if rows[r][1] >= n]
            r = min(fit, key=lambda r: rows[r][0]) if fit else max(range(len(rows)), key=lambda r: rows[r][1])
            piece = min(n, rows[r][1])
            out.append((k, start, piece, r, cap - rows[r][1]))
            rows[r][1] -= piece
            rows[r][0] += cost(piece)
            start, n = start + piece, n - piece
    return out


@pytest.mark.parametrize("seed", range(5))
def test_balance(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 200).tolist()
    own = packing.Settings(length=64, linear=10.0, quadratic=2.0)
    assert packing.balance(lengths, own) == plain(lengths, 64, lambda n: 10.0 * n + 2.0 * n * n)


def test_balance_of_nothing():
    assert packing.balance([], packing.Settings()) == []
