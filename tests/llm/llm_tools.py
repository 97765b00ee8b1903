"""What the tests of the training-data operators share."""

import re

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Rows that every operator on documents has to stand: nulls anywhere, no words, repeated rows and ids, long texts.
ODD = [
    (1, "the same words stand here again and again for a while", "en", "a", 50),
    (1, "the same words stand here again and again for a while", "en", "a", 50),
    (2, "the same words stand here again and again for a while", None, None, None),
    (2, "an other text with the id of its neighbour but with no word of it in the same place", "en", "b", 1),
    (3, "", "en", "a", 0),
    (4, None, "en", "a", None),
    (5, " \t\n ", "de", "b", 4),
    (6, "one two", "de", "b", 7),
    (7, "ONE  TWO", "de", "c", 8),
    (None, "a row without an id still has a text of some words", "en", "c", 1),
    (None, None, None, None, None),
    (8, "long " * 30_000 + "Straße Ünïcödé 中文 \U0001f600 İ K é", "en", "b", 1),
    (9, "1.1." * 20_000, "en", "b", 1),
    (10, "a@" * 20_000 + "b.c " + "7 " * 40_000, "en", "b", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASHING = ["row", "score", "size", "content", "bucket", "node", "kept", "key", "shard", "hits", "label", "begin", "rank"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
