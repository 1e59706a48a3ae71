"""Shared fixtures of the tests in this folder: hard rows and brute-force forms."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(20_000))
HARD_TEXTS = [
    None, "", " ", "\n\n", "one", "one two three four", "a b c d e f g", "a b c d e f g", "A  b\n c   d\t\te ",
    "l1 x y\nl1 x y\nl2\n l2\nl1 x y\n\n\n", "é ñ ü 漢字 😀 <|endoftext|> ok", "x\x01y\x02 token=abcdefgh \x01", LONG,
    "don't 'tis  they'll   we've\n \nend  ", "   x \x1c \x85y", "# * $ % & | < > a*b <|im_end|>",
]


def hard_rows():
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s0", None][i % 3], len(t or "")) for i, t in enumerate(HARD_TEXTS)]
    return rows + [rows[6], (None, "no id here at all", None, None, 17), (None, None, "en", "s1", None)]


def hard_docs(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")
