"""Operator 13: BPE encoding and decoding with a segment tree over pair ranks.

The vocabulary file is the tokenizers library's: NFC and lower case, pieces by the
file's pattern, UTF-8 bytes as letters, an end-of-word mark, and merges by rank.
Texts are cut into pieces as that file says.  A piece's adjacent pairs are the
leaves of a segment tree whose nodes hold the least ``(rank, position)`` below
them: the root is the leftmost lowest-rank merge; applying it changes at most three
leaves, each a logarithmic update; no mergeable pair is left when the root is
infinite.  So a piece of n symbols costs O(n log n), whatever its length.

Beyond Latin letters, normal forms and the classes of letters and numbers are the
library's own, as its Unicode version differs from Python's.

A Python worker remembers the ids of up to ``REMEMBERED`` short pieces.  Ids and texts are columns
of arrays and strings; nothing leaves the row.

Cases: a null or empty text has no ids and decodes to the empty string; the
special tokens' strings in a text are those tokens, found before normalisation; texts are
read whole, in slices of ``SLICE`` pieces; other columns pass through, an existing
output column is replaced; empty tables stay empty.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

REMEMBERED = 1_000_000    # some 200 bytes each
SHORT = 32              # letters of a piece that is worth remembering
SLICE = 1 << 16         # pieces; letters of a text whose pieces are listed at once


class SegmentTree:
    """Least value over point-updated leaves; the root is ``nodes[1]``."""

    def __init__(self, leaves: list[int], infinite: int):
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.nodes = nodes = [infinite] * self.size + leaves + [infinite] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            x, y = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = x if x < y else y

    def update(self, leaf: int, value: int) -> None:
        nodes, i = self.nodes, leaf + self.size
        nodes[i] = value
        while i > 1:
            other = nodes[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if nodes[i] == value:
                return
            nodes[i] = value


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_LATIN = [*range(0x250), *range(0x2010, 0x2028), 0x20AC]
_BEYOND_LATIN = re.compile("[^\x00-\u024F\u2010-\u2027\u20AC]")
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _library_normal(text: str) -> str:
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)


def _spelt_out(pattern: str, classes: dict[str, list[int]]) -> re.Pattern:
    """The pattern with its classes, which it only names inside brackets, as ranges of code points."""
    for name, points in {**classes, "s": None}.items():
        inside = _SPACE
        if points is not None:
            ends = [i for i in range(len(points)) if i + 1 == len(points) or points[i + 1] != points[i] + 1]
            starts = [0, *[i + 1 for i in ends[:-1]]]
            inside = "".join(f"\\U{points[i]:08x}-\\U{points[j]:08x}" for i, j in zip(starts, ends, strict=True))
        pattern = pattern.replace(r"\s" if name == "s" else rf"\p{{{name}}}", inside)
    return re.compile(pattern)


@lru_cache(maxsize=4)
def _latin(pattern: str) -> re.Pattern:
    """For texts of Latin letters only: what they normalise to, classed by this module's tables."""
    chars = sorted({x for c in _LATIN for x in unicodedata.normalize("NFC", chr(c)).lower()})
    return _spelt_out(pattern, {k: [ord(c) for c in chars if unicodedata.category(c)[0] == k] for k in "LN"})


@lru_cache(maxsize=4)
def _any_script(pattern: str) -> re.Pattern:
    """For all texts: the library's classes of letters and numbers."""
    from tokenizers import Regex, pre_tokenizers

    classes: dict[str, list[int]] = {}
    for name in "LN":
        split = pre_tokenizers.Split(Regex(rf"\p{{{name}}}"), "removed", invert=True)
        whole = ("".join(chr(c) for c in range(lo, lo + 0x800)) for lo in range(0, 0x110000, 0x800) if lo != 0xD800)
        classes[name] = [ord(x) for part in whole for x, _ in split.pre_tokenize_str(part)]
    return _spelt_out(pattern, classes)


class Encoder:
    """Reads a vocabulary file of the kind the docstring names."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = (model["type"] == "BPE" and end and steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
                 and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
                 and not any(model[k] for k in ("continuing_subword_prefix", "byte_fallback", "unk_token", "ignore_merges")))
        if not known:
            raise ValueError(f"{path}: not a word-end BPE file of the supported kind")
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.pattern = cuts[0]["pattern"]["Regex"]
        self.latin = _latin(self.pattern)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.special_id = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + end] for b in range(256)]
        self.shift = max(vocab.values()).bit_length()
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[x] << self.shift | vocab[y]] = r
            self.merged.append(vocab[x + y])
        self.strings = pa.array([self.names.get(i) for i in range(max(self.names) + 1)])
        if self.strings.null_count:
            raise ValueError(f"{path}: ids with gaps")
        self.recent: dict[str, bytes] = {}      # ids of pieces as 32-bit numbers, in two halves: a full one becomes the older
        self.older: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Applies merges, leftmost of the lowest rank first, until none is left."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank, merged, shift = self.rank.get, self.merged, self.shift
        infinite = len(merged) * n
        value = lambda x, y, at: infinite if (r := rank(x << shift | y)) is None else r * n + at
        tree = SegmentTree([value(symbols[i], symbols[i + 1], i) for i in range(n - 1)], infinite)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        nodes = tree.nodes
        while (least := nodes[1]) < infinite:
            r, at = divmod(least, n)
            gone = after[at]                       # the pair is (at, gone); ``at`` takes the merged symbol
            symbols[at], symbols[gone] = merged[r], -1
            after[at] = nxt = after[gone]
            if gone < n - 1:
                tree.update(gone, infinite)
            if nxt < n:
                before[nxt] = at
                tree.update(at, value(symbols[at], symbols[nxt], at))
            else:
                tree.update(at, infinite)
            if (prev := before[at]) >= 0:
                tree.update(prev, value(symbols[prev], symbols[at], prev))
        return [s for s in symbols if s >= 0]

    def piece_ids(self, piece: str) -> list[int]:
        data = piece.encode()
        inner = self.inner
        return self.merge([inner[b] for b in data[:-1]] + [self.last[data[-1]]])

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of the text in NFC with each code point lowered, in lists of bounded length."""
        if _BEYOND_LATIN.search(text) is None:
            pattern, text = self.latin, unicodedata.normalize("NFC", text).lower()
        else:
            pattern, text = _any_script(self.pattern), _library_normal(text)
        if len(text) <= SLICE:
            yield pattern.findall(text)
        else:
            found = pattern.finditer(text)
            while part := [m[0] for m in islice(found, SLICE)]:
                yield part

    def _ids(self, piece: str) -> bytes:
        """The ids of a piece not in ``recent``: from the older half of the memory, or merged."""
        ids = self.older.get(piece) or np.array(self.piece_ids(piece), np.int32).tobytes()
        if len(piece) <= SHORT:
            if len(self.recent) >= REMEMBERED // 2:
                self.older, self.recent = self.recent, {}
            self.recent[piece] = ids
        return ids

    def _plain(self, text: str) -> Iterator[np.ndarray]:
        for part in self.pieces(text):
            recent, ids = self.recent.get, self._ids
            # a full memory changes places with an empty one meanwhile: then ``recent`` is the older half, still right
            yield np.frombuffer(b"".join([recent(p) or ids(p) for p in part]), np.int32)

    def encode(self, text: str | None) -> np.ndarray:
        parts: list[np.ndarray] = []
        at = 0
        for m in self.special.finditer(text or "") if self.special else ():
            parts += self._plain(text[at:m.start()])
            parts.append(np.array([self.special_id[m[0]]], np.int32))
            at = m.end()
        parts += self._plain((text or "")[at:])
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of a column of ids: the tokens' strings joined by one space (the file names no decoder)."""
        flat = ids.flatten()
        known = pc.and_kleene(pc.less_equal(0, flat), pc.less(flat, len(self.strings)))
        if flat.null_count or not pc.all(known).as_py():
            rows = [[i for i in row or () if i in self.names] for row in ids.to_pylist()]
            ids = pa.array(rows, pa.list_(pa.int32()))
            flat = ids.flatten()
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(at, self.strings.take(flat)), " ")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


TASK_TEXT = 4_000_000    # characters, or ids, of the rows that a task holds at once


def _slices(size: pa.Array) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most TASK_TEXT together (a larger row is a slice alone)."""
    total = np.concatenate([[0], np.cumsum(pc.fill_null(size, 0).to_numpy().astype(np.int64))])
    a = 0
    while a < len(size):
        b = min(len(size), max(a + 1, int(np.searchsorted(total, total[a] + TASK_TEXT, side="right")) - 1))
        yield a, b
        a = b


def _with_column(df: DataFrame, source: str, name: str, kind, size, values) -> DataFrame:
    """``df`` with column ``name`` of ``values(column source)``, by slices of rows of bounded size."""
    schema = StructType([f for f in df.schema.fields if f.name != name] + [StructField(name, kind)])
    keep = [i for i, f in enumerate(df.schema.fields) if f.name != name]
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(size(batch.column(at))):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), values(part.column(at))], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the array ``out`` of the token ids of ``text``."""
    def values(col: pa.Array) -> pa.Array:
        e = encoder(path)
        ids = [e.encode(t) for t in col.to_pylist()]
        at = np.cumsum([0, *map(len, ids)])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))

    return _with_column(df, text, out, ArrayType(IntegerType()), pc.utf8_length, values)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text ``out`` of the token ids ``ids``; null and unknown ids add nothing, a null array is empty."""
    return _with_column(df, ids, out, StringType(), pc.list_value_length, lambda col: encoder(path).decode(col))
