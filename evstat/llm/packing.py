"""Operator 1: packing along a space-filling curve.

1. Tasks tokenise each document, hash its tokens into a signed count vector,
   project that to a few dimensions and take the Hilbert key of the point.
2. ``(key, row, length)`` alone is range-sorted by key; running lengths within
   the ranges plus the ranges' totals give every document its place in one
   long stream, in which neighbours on the curve lie next to each other.
3. The stream is cut every ``width`` tokens.  Documents are joined with their
   places and cut where the stream is, so only the last sequence is padded.

A hot key (copies have the same point) is split by the row number.  The token
ids are written once and shuffled once.

Cases: a null or empty text is the closing id alone; a text of any length is
cut freely; repeated rows are packed each; no rows give no rows; a null
``doc_id`` stays null; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evstat.llm.common import materialise, mix, task_partitions

WIDTH = 1024
END_ID = 0
BUCKETS = 256     # of the hashed document vector
DIMS = 4          # of the projected point
BITS = 15         # of each coordinate: DIMS * BITS bits of key
CACHE = 400_000   # word pieces remembered by one worker


# ---------------------------------------------------------------- tokens

class Tokens:
    """Ids of a byte-level BPE vocabulary, as little-endian unsigned 16-bit bytes.

    A token of this vocabulary never reaches over the start of a white-space
    run, so texts are cut before single spaces and the pieces' ids are
    remembered.  Texts where that does not hold (three white-space characters
    around a space, or an added token's own text) go whole to the tokenizer
    of the vocabulary file.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # byte-level vocabularies write bytes as printable characters
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encode = tiktoken.Encoding("pieces", pat_str=words, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.odd = regex.compile(r"\s (?:\s|\Z)|" + "|".join(regex.escape(a) for a in sorted(added)))
        self.pieces: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        got = self.pieces.get(text)
        if got is None:
            got = np.array(self.encode(text), dtype="<u2").tobytes()
            if len(self.pieces) < CACHE:
                self.pieces[text] = got
        return got

    def __call__(self, text: str) -> bytes:
        if self.odd.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
        first, *rest = text.split(" ")
        known, piece = self.pieces.get, self.piece
        out = [piece(first)] if first else []
        for w in rest:
            w = " " + w
            out.append(known(w) or piece(w))
        return b"".join(out)


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


# ---------------------------------------------------------------- points on the curve

def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer points (one a row) on the Hilbert curve of ``bits`` bits a
    coordinate: reflect and exchange the axes from the highest bit down, then read
    the Gray code of the interleaved bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection(buckets: int, dims: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((buckets, dims)).astype(np.float32)


def _buckets(ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.uint64))
    return (h % np.uint64(buckets)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32)


def curve_keys(vectors: np.ndarray, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of hashed count vectors (one a row)."""
    v = np.sign(vectors) * np.sqrt(np.abs(vectors))
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    p = (v / np.maximum(norm, 1e-9)) @ _projection(v.shape[1], dims)
    cell = np.clip((np.tanh(p) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1)
    return hilbert_keys(cell.astype(np.int64), bits)


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        bucket, sign = _buckets(np.arange(65_536), BUCKETS)
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [tokens(t or "") + end for t in part.column(1).to_pylist()]
                vectors = np.zeros((len(ids), BUCKETS), np.float32)
                for i, b in enumerate(ids):
                    a = np.frombuffer(b, "<u2")
                    vectors[i] = np.bincount(bucket[a], weights=sign[a], minlength=BUCKETS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(b) // 2 for b in ids], pa.int64()),
                     pa.array(curve_keys(vectors))], names=["doc_id", "ids", "n", "curve"])
    return run


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running lengths inside one sorted range."""
    total = 0
    for b in batches:
        n = b.column(1).to_numpy()
        end = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(end - n), b.column(2)],
                                         names=["row", "n", "start_in_range", "range"])
        total = int(end[-1]) if len(end) else total


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            place, n = at["place"].to_numpy(), at["n"].to_numpy()
            first, last = place // width, (place + n - 1) // width
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            lo, hi = np.maximum(place[row], seq * width), np.minimum(place[row] + n[row], (seq + 1) * width)
            start = lo - place[row]
            ids, crc, of = at["ids"], np.zeros(len(row), np.int64), -1
            for j, r in enumerate(row):
                if r != of:
                    doc, of = np.frombuffer(ids[int(r)].as_py(), "<u2").astype("<u4"), r
                crc[j] = zlib.crc32(doc[start[j]:start[j] + hi[j] - lo[j]])
            yield pa.RecordBatch.from_arrays(
                [at["doc_id"].take(pa.array(row)), pa.array(start), pa.array(hi - lo), pa.array(crc),
                 pa.array(n[row]), pa.array(seq), pa.array(lo - seq * width)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *,
         width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.  ``tokenizer`` names a vocabulary file that every
    executor has at that path."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _tokenise(tokenizer, end_id), f"doc_id {kind}, ids binary, n long, curve long")
    tokens = materialise(tokens.withColumn("row", F.monotonically_increasing_id()), "pack-tokens")

    ranged = (tokens.select("row", "n", "curve")
              .repartitionByRange(task_partitions(spark), "curve", "row").sortWithinPartitions("curve", "row")
              .select("row", "n", F.spark_partition_id().cast("long").alias("range"))
              .mapInArrow(_starts, "row long, n long, start_in_range long, range long"))
    ranged = materialise(ranged, "pack-ranges")
    # one row a range: as many as shuffle partitions
    totals = ranged.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()
    before, rows = 0, []
    for t in totals:
        rows.append((t["range"], before))
        before += t["n"]
    offsets = spark.createDataFrame(rows, "range long, before long")
    places = (ranged.join(F.broadcast(offsets), "range")
              .select("row", (F.col("before") + F.col("start_in_range")).alias("place")))
    return (tokens.select("row", "doc_id", "ids", "n").join(places, "row")
            .select("doc_id", "ids", "n", "place")
            .mapInArrow(_cut(width), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                     "sequence_id long, offset long"))
