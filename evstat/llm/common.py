"""Helpers shared by the operators of this folder: scratch tables, and vectorised
word hashing over Arrow string columns (used inside ``mapInArrow`` tasks)."""

from __future__ import annotations

import multiprocessing
import pickle
import traceback
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evstat.session import scratch_path

CHUNK_BYTES = 2_000_000   # text handled at once inside a task; bounds numpy memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, with which no column of ``df`` begins, whatever its case and leading underscores."""
    plain = lambda x: x.lower().lstrip("_")
    while any(plain(c).startswith(plain(name)) for c in df.columns):
        name = f"x{name}"
    return name


def any_rows(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with files that outlive any executor; every call has
    a folder of its own, so reruns never see another run's rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is written inside: for rows that
    are blocks of many kilobytes, of which a default batch would not fit a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def task_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- text buffers

def text_slices(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, bytes, offsets)`` for consecutive rows of a string
    column, at most ``limit`` bytes a slice (a longer text is a slice alone).
    Null counts as empty.  ``offsets`` has one entry more than rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return
    _, off_buf, data_buf = col.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


# ---------------------------------------------------------------- hashing

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit changes every output bit."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64) * np.uint64(7919)) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D            # odd, so it has an inverse modulo 2**64
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get("p")
    if have is None or len(have) < n:
        size = 1 << max(16, n.bit_length())
        for name, factor in (("p", _BASE), ("i", pow(_BASE, -1, 2 ** 64))):
            powers = np.full(size + 1, factor, np.uint64)
            powers[0] = 1
            _POW[name] = np.cumprod(powers)
    return _POW["p"], _POW["i"]


class RangeHash:
    """Hashes of many byte ranges of one buffer from a single running sum."""

    def __init__(self, data: np.ndarray):
        p, self.inv = _powers(len(data) + 1)
        self.sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * p[:len(data)], out=self.sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sum[end] - self.sum[start]) * self.inv[start]
        return mix(raw + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words ``[^\\x20\\x09-\\x0D]+`` of the texts laid end to end,
    and the first word of each text (one entry more than texts)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words inside a text: ``(hash, text, position of
    its first word)``.  Texts with fewer words have none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[width - 1:])
    h = np.zeros(len(at), np.uint64)
    for j in range(width):
        h = h * np.uint64(_BASE) + words[at + j]
    return mix(h), doc[at], at


def content_key(text: str = "text"):
    """Column that names a text by its content (null counts as empty)."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text_bytes: int,
                    doc_id: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """A bounded training sample ``y, h, text, lang``: of each label 1 and 0 the
    first ``rows / 2`` ids by hash.  Where their texts exceed ``text_bytes / 2`` together, the
    longest are left out, as few as that needs: one long text costs at most itself, and a label
    has no rows only if each of its chosen texts exceeds ``text_bytes / 2`` alone."""
    spread = F.xxhash64(F.col(doc_id).cast("string"), F.lit("train"))
    chosen = None
    for y in (1, 0):
        part = (labels.where((F.col(label) == y) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
                .agg(F.lit(y).alias("_y")).withColumn("_h", F.xxhash64(F.col("_id").cast("string"), F.lit("train")))
                .orderBy("_h", "_id").limit(rows // 2))
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most ``rows`` ids, so they travel to the documents and not the other way round
    picked = (docs.where(F.col(text).isNotNull()).join(F.broadcast(chosen), F.col(doc_id) == F.col("_id"))
              .select(F.col(text).alias("text"), F.col("_y").alias("y"), spread.alias("h"),
                      (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"),
                      F.octet_length(text).alias("size")))
    picked = (picked.withColumn("nr", F.row_number().over(Window.partitionBy("y").orderBy("h", "size", "text")))
              .where(F.col("nr") <= rows // 2))
    shortest = Window.partitionBy("y").orderBy("size", "nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = picked.withColumn("sum", F.sum("size").over(shortest)).where(F.col("sum") <= text_bytes // 2)
    return kept.select("y", "h", "text", "lang")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text",
                  lang: str | None = None, partitions: int | None = None) -> DataFrame:
    """Every training row ``y, h, text, lang, bytes``: the documents with a text, once for each label 1 or 0 of their id;
    ``h`` orders them by hash of the id, ``bytes`` is measured before the join, so sizes move no text.
    ``partitions``: both sides are dealt by id before the join, so a text moves once and the rows stay dealt."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
             .select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).distinct())
    read = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("id"), F.xxhash64(F.col(doc_id).cast("string"), F.lit("train")).alias("h"), F.col(text).alias("text"),
        (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"), F.octet_length(text).alias("bytes"))
    if partitions:
        read, known = read.repartition(partitions, "id"), known.repartition(partitions, "_id")
    return read.join(known, F.col("id") == F.col("_id")).select(F.col("_y").alias("y"), "h", "text", "lang", "bytes")


def _apart(work: Callable[[], bytes]) -> bytes:
    """``work`` in a child process, so that its memory goes with it and not to the worker that later tasks use."""
    context = multiprocessing.get_context("fork")
    here, there = context.Pipe(duplex=False)

    def child() -> None:
        try:
            there.send_bytes(b"+" + work())
        except BaseException:
            there.send_bytes(b"-" + traceback.format_exc().encode())

    process = context.Process(target=child)
    process.start()
    there.close()
    try:
        said = here.recv_bytes()
    except EOFError:
        said = b"-the training process ended"
    process.join()
    if said[:1] != b"+":
        raise RuntimeError(said[1:].decode())
    return said[1:]


def trained(sample: DataFrame, train: Callable[[list[dict]], Any]) -> Any:
    """``train`` on the rows of a bounded sample, label 1 first, then by hash and text.

    It runs in one task, so the driver holds neither the sample nor what training needs,
    and a lost executor costs a retry.  Only the model comes back.
    """
    order = lambda rows: sorted(rows, key=lambda r: (-r["y"], r["h"], r["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = order(r for batch in batches for r in batch.to_pylist())
        model = _apart(lambda: pickle.dumps(train(rows)))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([])
