"""Operator 2: near-duplicate classes by DartMinHash.

A text is the bag of its runs of five words; the similarity of two texts is
the weighted Jaccard similarity of their bags, and texts of 0.8 or more are
linked.  Classes are the connected components of the links.

1. Equal texts are one content (md5); everything below works on contents.
2. DartMinHash: an element of weight w owns w unit regions.  Hashed darts
   fall on each region at the times of a Poisson process, each dart on one of
   ``k`` coordinates; the earliest dart of a coordinate over all regions is
   its minimum.  Darts after a time by which all coordinates are likely hit
   are never thrown (a bag with an empty coordinate gets twice the time), so
   the cost is the bag's size plus ``k log k``, not their product.
3. Bands of ``rows`` coordinates are bucket keys.  A content is first compared
   with the smallest member of all its buckets, one pair a content.  Then,
   round after round, only buckets that still hold different components go
   on: twice with a random leader each, taken from the bucket's largest
   component, at last with all members of different components, so that no
   candidate pair is left undecided unless its texts are already in one class.
   New links are merged between components, one node a component.  In that last round the pairs of small buckets
   are listed; large buckets are dealt out in blocks, a block meets a block in
   one row, and only links leave the task.
4. Candidates are compared exactly: their texts are read again, and only
   theirs are shuffled.

Cases: null and empty texts and texts of white space have no words and are
classes of their own, one a row; a text of one to four words is one element;
repeated rows and equal texts share a class; no rows give no rows; null ids
are allowed (a class is named by its smallest id; null if it has none); extra
columns pass through ``keep_one`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evstat.llm.common import (
    RangeHash, any_rows, content_key, fresh, materialise, mix, rows_per_batch, text_slices, window_hashes, word_bounds,
)
from evstat.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS = 40
SLICE_BYTES = 500_000    # of texts handled at once: numpy holds some 100 bytes for each
LISTED = 16   # members of a bucket up to which its open pairs are listed
BLOCK = 64    # members of a block
ROWS = 7      # coordinates a band: a pair at 0.8 shares no band with probability (1 - 0.8**7)**40 < 1e-4


def bag_units(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit regions ``(id, text)`` of all texts, ordered by text: the c-th copy of an
    element in a text is the unit (element, c)."""
    starts, ends, first = word_bounds(data, offsets)
    words = RangeHash(data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    h, doc, _ = window_hashes(words, first, width)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = count[short] > j
            whole[has] = mix(whole[has] + words[first[short][has] + j])
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    # text number and 40 bits of the element in one word: one plain sort groups a bag
    both = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    doc, h = (both >> np.uint64(40)).astype(np.int64), mix(both & np.uint64((1 << 40) - 1))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    run = np.flatnonzero(new)
    copy = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    return mix(h + copy.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)), doc


def dart_signatures(units: np.ndarray, doc: np.ndarray, n: int, k: int) -> np.ndarray:
    """``n x k`` ids of the earliest darts (0 in all coordinates of a text without units)."""
    best, sig = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    mass = np.bincount(doc, minlength=n)
    time = (k * np.log(k) + 2 * k) / np.maximum(mass, 1)
    todo = mass > 0
    while todo.any():
        pick = todo[doc]
        u, d = units[pick], doc[pick]
        limit, at, i = time[d], np.zeros(len(u)), 0
        while len(u):
            i += 1
            h = mix(u + np.uint64(i * 0xD1342543DE82EF95 % 2 ** 64))
            at = at - np.log(((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0 ** 53)
            hit = at <= limit
            u, d, at, limit, h = u[hit], d[hit], at[hit], limit[hit], h[hit]
            slot = d * k + (mix(h) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, slot, at)
            won = at == best[slot]
            sig[slot[won]] = h[won]
        todo &= np.isinf(best.reshape(n, k)).any(1)
        time = time * 2
    return sig.reshape(n, k)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(31) + sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = batch.column(0)
            # equal texts of a batch are computed once
            _, once = np.unique(np.asarray(cid.to_pylist(), dtype=object).astype(str), return_index=True)
            batch = batch.take(pa.array(np.sort(once)))
            for a, b, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                units, doc = bag_units(data, offsets, width)
                has = np.bincount(doc, minlength=b - a) > 0
                keys = band_keys(dart_signatures(units, doc, b - a, bands * rows), bands, rows)[has]
                lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * bands, keys.ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).filter(pa.array(has)), lists], names=["cid", "bands"])
    return run


def _bags(width: int):
    """Contents as sorted 32-bit unit ids, each content of a batch once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                units, doc = bag_units(data, offsets, width)
                units = units >> np.uint64(32)
                both = np.sort((doc.astype(np.uint64) << np.uint64(32)) | units)
                units = (both & np.uint64(0xFFFFFFFF)).astype("<u4")
                edge = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array([units[edge[i]:edge[i + 1]].tobytes() for i in range(b - a)], pa.binary())],
                    names=["uid", "bag"])
    return run


def _linked(similarity: float):
    """Keeps pairs whose bags are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                if min(len(p), len(q)) >= similarity * max(len(p), len(q)) - 1e-9:
                    both = np.sort(np.concatenate([p, q]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    ok[i] = common >= similarity * (len(p) + len(q) - common) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))
    return run


def _shared(bags: list[np.ndarray], columns: int = 20_000) -> np.ndarray:
    """Number of common units of every two bags, by matrix products over slices of the units."""
    flat = np.concatenate(bags)
    _, unit, held = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    twice = held[unit] > 1                       # a unit of one bag alone is shared by none
    _, unit = np.unique(unit[twice], return_inverse=True)
    row = row[twice]
    out = np.zeros((len(bags), len(bags)), np.float64)
    for lo in range(0, int(unit.max(initial=-1)) + 1, columns):
        pick = (unit >= lo) & (unit < lo + columns)
        m = np.zeros((len(bags), min(columns, int(unit.max()) + 1 - lo)), np.float32)
        np.add.at(m, (row[pick], unit[pick] - lo), 1)
        out += m @ m.T
    return out


def _block_links(similarity: float):
    """Links between members of different components of two blocks, one for each member
    and component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for x, y, same in zip(*(batch.column(i) for i in range(3)), strict=True):
                members = x.as_py() + ([] if same.as_py() else y.as_py())
                bags = [np.frombuffer(m["bag"], "<u4") for m in members]
                comp = np.array([m["comp"] for m in members])
                both, size = _shared(bags), np.array([len(b) for b in bags], float)
                ok = (both >= similarity * (size[:, None] + size - both) - 1e-9) & (comp[:, None] != comp)
                seen = set()
                for i, j in zip(*np.nonzero(ok), strict=True):
                    if (i, comp[j]) not in seen:
                        seen.add((i, comp[j]))
                        found.append((members[i]["uid"], members[j]["uid"]))
            yield pa.RecordBatch.from_arrays([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())],
                                             names=["a", "b"])
    return run


def _verify_blocks(members: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """``bucket, n, uid, comp`` of large buckets to links: all their open pairs are decided
    inside tasks that each get two blocks of a bucket."""
    block = F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / BLOCK)).alias("block")
    packed = (members.select("bucket", block, "uid", "comp").join(bags, "uid").groupBy("bucket", "block")
              .agg(F.collect_list(F.struct("uid", "comp", "bag")).alias("m")))
    packed = materialise(packed, "dup-blocks")
    other = packed.select(F.col("bucket").alias("bucket2"), F.col("block").alias("block2"), F.col("m").alias("m2"))
    met = (packed.join(other, (F.col("bucket") == F.col("bucket2")) & (F.col("block") <= F.col("block2")))
           .select("m", "m2", (F.col("block") == F.col("block2")).alias("same")))
    with rows_per_batch(members.sparkSession, 16):
        return materialise(met.mapInArrow(_block_links(similarity), "a long, b long").distinct(), "dup-links")


def _bags_of(members: DataFrame, texts: DataFrame, contents: DataFrame, width: int) -> DataFrame:
    """``uid, bag`` of the contents in ``members``; only their texts are shuffled."""
    wanted = (members.select("uid").distinct()
              .join(contents.select("uid", F.col("cid").alias("want")), "uid"))
    once = texts.join(wanted, F.col("cid") == F.col("want")).select("uid", "text")
    return materialise(once.mapInArrow(_bags(width), "uid long, bag binary")
                       .groupBy("uid").agg(F.first("bag").alias("bag")), "dup-bags")


def _verify(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The candidate ``pairs`` that are links."""
    full = (pairs.join(bags.select(F.col("uid").alias("a"), F.col("bag").alias("bag_a")), "a")
            .join(bags.select(F.col("uid").alias("b"), F.col("bag").alias("bag_b")), "b"))
    return materialise(full.select("a", "b", "bag_a", "bag_b").mapInArrow(_linked(similarity), "a long, b long"),
                       "dup-links")


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``uid, comp`` after new ``links``: only links between different components are
    searched for components, with one node for each component so far."""
    ends = (links.join(label.select(F.col("uid").alias("a"), F.col("comp").alias("comp_a")), "a")
            .join(label.select(F.col("uid").alias("b"), F.col("comp").alias("comp_b")), "b"))
    across = materialise(ends.where("comp_a <> comp_b")
                         .select(F.least("comp_a", "comp_b").alias("a"), F.greatest("comp_a", "comp_b").alias("b")).distinct(),
                         "dup-across")
    if not any_rows(across):
        return label
    risen = components(across).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    return materialise(label.join(risen, "comp", "left").select("uid", F.coalesce("top", "comp").alias("comp")),
                       "dup-label")


def content_classes(texts: DataFrame, *, similarity: float = SIMILARITY, width: int = WORDS,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``cid, text`` (any number of rows a content) to ``cid, comp`` for every content
    with words: ``comp`` is shared by the contents of a class."""
    signed = (texts.mapInArrow(_signatures(width, bands, rows), "cid string, bands array<long>")
              .groupBy("cid").agg(F.first("bands").alias("bands")))
    contents = materialise(signed.withColumn("uid", F.monotonically_increasing_id()), "dup-contents")
    members = contents.select("uid", F.explode("bands").alias("bucket"))
    stars = members.groupBy("bucket").agg(F.min("uid").alias("lead"), F.count("*").alias("n")).where("n > 1")
    active = materialise(members.join(stars.select("bucket", "lead"), "bucket"), "dup-buckets")

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # one pair a content; buckets that it leaves in different components come up again below
    tried = (active.where("uid <> lead").groupBy("uid").agg(F.min("lead").alias("lead"))
             .select(*pair("lead", "uid")))
    tried = materialise(tried, "dup-tried")
    bags = _bags_of(active, texts, contents, width)   # every later candidate is one of these
    active = active.select("bucket", "uid")
    label = _merged(contents.select("uid", F.col("uid").alias("comp")), _verify(tried, bags, similarity))
    for turn, last in enumerate((False, False, True)):
        chance = F.xxhash64("uid", "bucket", F.lit(turn))
        now = active.join(label, "uid")
        # the leader comes from the bucket's largest component, so that few members are outside it
        mixed = (now.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.min_by("uid", chance).alias("lead"))
                 .groupBy("bucket").agg(F.count("*").alias("comps"), F.max_by(F.struct("lead", "comp"), F.struct("n", "comp")).alias("top"))
                 .where("comps > 1"))
        open_ = materialise(now.join(mixed.select("bucket", "top.lead", F.col("top.comp").alias("lead_comp")), "bucket"),
                            "dup-open")
        links = None
        if not any_rows(open_):                   # a bucket of one component stays so
            break
        active = open_.select("bucket", "uid")
        if last:
            held = open_.groupBy("bucket").agg(F.count("*").alias("n"))
            sized = open_.join(held, "bucket")
            large = sized.where(F.col("n") > LISTED)
            if any_rows(large):
                links = _verify_blocks(large, bags, similarity)
            small = sized.where(F.col("n") <= LISTED)
            other = small.select(F.col("bucket").alias("bucket2"), F.col("uid").alias("lead2"), F.col("comp").alias("comp2"))
            pairs = (small.join(other, (F.col("bucket") == F.col("bucket2")) & (F.col("comp") < F.col("comp2")))
                     .select(*pair("lead2", "uid")))
        else:
            # buckets that stay mixed come up again: one leader of a component is enough for now
            pairs = (open_.where("comp <> lead_comp").groupBy("uid", "lead_comp").agg(F.min_by("lead", F.xxhash64("lead", "uid", F.lit(turn))).alias("lead"))
                     .select(*pair("lead", "uid")))
        pairs = materialise(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "dup-tried")
        if any_rows(pairs):
            found = _verify(pairs, bags, similarity)
            links = found if links is None else links.union(found)
            tried = tried.union(pairs)
        if links is not None:
            label = _merged(label, links)
    return contents.select("uid", "cid").join(label, "uid").select("cid", "comp")


def near_dups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (smallest id of the class),
    ``class_size, keep`` (true for the row that names the class; rows that repeat its
    id are all marked, ``keep_one`` then keeps one)."""
    texts = docs.select(content_key(text).alias("cid"), F.col(text).alias("text"))
    classes = materialise(content_classes(texts, **how), "dup-classes")
    # texts without words have no class: each row stands alone
    rows = docs.select(F.col(doc_id).alias("doc_id"), content_key(text).alias("cid")).join(classes, "cid", "left")
    rows = materialise(rows.select("doc_id", "comp"), "dup-rows")
    grouped = (rows.where("comp is not null").groupBy("comp")
               .agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    grouped = materialise(grouped, "dup-sizes").select(F.col("comp").alias("of"), "class_id", "class_size")
    out = rows.join(grouped, F.col("comp") == F.col("of"), "left")
    return out.select("doc_id", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("class_size", F.lit(1)).alias("class_size"),
                      (F.col("of").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("keep"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each class: the smallest id (ties: smallest row hash);
    rows without words all stay."""
    cols = docs.columns
    name = fresh(docs, "_dup")
    cid, tie, of_cid, of_tie = (f"{name}_{c}" for c in ("cid", "tie", "of_cid", "of_tie"))
    mark = docs.withColumns({cid: content_key(text), tie: F.xxhash64(*[F.col(c) for c in cols])})
    classes = materialise(content_classes(mark.select(F.col(cid).alias("cid"), F.col(text).alias("text")), **how), "dup-classes")
    light = mark.select(F.col(cid).alias("cid"), F.col(tie).alias("tie"), F.col(doc_id).alias("id"))
    first = (light.join(classes, "cid").groupBy("comp")
             .agg(F.min_by(F.struct(F.col("cid").alias(of_cid), F.col("tie").alias(of_tie)),
                           F.struct(F.col("id").isNull(), "id", "tie")).alias("x")))
    first = materialise(first.select("x.*"), "dup-kept")
    has_words = F.regexp_like(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    kept = (mark.where(has_words)
            .join(first, (F.col(cid) == F.col(of_cid)) & (F.col(tie) == F.col(of_tie)), "left_semi")
            .dropDuplicates([cid, tie]))
    return kept.select(*cols).unionByName(mark.where(~has_words).select(*cols))
