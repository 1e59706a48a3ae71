"""Operator 6: chat formatting in budgeted windows.

A window holds at most ``budget`` tokens as written, escapes counted: the
conversation's system turn, then the last turns of the window before it, up to
``history`` tokens and to what is left, then new turns.  A window is opened
where the next turn would no longer fit beside the system turn and a full
history.  Turns are sorted by ranges; a range's cuts depend on the tokens
that the open window holds on entry, so for a conversation in several ranges
each range gives its exit for every possible entry, these are chained, and
then each range is cut by itself.  Only assistant texts of new turns are
under the loss mask: each is learnt once.

Turns are written as ``<|im_start|>role``, line feed, text, ``<|im_end|>``,
line feed.  In roles and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes
``<\\|`` (and a line feed in a role ``\\n``), which ``read_back`` undoes.

Cases: a null text or role counts as empty; a turn that does not
fit beside a full history has a window of its own with less or no history, and
only one that does not fit beside the system turn makes a window exceed the
budget (it is kept whole); turns with equal numbers follow by
role, then text; repeated rows are turns of their own; a null conversation is
one conversation, null turn numbers come last; no rows give no rows; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evstat.llm.common import materialise, task_partitions
from evstat.llm.packing import tokens_of

BUDGET = 1024
HISTORY = 256
TURN_TOKENS = 6      # of the marks around a turn and a role of one token
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n"}.get(m[1], m[1]), text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def format_window(turns: list[tuple[str, str]], repeated: int) -> tuple[str, list[tuple[int, int]]]:
    """``(text, loss spans)`` of a window whose first ``repeated`` turns were seen before."""
    out, spans, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head = f"{START}{escape_role(role)}\n"
        body = escape(text)
        if i >= repeated and role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _count_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for b in batches:
            known = {r: max(0, len(tokens(escape_role(r))) // 2 - 1) for r in set(b.column(2).to_pylist())}
            n = [len(tokens(escape(t))) // 2 + known[r] + TURN_TOKENS
                 for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "tokens"])
    return run


# ---------------------------------------------------------------- windows

def cut(sizes: list[int], room: int, used: int = 0, window: int = -1) -> list[int]:
    """The window of each turn, where ``used`` tokens of ``window`` are taken (-1: none is open)."""
    out = []
    for n in sizes:
        if window < 0 or used + n > room:
            window, used = window + 1, n
        else:
            used += n
        out.append(window)
    return out


def exits(sizes: list[int], room: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry 0 (no window) to ``room`` tokens: the tokens at the end, and the windows opened."""
    used, opened = np.arange(room + 1), np.zeros(room + 1, np.int64)
    for n in sizes:
        new = (used == 0) | (used + n > room)
        used = np.minimum(np.where(new, n, used + n), room)      # beyond the room is as good as full
        opened += new
    return used, opened


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ints = pa.list_(pa.int64())
    for b in batches:
        for i in range(b.num_rows):
            done = exits([t["tokens"] for t in b.column(2)[i].as_py()], b.column(3)[i].as_py())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1),
                                              pa.array([done[0]], ints), pa.array([done[1]], ints)], names=["conv", "part", "used", "opened"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            used, window, rows = 0, -1, []
            for r in b.column(1)[i].as_py():
                rows.append((r["part"], used, window))
                window += r["opened"][used]
                used = r["used"][used]
            parts, entry, windows_ = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([i] * len(rows))), pa.array(parts, pa.int32()), pa.array(entry, pa.int64()),
                 pa.array(windows_, pa.int64())], names=["c5", "p5", "entry", "open"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists, rooms, used, window = (b.column(i).to_pylist() for i in (1, 2, 3, 4))
        done = [[{"pos": t["pos"], "window": w} for t, w in zip(ts, cut([t["tokens"] for t in ts], *at), strict=True)]
                for ts, *at in zip(lists, rooms, used, window, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(done, pa.list_(pa.struct([("pos", pa.int64()), ("window", pa.int64())])))], names=["c6", "cuts"])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        conv, number, turns, repeated = (b.column(i).to_pylist() for i in range(4))
        done = [format_window([(t["role"], t["text"]) for t in ts], r) for ts, r in zip(turns, repeated, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([d[0] for d in done], pa.string()),
             pa.array([[{"s": s, "e": e} for s, e in d[1]] for d in done],
                      pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), b.column(3)],
            names=["conv_id", "window", "formatted", "loss", "repeated"])


def windows(chats: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text", *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, window, formatted, loss (spans of code points), repeated (turns at the
    window's start that other windows have as new)``."""
    spark = chats.sparkSession
    kinds = {c: chats.schema[c].dataType.simpleString() for c in (conv_id, turn)}
    rows = chats.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.mapInArrow(_count_tokens(tokenizer),
                           f"conv {kinds[conv_id]}, turn {kinds[turn]}, role string, text string, tokens long")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "chat-turns")

    # running sums of tokens: totals of sorted ranges, then inside each range
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"), F.col("row")]
    sort_key = [F.col("conv"), F.col("turn").isNull(), F.col("turn"), F.col("role"), F.col("text"), F.col("row")]
    ranged = materialise(rows.repartitionByRange(task_partitions(spark), *sort_key)
                         .withColumn("part", F.spark_partition_id()), "chat-ranges")
    up = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part = (ranged.groupBy("conv", "part").agg(F.sum("tokens").alias("held"), F.count("*").alias("n"))
            .withColumn("before", F.coalesce(F.sum("held").over(up), F.lit(0)))
            .withColumn("n_before", F.coalesce(F.sum("n").over(up), F.lit(0)))
            .select(F.col("conv").alias("c2"), F.col("part").alias("p2"), "before", "n_before"))
    run = Window.partitionBy("conv", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (ranged.withColumn("sum", F.sum("tokens").over(run)).withColumn("at", F.row_number().over(run))
              .join(part, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("p2")))
              .withColumn("start", F.col("before") + F.col("sum") - F.col("tokens"))
              .withColumn("pos", F.col("n_before") + F.col("at") - 1))
    placed = materialise(placed.select("conv", "part", "pos", "role", "text", "tokens", "start"), "chat-placed")

    system = placed.where((F.col("pos") == 0) & (F.col("role") == "system"))
    lead = system.select(F.col("conv").alias("c3"), F.col("tokens").alias("system_tokens"), F.col("text").alias("system_text"))
    taken = F.coalesce("system_tokens", F.lit(0))
    placed = (placed.join(lead.drop("system_text"), F.col("conv").eqNullSafe(F.col("c3")), "left")
              .withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - taken).cast("long"))
              .withColumn("is_system", F.col("c3").isNotNull() & (F.col("pos") == 0)))
    pieces = materialise(placed.where("not is_system").groupBy("conv", "part", "room").agg(
        F.sort_array(F.collect_list(F.struct("pos", "tokens"))).alias("sizes")), "chat-pieces")
    split = pieces.groupBy(F.col("conv").alias("c7")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    long = pieces.join(split, F.col("conv").eqNullSafe(F.col("c7")), "left_semi").select("conv", "part", "sizes", "room")
    kind = kinds[conv_id]
    entries = (long.mapInArrow(_exits, f"conv {kind}, part int, used array<long>, opened array<long>")
               .groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "used", "opened"))).alias("pieces"))
               .mapInArrow(_chain, f"c5 {kind}, p5 int, entry long, open long"))
    cuts = (pieces.join(entries, F.col("conv").eqNullSafe(F.col("c5")) & (F.col("part") == F.col("p5")), "left")
            .select("conv", "sizes", "room", F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("open", F.lit(-1)).cast("long").alias("open"))
            .mapInArrow(_cut, f"c6 {kind}, cuts array<struct<pos:long,window:long>>").select("c6", F.inline("cuts").alias("at", "cut")))
    body = (placed.join(cuts, F.col("conv").eqNullSafe(F.col("c6")) & (F.col("pos") == F.col("at")), "left")
            .withColumn("start", F.col("start") - taken)     # the system turn takes no room
            .withColumn("window", F.coalesce("cut", F.lit(0)).cast("long")))
    body = materialise(body.select("conv", "pos", "role", "text", "tokens", "start", "window", taken.alias("system_tokens"), "is_system"), "chat-body")
    # the last turns before a window are repeated in it
    new_tokens = F.sum(F.when(~F.col("is_system"), F.col("tokens")).otherwise(0))
    opens = body.groupBy("conv", "window").agg(
        F.min("start").alias("opens"), F.least(F.lit(history), F.lit(budget) - F.first("system_tokens") - new_tokens).alias("left"))
    nxt = Window.partitionBy("conv").orderBy("window")
    opens = (opens.withColumn("next_window", F.lead("window").over(nxt)).withColumn("next_opens", F.lead("opens").over(nxt))
             .withColumn("next_left", F.lead("left").over(nxt)).where("next_window is not null")
             .select(F.col("conv").alias("c4"), F.col("window").alias("w4"), "next_window", "next_opens", "next_left"))
    again = (body.where("not is_system").join(opens, F.col("conv").eqNullSafe(F.col("c4")) & (F.col("window") == F.col("w4")))
             .where(F.col("next_opens") - F.col("start") <= F.col("next_left"))
             .select("conv", F.col("next_window").alias("window"), "pos", "role", "text", F.lit(1).alias("old")))
    new = body.select("conv", "window", "pos", "role", "text", F.lit(0).alias("old"))
    packed = (new.unionByName(again).groupBy("conv", "window")
              .agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"), F.sum("old").alias("old")))
    packed = packed.join(lead, F.col("conv").eqNullSafe(F.col("c3")), "left")
    with_system = (F.col("window") > 0) & F.col("system_text").isNotNull()
    first = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), F.col("system_text").alias("text")))
    packed = packed.select(
        F.col("conv").alias("conv_id"), "window",
        F.when(with_system, F.concat(first, F.col("turns"))).otherwise(F.col("turns")).alias("turns"),
        (F.col("old") + with_system.cast("int")).cast("int").alias("repeated"))
    return packed.mapInArrow(_write, f"conv_id {kinds[conv_id]}, window long, formatted string, "
                                     "loss array<struct<s:int,e:int>>, repeated int")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, loss, repeated = (b.column(i).to_pylist() for i in (2, 3, 4))
        turns = [read_back(t)[r:] for t, r in zip(text, repeated, strict=True)]
        learnt = ["".join(unescape(t[x["s"]:x["e"]]) for x in spans) for t, spans in zip(text, loss, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([len(t) for t in turns], pa.int64()),
             pa.array(["".join(f"{r}\n{x}\n" for r, x in t) for t in turns], pa.string()),
             pa.array(learnt, pa.string()), pa.array([len(t) for t in text], pa.int64())],
            names=["conv_id", "window", "n_turns", "turns", "learnt", "chars"])


def digests(written: DataFrame) -> DataFrame:
    """What ``windows`` wrote, read back: one row a conversation.  A digest runs over a
    whole conversation, so its text meets in one row here (and only here)."""
    kind = written.schema["conv_id"].dataType.simpleString()
    read = written.mapInArrow(_read, f"conv_id {kind}, window long, n_turns long, turns string, learnt string, chars long")
    joined = lambda c: F.array_join(F.transform("parts", lambda x: x[c]), "")
    return (read.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                        F.sort_array(F.collect_list(F.struct("window", "turns", "learnt"))).alias("parts"))
            .select("conv_id", "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"),
                    F.length(joined("learnt")).cast("long").alias("loss_chars"),
                    F.sha2(joined("learnt"), 256).alias("loss_sha256"), "formatted_chars"))
