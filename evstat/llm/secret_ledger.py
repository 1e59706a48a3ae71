"""Operator 7: secret scans with an incremental blob ledger.

Every version of a text is named by its content (sha2).  A ledger table says
which (blob, rule, version) pairs were scanned before and what was found;
only unseen pairs are scanned, each distinct blob once, and findings are
joined back to all rows that hold the blob.  DataFrame functions only.

Spans are code points, end exclusive.  The regular expressions run inside
``regexp_replace``, which sets a mark before and after each match; the
lengths of the pieces between the marks give the positions.  Mark characters
in a text are first replaced by another control character: none of the rules
can match either, so matches and positions stay.

Cases: a null text counts as empty; an empty text has no spans; repeated
texts are scanned once; no rows give no rows and an unchanged ledger; other
columns of the input pass through, under their own names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evstat.llm.common import materialise


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; those that do not also
    match ``keep`` (as a whole) are dropped after the search."""
    kind: str
    version: int
    pattern: str
    keep: str


_VALUE = r"[A-Za-z0-9+/_.=-]"
_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""

BASE_RULES = (
    Rule("assign", 1, rf"{_ASSIGN}{_VALUE}+", rf"^{_ASSIGN}{_VALUE}{{6,}}$"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"^.{20,}$"),
    # a run of hex digits is matched whole, so asking for 24 at once finds the same runs
    Rule("hex", 1, r"[0-9a-f]{24,}", r"^.+$"),
)
#: Further kinds of the method itself; they only add spans.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"^.+$"),
    Rule("bearer", 1, r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*", r"^.+$"),
)
RULES = BASE_RULES + MORE_RULES

LEDGER_SCHEMA = "blob string, kind string, version int, spans array<struct<s:int,e:int>>"
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"


def blob_col(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def markable(text: Column) -> Column:
    """The text without mark characters (same length, same matches)."""
    marked = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
    return F.when(marked, F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)).otherwise(text)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(xs: Column) -> Column:
    """A non-empty array of n as about sqrt(n) arrays of about sqrt(n)."""
    def cut(v: Column, step: Column) -> Column:
        n = F.floor((F.size(v) - 1) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda b: F.slice(v, b * step + 1, step))

    return _with(xs, lambda v: _with(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda step: cut(v, step)))


def _before(xs: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each int of a non-empty array, all before it joined, from 0.  The fold copies what it has gathered at
    each step, so it runs over blocks: n * sqrt(n) copies and not n * n, where one text has a great many matches."""
    def run(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(
            join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    whole = lambda b: F.aggregate(b, F.lit(0), join)
    return _with(_blocks(xs), lambda blocks: F.flatten(F.zip_with(
        blocks, run(F.transform(blocks, whole), F.lit(0)), run)))


def rule_spans(text: Column, rule: Rule) -> Column:
    """``array<struct<s,e>>`` of the kept matches of one rule (null when it has no
    match); ``text`` must be ``markable``."""
    marked = F.regexp_replace(text, f"({rule.pattern})", f"{_OPEN}$1{_CLOSE}")
    pieces = F.split(marked, f"[{_OPEN}{_CLOSE}]")
    def found(piece: Column, starts: Column) -> Column:
        # pieces alternate: text between, match, text between, ...
        spans = F.transform(piece, lambda p, i: F.when((i % 2 == 1) & p.rlike(rule.keep), F.struct(
            F.get(starts, i).alias("s"), (F.get(starts, i) + F.length(p)).alias("e"))))
        return F.filter(spans, lambda x: x.isNotNull())

    of = _with(pieces, lambda piece: _with(_before(F.transform(piece, F.length), lambda a, n: a + n), lambda starts: found(piece, starts)))
    return F.when(text.rlike(rule.pattern), of)


def _pair(rule: Rule) -> Column:
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def update_ledger(versions: DataFrame, ledger: DataFrame, text: str = "text",
                  rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger has not seen.  Returns ``(new rows, whole ledger)``; append
    the new rows to the stored ledger, later calls then skip them."""
    wanted = F.array(*[_pair(r) for r in rules])
    none = F.array().cast("array<struct<kind:string,version:int>>")
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
    # distinct blobs; copies meet before the shuffle (partial aggregation)
    blobs = (versions.select(blob_col(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
             .groupBy("blob").agg(F.first("text").alias("text")))
    todo = (blobs.join(seen, "blob", "left")
            .withColumn("todo", F.array_except(wanted, F.coalesce("seen", none)))
            .where(F.size("todo") > 0).withColumn("text", markable(F.col("text"))))
    found = [F.when(F.array_contains("todo", _pair(r)),
                    F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                             rule_spans(F.col("text"), r).alias("spans"))) for r in rules]
    fresh = todo.select("blob", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found"))
    fresh = materialise(fresh.select("blob", F.inline("found")), "ledger")
    return fresh, ledger.select("blob", "kind", "version", "spans").unionByName(fresh)


def findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row for each blob with a secret: ``blob, found`` (array of ``s, k, e, kind``,
    in order of start, then kind as listed); only the given rule versions count."""
    pairs = F.array(*[_pair(r) for r in rules])
    kind_at = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    return (ledger.where(F.col("spans").isNotNull()
                         & F.array_contains(pairs, F.struct("kind", "version")))
            .select("blob", "kind", kind_at.alias("k"), F.inline("spans"))
            .groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("s", "k", "e", "kind"))).alias("found")))


def found_in(docs: DataFrame, text: str = "text", *, rules: Sequence[Rule] = RULES,
             ledger: DataFrame | None = None) -> DataFrame:
    """``blob, found`` for the blobs of ``docs`` that hold a secret (see ``findings``)."""
    ledger = empty_ledger(docs.sparkSession) if ledger is None else ledger
    _, whole = update_ledger(docs, ledger, text, rules)
    return materialise(findings(whole, rules), "findings")


def join_back(rows: DataFrame, blob: Column, found: DataFrame, out: str = "secrets") -> DataFrame:
    """``rows`` with ``out``: the spans of each row's blob (empty array: none)."""
    hits = found.select(F.col("blob").alias(f"_{out}_blob"), F.col("found").alias(f"_{out}_found"))
    none = F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")
    joined = rows.withColumn(f"_{out}_of", blob).join(hits, F.col(f"_{out}_of") == F.col(f"_{out}_blob"), "left")
    return joined.select(*rows.columns, F.coalesce(f"_{out}_found", none).alias(out))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mask``."""
    def segments(x: Column) -> Column:
        """What stands before each span that begins after all before it have ended."""
        reach = _before(F.transform(x, lambda s: s["e"]), lambda a, e: F.greatest(a, e))
        return _with(reach, lambda r: F.filter(F.transform(x, lambda s, i: F.struct(F.get(r, i).alias("f"), s["s"].alias("t"))),
                                               lambda g: g["t"] >= g["f"]))

    def joined(block: Column) -> Column:
        first = F.element_at(block, 1)["f"]
        chunk = F.substring(text, first + 1, F.element_at(block, -1)["t"] - first)
        # cut from a chunk: a substring is found by counting from where its string begins
        return _with(chunk, lambda c: F.array_join(F.transform(block, lambda g: F.concat(
            F.substring(c, g["f"] - first + 1, g["t"] - g["f"]), F.lit(mask))), ""))

    end = F.array_max(F.transform(spans, lambda s: s["e"]))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(
        F.array_join(F.transform(_blocks(segments(spans)), joined), ""), F.substring(text, end + 1, F.length(text))))
