"""Quarantined lines against a plain reader of the bytes."""

import random

import pytest
from pyspark.sql import types as T

from evstat.sources import quarantine as Q

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType())])


def plain(data):
    """Good rows and faults of one file's bytes."""
    good, bad, at = [], [], 0
    lines = data.split(b"\n")
    for line in lines[:-1] if lines[-1] == b"" else lines:
        here, at = at, at + len(line) + 1
        try:
            f = line.decode().removesuffix("\r").split("\t")
        except UnicodeDecodeError:
            bad.append((here, "encoding", line))
            continue
        if len(f) != 3:
            bad.append((here, "fields", line))
            continue
        row, reason = [], None
        for text, kind, name in zip(f, (int, float, str), ("id", "x", "s")):
            try:
                row.append(kind(text) if text else None)
            except ValueError:
                reason = reason or f"type:{name}"
        bad.append((here, reason, line)) if reason else good.append(tuple(row))
    return good, bad


def lines(seed, n):
    r = random.Random(seed)
    kinds = [b"7\t1.5\tabc", "8\t-2.25\tüñ 漢".encode(), b"\t\t", b"x1\t1\ta", b"3\tno\tb", b"no\tno\tc", b"1\t2", b"", b"1\t2\t3\t4",
             b"9\t1.0\t\xff\xfe", b"4\t1.0\tend\r", b"5\t2.0\t" + b"long " * 300]
    return b"\n".join(r.choice(kinds) for _ in range(n))


@pytest.mark.parametrize("limit", ["128m", "2k", "37b"])
def test_every_line_is_in_one_table(spark, tmp_path, limit):
    files = {"a.tsv": lines(1, 300) + b"\n", "b.tsv": lines(2, 120), "c.tsv": b"", "d e%20.tsv": b"bad", "f.tsv": b"\n\n"}
    if limit == "37b":
        files = {"a.tsv": b"1\t2.0\ta\nx\n\n2\t2.0\tb\r\nlonger line without a field\n3\t3.0\tc\n1\t2\n" * 4}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        good, bad = Q.read_checked(spark, str(tmp_path), SCHEMA)
        good, bad = [tuple(r) for r in good.collect()], bad.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [plain(d) for d in files.values()]
    assert sorted(map(repr, good)) == sorted(repr(r) for g, _ in want for r in g)
    assert sorted((r.position, r.reason, bytes(r.raw)) for r in bad) == sorted(f for _, b in want for f in b)
    whole = {n.replace("%", "%25").replace(" ", "%20"): d for n, d in files.items()}
    for r in bad:       # the position leads to the line
        data = whole[r.file.rsplit("/", 1)[1]]
        assert data[r.position:r.position + len(r.raw)] == bytes(r.raw)


def test_no_lines(spark, tmp_path):
    (tmp_path / "e.tsv").write_bytes(b"")
    good, bad = Q.read_checked(spark, str(tmp_path))
    assert good.count() == 0 and bad.count() == 0 and len(good.columns) == 61


def test_other_separator(spark, tmp_path):
    (tmp_path / "e.csv").write_bytes(b"1|2.0|a\tb\n1|2.0\n")
    good, bad = Q.read_checked(spark, str(tmp_path), SCHEMA, "|")
    assert [tuple(r) for r in good.collect()] == [(1, 2.0, "a\tb")]
    assert [(r.position, r.reason) for r in bad.collect()] == [(10, "fields")]
