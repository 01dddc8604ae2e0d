"""Compaction of line files: exact against a plain implementation, with hostile paths and rows."""

import datetime as dt
import os
import re

import pytest

from folioscope.operators import compact
from folioscope.operators.compact import compact_line_files, line_records
from tests.conftest import rows

SIG, END = bytes.fromhex("89504E470D0A1A0A"), bytes.fromhex("0000000049454E44AE426082")
SCHEMA = "file_id bigint, file_path string, modified_at timestamp_ntz, n_bytes bigint, img_bytes binary, text string, split string"
DAY = dt.datetime(2024, 1, 1)


def png(tag: bytes = b"x") -> bytes:
    return SIG + tag + END


def files():
    return [
        (1, "train/line_000001.png", DAY, 1, png(), None, "clash"),
        (2, "train/line_000001.gt.txt", DAY, 1, None, "un", "clash"),
        (3, "./Train//line_1 (2).PNG", DAY + dt.timedelta(1), 1, png(b"later"), None, None),  # the same record, later
        (4, r"backup\train\line_000002.gt.txt", DAY, 1, None, "deus", None),
        (5, "train/retry_3/line_000002.png", DAY, 1, png(), None, None),
        (6, "test/line_000002.png", DAY, 1, png(), None, None),  # stands alone
        (7, "train/line_000003.png", DAY, 1, SIG + b"broken", None, None),
        (8, "train/line_000003.gt.txt", DAY, 1, None, "treis", None),
        (9, "train/line_000004.png", DAY, 1, png(), None, None),
        (10, "train/line_000004.gt.txt", DAY, 1, None, " \t \n", None),  # blank
        (11, "train/line_000005.png.part", DAY, 1, png(), None, None),
        (12, "train/line_000005.gt.txt", DAY, 1, None, "cinc", None),
        (13, None, None, None, png(), None, None),
        (14, "pool/line_000006.png", DAY, 1, png(), None, None),
        (15, "validation/line_001234567.GT.TXT", DAY, 1, None, "x" * 100_000, None),
        (16, "validation/line_1234567.png", None, 1, png(), None, None),
        (1, "train/line_000001.png", DAY, 1, png(), None, "clash"),  # repeated row
        (17, "train/line_000007.png", DAY, 0, b"", None, None),
        (18, "train/line_000007.gt.txt", DAY, 1, None, "set", None),
    ]


EXPECTED = [("train", "line_000001"), ("train", "line_000002"), ("validation", "line_1234567")]


def test_records(spark):
    got = line_records(spark.createDataFrame(files(), SCHEMA))
    assert rows(got.select("split", "stem")) == EXPECTED
    first = got.where("stem = 'line_000001'").first()
    assert bytes(first.img_bytes) == png(b"later") and first.text == "un" and first.image_path.startswith("./Train")


def test_commit(spark, tmp_path):
    out = str(tmp_path / "out")
    got = compact_line_files(spark.createDataFrame(files() * 3, SCHEMA).repartition(20), out)
    assert rows(got.select("split", "stem")) == EXPECTED
    assert len([f for f in os.listdir(out) if f.endswith(".parquet")]) == 1 and not os.path.exists(out + ".staging")


def test_target_size(spark, tmp_path):
    made = [(i * 2 + k, f"train/line_{i:06d}.{'gt.txt' if k else 'png'}", DAY, 1, None if k else SIG + os.urandom(3000) + END, "t" if k else None, None) for i in range(400) for k in (0, 1)]
    df = spark.createDataFrame(made, SCHEMA).repartition(40)
    small = compact_line_files(df, str(tmp_path / "a"), target_bytes=200_000)
    assert small.count() == 400 and 3 <= len(small.inputFiles()) <= 12
    assert len(compact_line_files(df, str(tmp_path / "b")).inputFiles()) == 1


def test_mismatch_is_not_committed(spark, tmp_path, monkeypatch):
    calls = iter([(3, 1, 1), (2, 1, 1)])
    monkeypatch.setattr(compact, "_checksum", lambda *a: next(calls))
    out = str(tmp_path / "out")
    with pytest.raises(RuntimeError, match="not committed"):
        compact_line_files(spark.createDataFrame(files(), SCHEMA), out)
    assert not os.path.exists(out) and not os.path.exists(out + ".staging")


def test_output_is_replaced(spark, tmp_path):
    out = str(tmp_path / "out")
    compact_line_files(spark.createDataFrame(files(), SCHEMA), out)
    assert compact_line_files(spark.createDataFrame(files()[:0], SCHEMA), out).count() == 0
    assert rows(compact_line_files(spark.createDataFrame(files(), SCHEMA), out).select("split", "stem")) == EXPECTED
    assert sorted(os.listdir(tmp_path)) == ["out"]


def test_empty(spark, tmp_path):
    assert compact_line_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "e")).count() == 0


def test_hot_record(spark):
    many = spark.range(20_000).selectExpr("id as file_id", "if(id % 2 = 0, 'train/line_000001.png', 'train/line_1.gt.txt') as file_path", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) as modified_at", "0L as n_bytes", f"if(id % 2 = 0, unhex('{(SIG + END).hex()}'), null) as img_bytes", "if(id % 2 = 1, concat('t', id), null) as text")
    got = line_records(many).collect()
    assert len(got) == 1 and got[0].text == "t19999" and not re.search("png", got[0].text_path)
