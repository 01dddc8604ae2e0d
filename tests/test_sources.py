"""Readers, writers and the stream of lines."""

import pytest
from pyspark.sql import functions as F

from folioscope.sources import files
from folioscope.streaming.lines import append_lines
from tests.conftest import rows
from tests.test_operators import CORPUS, corpus_rows


def test_text_and_images(spark, tmp_path):
    for name, body in (("line_000001.gt.txt", " a b \n"), ("line_000002.png", "x"), ("line_000001.png", "yy"), ("other.txt", "z")):
        (tmp_path / name).write_text(body)
    assert rows(files.read_texts(spark, str(tmp_path))) == [("line_000001", "a b")]
    assert [(r.stem, r.n_bytes, r.text) for r in files.sample_directory(spark, str(tmp_path)).collect()] == [("line_000001", 2, "a b"), ("line_000002", 1, "")]
    assert files.read_texts(spark, str(tmp_path / "none")).count() == 0 == files.sample_directory(spark, str(tmp_path / "none")).count()
    files.write_path_list(files.read_images(spark, str(tmp_path)), str(tmp_path / "list"))
    assert [r.value.rsplit("/", 1)[1] for r in spark.read.text(str(tmp_path / "list")).collect()] == ["line_000001.png", "line_000002.png"]
    assert files.corpus_files([("train", "a"), ("test", "b"), ("train", "c")], "train", 1) == ["a"]


def test_json_and_csv(spark, tmp_path):
    m = tmp_path / "m.json"
    m.write_text('{"repo_id": "r", "filter": {"language": "French", "century": 13},\n "splits": {"train": 3, "test": 1}, "total": 4}')
    r = files.read_manifest(spark, str(m)).first()
    assert r.splits == {"train": 3, "test": 1} and r.total == 4 and r.filter.century == 13
    assert files.read_manifest(spark, str(tmp_path / "x")).isEmpty() and files.read_report(spark, str(tmp_path / "x")).isEmpty()
    rep = tmp_path / "r.json"
    rep.write_text('{"model": "m", "cer": 0.04, "manuscripts": {"A": {"iou_mean": 0.7, "n_lines": 3}, "B": {"iou_mean": 0.8}}}')
    assert rows(files.manuscripts_of(files.read_report(spark, str(rep))).select("manuscript", "iou_mean")) == [("A", 0.7), ("B", 0.8)]
    c = tmp_path / "e.csv"
    c.write_text("epoch,accuracy,cer,word_accuracy,wer,best_val_metric\n5,0.9,0.1,0.5,0.5,0.9\n4,0.8,bad,0.4,0.6,0.8\n")
    e = files.read_metrics(spark, str(c)).collect()
    assert [x.epoch for x in e] == [4, 5] and e[0].cer is None and files.read_metrics(spark, str(tmp_path / "x")).isEmpty()
    files.write_metrics(files.read_metrics(spark, str(c)), str(tmp_path / "out"))
    assert files.read_metrics(spark, str(tmp_path / "out")).count() == 2
    log = spark.createDataFrame([(1, 0.5, 0.5)], "epoch int, accuracy double, cer double")
    assert files.metrics_or_log(files.read_metrics(spark, str(tmp_path / "x")), log).count() == 1
    assert files.metrics_or_log(files.read_metrics(spark, str(c)), log).count() == 2
    p = tmp_path / "p.csv"
    p.write_text('ref,hyp\n"a ""q"", b",c\nd\n')
    assert rows(files.read_predictions(spark, str(p))) == [('a "q", b', "c", None), ("d", None, None)]
    t = tmp_path / "l.tsv"
    t.write_text('roi\tsubst\troi\nd"a\tx\ty\n')
    assert rows(files.read_lexicon(spark, str(t)).select("form")) == [('d"a',), ("roi",)]
    cells = spark.createDataFrame([("1",), ("1.5",), ("1e-4",), ("x",)], "c string").select(files.typed_cell(F.col("c")).alias("t")).select("t.*")
    assert [tuple(r) for r in cells.collect()] == [(1, None, None), (None, 1.5, None), (None, None, "1e-4"), (None, None, "x")]


def test_keys_and_database(spark):
    assert files.split_key("s3a://b/p/", "train") == "s3a://b/p/split=train" and files.manifest_key("p/") == "p/dataset_manifest.json"
    with pytest.raises(ValueError):
        files.read_database(spark, None, "runs")
    with pytest.raises(ValueError):
        files.write_database(spark.range(1), "", "runs")


def test_lines_by_split(spark, tmp_path):
    df = spark.createDataFrame([("train", "a"), ("test", "b")], "split string, text string")
    files.write_lines(df, str(tmp_path / "o"))
    assert rows(spark.read.parquet(str(tmp_path / "o")).where("split = 'test'").select("text")) == [("b",)]


def test_stream_equals_table(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame(corpus_rows(), CORPUS).repartition(3).write.parquet(src)
    out = str(tmp_path / "out")
    for _ in range(2):  # what was written once is not written again
        append_lines(spark.readStream.schema(CORPUS).parquet(src), out, "French", 13, str(tmp_path / "ck")).awaitTermination()
    assert rows(spark.read.parquet(out).select("line_id", "text", "text_normalized")) == [(1, "un", "un"), (2, "deus", "deus"), (6, "treis", "treis")]
