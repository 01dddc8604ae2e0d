"""Logs, curves, reports, listings, corrections with context, extraction."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import corpus, lexicon, metrics, training
from folioscope.sources import files
from tests.conftest import rows


def test_logs_by_key(spark):
    logs = spark.createDataFrame([("a", "Accuracy report (1) 0.5 10 5"), ("b", "x\nAccuracy report (1) 0.75\nAccuracy report (2) 0.8 5 1")], "run string, value string")
    assert rows(training.parse_log(logs, by=["run"])) == [("a", 1, 0.5, 0.5, 10, 5), ("b", 1, 0.75, 0.25, None, None), ("b", 2, 0.8, 0.2, 5, 1)]


def test_shift_with_words(spark):
    m = spark.createDataFrame([(4, 0.9462, 0.7241), (5, 0.9, 0.7)], "epoch int, accuracy double, word_accuracy double")
    got = rows(training.anchor_curve(m, 0.95533, 0.764, 5).select("epoch", "accuracy", "cer", "word_accuracy", "wer"))
    assert got == [(4, 0.95533, 0.04467, 0.764, 0.236), (5, 0.90913, 0.09087, 0.7399, 0.2601)]
    assert training.anchor_curve(m.limit(0), 0.95, 0.7, 5).count() == 0
    assert spark.range(1).select(training.half_width(F.lit(0.0368), F.lit(0.0530))).first()[0] == pytest.approx(0.0081)


def test_shipped_report(spark, tmp_path):
    report = {"model": "m", "test_set": "t", "note": "n", "validation_best": {"epoch": 4, "val_accuracy": 0.95533, "cer": 0.04467, "val_word_accuracy": 0.764, "wer": 0.236}, "bootstrap": {"n_bootstrap": 1000, "alpha": 0.05, "cer_ci95": [0.0368, 0.053], "wer_ci95": [0.21, 0.262]}, "segmentation_iou": {"threshold": 0.75, "manuscripts": {"a": {"title": "A", "mean_iou": 0.7168, "pct_above_threshold": 0.381, "n_lines": 711, "n_pages": 4}}, "mean_iou": 0.7852, "pct_above_threshold": 0.654}, "trainer_output": "best"}
    (tmp_path / "r.json").write_text(json.dumps(report, indent=1))
    r = files.read_report(spark, str(tmp_path / "r.json"))
    assert tuple(r.select("model", "cer", "wer", "char_accuracy", "raw", "best_epoch", "iou_mean", "iou_share", "bootstrap.cer_ci95").first()) == ("m", 0.04467, 0.236, 0.95533, "best", 4, 0.7852, 0.654, [0.0368, 0.053])
    assert rows(files.manuscripts_of(r)) == [("a", 0.7168, 0.381, 711, 4)]
    files.write_report(r, str(tmp_path / "out"))
    assert files.read_report(spark, str(tmp_path / "out")).first().cer == 0.04467


def test_listing_and_corpus(spark, tmp_path):
    data = spark.createDataFrame([((b"x", "p"), "t", "French", 13)], files.CORPUS)
    data.write.parquet(str(tmp_path / "c"))
    listing = {"parquet_files": [{"split": "train", "url": str(tmp_path / "c"), "size": 3}, {"split": "test", "url": "b"}, {"split": "train", "url": "d"}]}
    (tmp_path / "l.json").write_text(json.dumps(listing))
    found = files.read_listing(spark, str(tmp_path / "l.json"))
    assert found == [("train", str(tmp_path / "c")), ("test", "b"), ("train", "d")] and files.read_listing(spark, str(tmp_path / "none")) == []
    assert files.read_corpus(spark, files.corpus_files(found, "train", 1)).first().text == "t"
    assert files.read_corpus(spark, files.corpus_files(found, "other")).count() == 0
    (tmp_path / "p1.xml").write_text("<alto/>")
    assert rows(files.read_pages(spark, str(tmp_path))) == [("p1", "<alto/>")] and files.read_pages(spark, str(tmp_path / "none")).count() == 0
    manifest = corpus.split_manifest(spark.createDataFrame([("train",), ("test",), ("train",)], "split string"), {"repo_id": F.lit("r")})
    files.write_manifest(manifest, str(tmp_path / "m"))
    assert files.read_manifest(spark, str(tmp_path / "m")).first().splits == {"train": 2, "test": 1}


def test_correction_with_context(spark):
    lex = spark.createDataFrame([(w,) for w in ("comme", "come", "celle", "qui", "ensemble", "poins")], "form string")
    lines = spark.createDataFrame([(1, "celle comne qui"), (2, "Poins (eusemble), xyzzyq"), (None, "comne"), (3, None), (4, "  "), (2, "Poins (eusemble), xyzzyq")], "id int, t string")
    seen = []

    def last(words: pd.Series, index: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([c[-1] if i and words_[i - 1] == "celle" else None for words_, i, c in zip(words, index, found)], dtype=object)

    got = sorted(((r.id, r.corrected, r.n_changes, [(c.pos, c.core, c.best, c.candidates) for c in r.changes]) for r in lexicon.correct_lines(lines, ["id"], "t", lex, context=last).collect()), key=repr)
    twice = (2, "Poins (ensemble), xyzzyq", 1, [(1, "eusemble", "ensemble", ["ensemble"])])
    near = rows(lexicon.candidates(spark.createDataFrame([("comne",)], "word string"), lex).orderBy("rank").select("rank", "form"))
    forms = [f for _, f in sorted(near)]
    assert got == sorted([(1, f"celle {forms[-1]} qui", 1, [(1, "comne", forms[-1], forms)]), twice, twice, (None, forms[0], 1, [(0, "comne", forms[0], forms)])], key=repr)
    plain = {r.id: r.corrected for r in lexicon.correct_lines(lines, ["id"], "t", lex).collect()}
    assert plain[1] == f"celle {forms[0]} qui" and not seen
    assert lexicon.correct_lines(lines.limit(0), ["id"], "t", lex, context=last).count() == 0


def test_most_probable(spark):
    lex = spark.createDataFrame([(w,) for w in ("come", "comme", "conne", "celle")], "form string")
    lines = spark.createDataFrame([(1, "celle comne"), (2, "comne celle"), (3, "cele")], "id int, t string")

    def probabilities(asked):
        return [[{"come": None, "comme": 0.2, "conne": 0.2 + 0.1 * i}.get(c) for c in found] for _, i, found in asked]

    got = {r.id: r.corrected for r in lexicon.correct_lines(lines, ["id"], "t", lex, context=lexicon.most_probable(probabilities)).collect()}
    assert got == {1: "celle conne", 2: "comme celle", 3: "celle"}
    with pytest.raises(ImportError):
        lexicon.masked_model("none")(pd.Series([["a"]]), pd.Series([0]), pd.Series([["b"]]))


def test_draws_are_the_same(spark):
    import numpy as np

    want = [r.m for r in spark.range(-50, 150).select(metrics.draws(F.col("id"), F.lit(3).cast("bigint")).alias("m")).collect()]
    assert metrics.draw_table(np.arange(-50, 150), np.array([3]))[:, 0].tolist() == want


def test_extraction(spark):
    png = bytes.fromhex("89504E470D0A1A0A00")
    data = [(1, "train", (png, "p"), " a ", "French", 13), (2, "train", (b"text", "p"), "b", "French", 13), (3, "test", (bytes.fromhex("FFD8FF00"), "p"), "c", "French", 13), (4, "train", (png, "p"), "d", "Latin", 13), (5, "train", (None, "p"), "e", "French", 13), (6, "train", (png, "p"), "f", "French", 13)]
    df = spark.createDataFrame(data, "line_id bigint, split string, im struct<bytes:binary,path:string>, text string, language string, century tinyint")
    got = corpus.extract_lines(df, ["train", "test"], ["line_id"], "French", 13)
    assert rows(got.select("line_idx", "line_id", "text", "stem")) == [(0, 1, "a", "line_000000"), (1, 6, "f", "line_000001"), (2, 3, "c", "line_000002")]
    assert rows(corpus.extract_lines(df, ["train", "test"], ["line_id"], "French", 13, 1).select("line_id")) == [(1,), (3,)]


def test_writing_lines_counts_them(spark, tmp_path):
    df = spark.createDataFrame([("train", "a"), ("test", "b"), ("train", "c")], "split string, text string")
    assert files.write_lines(df, str(tmp_path / "o")) == {"train": 2, "test": 1}


def test_many_tokens(spark):
    from folioscope.functions.editdist import token_distance

    n = 7000
    pair = spark.createDataFrame([([f"a{i}" for i in range(n)], [f"a{i}" for i in range(1, n)] + ["b"])], "a array<string>, b array<string>")
    assert pair.select(token_distance(F.col("a"), F.col("b"))).first()[0] == 2
