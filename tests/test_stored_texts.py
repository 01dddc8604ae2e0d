"""Registered queries on stored texts against plain Python: characters that one ASCII sign would merge stay different."""

import random
import re
import unicodedata

import pytest

from folioscope.plans import reference
from tests.test_operators import levenshtein

#: Letters outside the coded ones, odd spaces, a long s, and a letter with a separate mark.
PAIRS = [("ñor ŷ", "ŷor ñ"), ("li rois vint", "li rois vint"), ("κύριε", "ἐλέησ"), ("a　b c", "a b c"), ("ſeigneur", "seigneur"), ("été", "été"), ("vie", "uie"), ("", "x"), ("jour", None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    sign = lambda: "".join(rng.choice("ñŷκλ   a") for _ in range(rng.randint(1, 12)))
    pairs = PAIRS + [(sign(), sign()) for _ in range(40)]
    d = tmp_path_factory.mktemp("stored")
    rows = [(1 + i % 2, i, hyp, ref, 0.9, False) for i, (ref, hyp) in enumerate(pairs)]
    spark.createDataFrame(rows, "run_id bigint, line_index int, text_raw string, text_gt string, mean_confidence double, needs_review boolean").write.parquet(f"{d}/run_lines.parquet")
    spark.createDataFrame([(1, "A"), (2, "B")], "run_id bigint, manuscript string").write.parquet(f"{d}/runs.parquet")
    spark.createDataFrame([("ñañ",), ("λκλκ",), ("roi",)], "form string").write.parquet(f"{d}/lexicon.parquet")
    return str(d), [(ref, hyp or "") for ref, hyp in pairs]


def micro(pairs):
    chars, words = sum(len(r) for r, _ in pairs), sum(len(r.split()) for r, _ in pairs)
    return sum(levenshtein(r, h) for r, h in pairs) / chars, sum(levenshtein(r.split(), h.split()) for r, h in pairs) / words, len(pairs), chars, words


def test_error_rates(spark, folder):
    d, pairs = folder
    rate = lambda r, h: levenshtein(r, h) / len(r) if r else float(bool(h))
    got = {r.line_index: r for r in reference.line_error_rates(spark, d).collect()}
    assert len(got) == len(pairs)
    for i, (r, h) in enumerate(pairs):
        assert got[i].cer == pytest.approx(rate(r, h)) and got[i].wer == pytest.approx(rate(r.split(), h.split()))
    assert tuple(reference.corpus_metrics(spark, d).first()) == pytest.approx(micro(pairs))
    by = {r.manuscript: tuple(r)[1:] for r in reference.corpus_metrics_by_manuscript(spark, d).collect()}
    assert by["A"] == pytest.approx(micro(pairs[::2])) and by["B"] == pytest.approx(micro(pairs[1::2]))
    worst = sorted(range(len(pairs)), key=lambda i: (-rate(*pairs[i]), 1 + i % 2, i))[:10]
    assert [r.line_index for r in reference.worst_predictions(spark, d).collect()] == worst


def test_pages(spark, folder):
    d, pairs = folder
    got = {(r.run_id, r.page): r for r in reference.page_eval(spark, d).collect()}
    for run in (1, 2):
        for page in (0, 1):
            of = [p for i, p in enumerate(pairs) if 1 + i % 2 == run and i // 30 == page]
            ref, hyp = (" ".join(x) for x in zip(*of))
            assert got[run, page].cer_raw == pytest.approx(levenshtein(hyp, ref) / len(ref))


def test_candidates(spark, folder):
    d, pairs = folder
    got = {(r.word, r.form): r.distance for r in reference.lexicon_candidates(spark, d).collect()}
    words = {r.word for r in reference.unknown_words(spark, d).collect()}
    forms = ["ñañ", "λκλκ", "roi"]
    assert got == {(w, f): n for w in words for f in forms if abs(len(w) - len(f)) <= 2 and (n := levenshtein(w, f)) <= 2}
    assert got


def normal(t):
    t = unicodedata.normalize("NFC", t).translate(str.maketrans("vVjJſ", "uUiIs"))
    return re.sub(r"\s+", " ", t).strip()


def test_normalized_with_all_steps(spark, folder):
    d, pairs = folder
    plain = [(normal(r), normal(h)) for r, h in pairs]
    got = {r.stage: r.cer for r in reference.cer_before_after(spark, d).collect()}
    assert got["raw"] == pytest.approx(micro(pairs)[0]) and got["normalized"] == pytest.approx(micro(plain)[0])
    pages = {(r.run_id, r.page): r.cer_normalized for r in reference.page_eval(spark, d).collect()}
    want = {}
    for run in (1, 2):
        for page in (0, 1):
            of = [p for i, p in enumerate(pairs) if 1 + i % 2 == run and i // 30 == page]
            ref, hyp = (normal(" ".join(x)) for x in zip(*of))
            want[run, page] = levenshtein(hyp, ref) / len(ref)
    assert pages == pytest.approx(want)
    for r in reference.aggregate_pages(spark, d).collect():
        assert r.cer_normalized == pytest.approx((want[r.run_id, 0] + want[r.run_id, 1]) / 2, abs=1e-6)
