"""Operators against stated values and plain implementations."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import editdist, geometry, text
from folioscope.operators import corpus, lexicon, metrics, runs, segmentation, training
from folioscope.sources import alto
from tests.conftest import rows


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(c.alias("x")).first().x if values else spark.range(1).select(c.alias("x")).first().x


# --- text ---


def test_text_rules(spark):
    t = lambda f, s: one(spark, f(F.col("t")), t=s)
    assert t(text.normalize_for_cer, "Vie  Jour ſont") == "Uie Iour sont"
    assert t(text.nfc, "é") == "é" and t(text.nfd, "é") == "é"
    assert t(text.collapse_whitespace, " a \t b\n\x1c") == "a b" and t(text.collapse_whitespace, "") == ""
    assert t(text.tokens, " a　b ") == ["a", "b"] and t(text.tokens, "") == []
    assert [s.step for s in t(text.normalize_steps, "v")] == ["raw", "+nfc", "+u/v", "+i/j", "+long_s", "+spaces"]
    assert t(text.expand_abbreviations, "a ⁊ b") == "a et b" and t(text.expand_abbreviations, "ã ẼT q̃") == "an EnT q̃"
    assert t(lambda c: text.expand_abbreviations(c, {"b": "bo"}), "a⁊b") == "a⁊bo" and t(lambda c: text.expand_abbreviations(c, {}), "⁊") == "et"
    assert t(text.residual_abbreviations, "ꝑ ⁊ ã q̃ ͤ") == 5 and t(text.residual_abbreviations, "abc") == 0
    assert tuple(t(text.split_affixes, "«(mot)».")) == ("«(", "mot", ")».") and tuple(t(text.split_affixes, "...")) == ("...", "", "")
    assert t(text.strip_ansi, "\x1b[31mx\x1b[0m") == "x" and t(text.label_before_bracket, "Li (2)") == "Li" and t(text.non_blank_lines, "a\n \nb") == 2
    assert one(spark, text.percent(F.lit(0.1234))) == "12.34%"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=60))
def test_whitespace_like_python(spark, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) <= 0xDFFF for c in t)] or [""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.collapse_whitespace(F.col("t")).alias("c"), text.tokens(F.col("t")).alias("w"), text.nfc(F.col("t")).alias("n")).collect()
    for r in got:
        assert r.c == " ".join(texts[r.i].split()) and r.w == texts[r.i].split() and r.n == unicodedata.normalize("NFC", texts[r.i])


# --- error rates ---


@pytest.mark.parametrize("ref,hyp,cer", [("bonjour", "bnnjour", 1 / 7), ("", "", 0.0), ("", "x", 1.0), ("a", "bcd", 3.0), (None, None, 0.0), ("été", "ete", 2 / 3)])
def test_cer(spark, ref, hyp, cer):
    df = spark.createDataFrame([(ref, hyp)], "ref string, hyp string")
    assert df.select(editdist.char_error_rate(F.col("ref"), F.col("hyp")).alias("x")).first().x == pytest.approx(cer)


def test_word_distance_random(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("abcdef") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))], [rng.choice("abcdef") for _ in range(rng.randint(0, 9))]) for _ in range(150)]
    pairs.append(([f"w{i}" for i in range(7000)], [f"w{i}" for i in range(1, 7001)]))  # more words than private signs
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>").select("i", editdist.token_distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        assert r.d == (levenshtein(*pairs[r.i]) if r.i < 150 else 2)


def test_corpus_metrics(spark):
    pairs = spark.createDataFrame([("abcd", "abcd"), ("ef", "xf")], "ref string, hyp string")
    m = metrics.corpus_metrics(pairs).first()
    assert m.cer == pytest.approx(1 / 6) and m.n_chars == 6 and m.n_lines == 2 and m.wer == 0.5
    z = metrics.corpus_metrics(pairs.limit(0)).first()
    assert (z.cer, z.wer, z.n_lines, z.n_chars) == (0.0, 0.0, 0, 0)
    only_empty = metrics.corpus_metrics(spark.createDataFrame([("", "abc"), (None, None)], "ref string, hyp string")).first()
    assert only_empty.cer == 0.0 and only_empty.n_lines == 2


def test_worst(spark):
    pairs = spark.createDataFrame([(1, "abc", "abc"), (2, "abc", "xyz"), (3, "abc", "xyz"), (4, "ab", "xb")], "i int, ref string, hyp string")
    assert [r.i for r in metrics.worst_predictions(pairs, 3, ["i"]).collect()] == [2, 3, 4]


def test_bootstrap(spark):
    rng = random.Random(1)
    data = [(i, rng.randint(0, 8), 40, rng.randint(0, 3), 7) for i in range(400)]
    d = spark.createDataFrame(data, "i bigint, d_chars bigint, n_chars bigint, d_words bigint, n_words bigint")
    a = metrics.bootstrap_ci(d, F.col("i")).first()
    b = metrics.bootstrap_ci_drawn(d, ["i"], seed=13).first()
    mean = sum(x[1] for x in data) / 16_000
    assert a.cer_lo < mean < a.cer_hi and a.cer_lo == pytest.approx(b.cer_lo, abs=0.004) and a.cer_hi == pytest.approx(b.cer_hi, abs=0.004)
    gen, rates = random.Random(13), []
    for _ in range(1000):
        k = [gen.randint(0, 399) for _ in range(400)]
        rates.append(sum(data[x][1] for x in k) / 16_000)
    rates.sort()
    assert (b.cer_lo, b.cer_hi) == (rates[25], rates[974])
    assert metrics.bootstrap_ci(d.limit(0), F.col("i")).count() == 0 == metrics.bootstrap_ci_drawn(d.limit(0), ["i"]).count()
    times = spark.range(200_000).select(metrics.draws(F.col("id"), F.lit(7).cast("bigint")).alias("m")).agg(F.avg("m"), F.variance("m")).first()
    assert times[0] == pytest.approx(1, abs=0.02) and times[1] == pytest.approx(1, abs=0.05)


# --- corpus ---

CORPUS = "im struct<bytes: binary, path: string>, text string, language string, century tinyint, split string, line_id bigint"


def corpus_rows():
    img = (b"\x89PNG\r\n\x1a\n..", "p")
    return [(img, "un", "French", 13, "train", 1), (img, " deus ", "French", 13, "test", 2), (img, "  ", "French", 13, "train", 3), (img, "latin", "Latin", 13, "train", 4), (img, "late", "French", 14, "train", 5), (img, "treis", "French", 13, "train", 6), ((b"", "p"), "x", "French", 13, "train", 7), (None, "x", "French", 13, "train", 8), (img, None, None, None, None, None)]


def test_filter_and_number(spark):
    df = spark.createDataFrame(corpus_rows(), CORPUS)
    kept = corpus.filter_corpus(df, "French", 13)
    assert rows(kept.select("line_id", "text")) == [(1, "un"), (2, "deus"), (6, "treis")]
    n = corpus.number_lines(kept, ["train", "validation", "test"], ["line_id"])
    assert rows(n.select("line_id", "line_idx", "stem")) == [(1, 0, "line_000000"), (2, 2, "line_000002"), (6, 1, "line_000001")]
    assert rows(corpus.number_lines(kept, ["train", "test"], ["line_id"], 1).select("line_id", "line_idx")) == [(1, 0), (2, 1)]
    assert corpus.number_lines(kept.limit(0), ["train"], ["line_id"]).count() == 0


def test_filter_is_pushed_down(spark, tmp_path):
    spark.createDataFrame(corpus_rows(), CORPUS).write.parquet(str(tmp_path / "c"))
    plan = corpus.filter_corpus(spark.read.parquet(str(tmp_path / "c")), "French", 13).select("text")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(language," in plan and "struct<im:struct<bytes:binary>,text:string,language:string,century:tinyint>" in plan


def test_numbers_are_dense(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(13)
    got = corpus.number_rows(df, ["k"]).orderBy("k").collect()
    assert [r.idx for r in got] == list(range(5000))


def test_profiles(spark):
    t = spark.createDataFrame([("a", "aab ⁊"), ("a", "⁊"), ("b", ""), ("b", None)], "split string, text string")
    assert dict(rows(corpus.char_frequency(t)))["a"] == 2 and rows(corpus.char_frequency(t, only_special=True)) == [("⁊", 2)]
    s = {r.split: r for r in corpus.length_stats(t, ["split"]).collect()}
    assert s["a"].n_lines == 2 and s["a"].n_words == 3 and s["b"].n_lines == 1 and s["b"].n_chars == 0
    h = corpus.length_histogram(t, 3).collect()
    assert sum(r.n for r in h) == 3 and len(h) <= 3
    m = corpus.split_manifest(t).first()
    assert m.splits == {"a": 2, "b": 2} and m.total == 4
    assert rows(corpus.split_totals(t)) == [("a", 2, 0), ("b", 2, 0), (None, 4, 1)]
    e = corpus.split_manifest(t.limit(0)).first()
    assert e.total == 0 and not e.splits
    images, texts = spark.createDataFrame([("s2",), ("s1",)], "stem string"), spark.createDataFrame([("s1", "x")], "stem string, text string")
    assert [tuple(r) for r in corpus.sample_lines(images, texts, 8).collect()] == [("s1", "x"), ("s2", "")]


# --- lexicon ---


def test_lexicon(spark):
    lex = lexicon.load_lexicon(spark.createDataFrame([("Ensemble",), ("ensemble",), ("a",), ("x1",), (None,), ("comme",), ("dame",), ("homme",), (" roi ",)], "form string"))
    assert rows(lex) == [("comme",), ("dame",), ("ensemble",), ("homme",), ("roi",)]
    lines = spark.createDataFrame([(1, "li Eusemble, zzzzzz"), (2, "comne"), (3, None), (4, "")], "id int, t string")
    fixed = {r.id: r for r in lexicon.correct_lines(lines, ["id"], "t", lex).collect()}
    assert fixed[1].corrected == "roi ensemble, zzzzzz" and fixed[2].corrected == "comme" and fixed[1].n_changes == 2 and set(fixed) == {1, 2}
    assert fixed[1].changes[1].original == "Eusemble,"
    counts = spark.createDataFrame([("homme", 9)], "form string, n bigint")
    scored = {r.id: r.corrected for r in lexicon.correct_lines(lines, ["id"], "t", lex, lexicon.by_frequency(counts)).collect()}
    assert scored[2] == "homme"


def test_candidates_like_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    words, forms = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    got = rows(lexicon.candidates(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(f,) for f in forms], "form string"), k=None).select("word", "form", "distance"))
    want = sorted((w, f, levenshtein(w, f)) for w in words for f in forms if abs(len(w) - len(f)) <= 2 and levenshtein(w, f) <= 2)
    assert got == sorted(want, key=repr)


# --- training ---


def test_early_stopping(spark):
    curve = lambda xs: spark.createDataFrame(list(enumerate(xs)), "epoch int, cer double")
    r = training.early_stopping(curve([0.40, 0.20, 0.06, 0.07, 0.065, 0.066]), 3).first()
    assert (r.best_epoch, r.stop_epoch, r.stalled) == (2, 5, [3, 4, 5])
    up = training.early_stopping(curve([0.3, 0.2, 0.1]), 3).first()
    assert up.stop_epoch is None and up.stalled == [] and up.best_epoch == 2
    none = training.early_stopping(spark.createDataFrame([], "epoch int, cer double"), 3).first()
    assert none.best_epoch is None and none.stop_epoch is None
    rng = random.Random(2)
    for _ in range(4):
        xs = [rng.choice([None, round(rng.random(), 1)]) for _ in range(12)]
        best, stall, stop, stalled, at = float("inf"), 0, None, [], None
        for i, x in enumerate(xs):
            x = float("inf") if x is None else x
            if x < best:
                best, stall, at = x, 0, i
            else:
                stall += 1
                stalled.append(i)
                stop = i if stop is None and stall >= 3 else stop
        r = training.early_stopping(curve(xs), 3).first()
        assert (r.best_epoch, r.stop_epoch, r.stalled) == (at, stop, stalled)


def test_logs(spark):
    log = "x Accuracy report (2) 0.9213 1000 79\nnoise\nAccuracy report (1) 0.5\n"
    got = rows(training.parse_log(spark.createDataFrame([(log,), (None,), ("",)], "value string")))
    assert got == [(1, 0.5, 0.5, None, None), (2, 0.9213, 0.0787, 1000, 79)]
    line = "\x1b[1mstage {}/50 ━━━ 120/120 0:01:40 \x1b[0mval_accuracy: {} val_word_accuracy: {} early_stopping: 3/10 {}"
    lines = [(1, line.format(3, 0.5, 0.2, 0.5)), (2, line.format(3, 0.6, 0.3, 0.95533)), (3, "other"), (4, "stage 4/50 val_accuracy: 0.7"), (5, None)]
    assert rows(training.parse_stage_log(spark.createDataFrame(lines, "line_no int, value string"))) == [(3, 0.6, 0.4, 0.3, 0.7, 0.95533)]
    m = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "epoch int, accuracy double")
    assert tuple(training.best_epoch(m, "accuracy").first()) == (2, 0.9) and tuple(training.best_epoch(m, "accuracy", lowest=True).first()) == (1, 0.5)
    assert [round(r.accuracy, 6) for r in training.anchor_curve(m, 0.95).orderBy("epoch").collect()] == [0.55, 0.95, 0.95]


# --- geometry ---


def test_points_and_boxes(spark):
    p = lambda s: one(spark, geometry.points(F.col("t")), t=s)
    assert p("1,2 3.9 -4.9 7") == [[1, 2], [3, -4]] and p("") == [] and p("5") == []
    assert one(spark, geometry.baseline_to_box(geometry.points(F.lit("10 100 300 110")))) == [[10, 80], [300, 80], [300, 130], [10, 130]]
    box = lambda *b: F.struct(*[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), b)])
    assert one(spark, geometry.iou(box(0, 0, 10, 10), box(0, 0, 10, 10))) == 1.0
    assert one(spark, geometry.iou(box(0, 0, 10, 10), box(10, 0, 20, 10))) == 0.0
    assert one(spark, geometry.iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(1 / 3)


def test_greedy_like_loop(spark):
    rng = random.Random(4)
    made = []
    for page in range(120):
        box = lambda: (lambda x, y: (x, y, x + rng.randint(1, 30), y + rng.randint(1, 30)))(rng.randint(0, 30), rng.randint(0, 30))
        made.append((page, [box() for _ in range(rng.randint(0, 5))], [box() for _ in range(rng.randint(0, 5))]))
    kind = "array<struct<x0:int,y0:int,x1:int,y1:int>>"
    got = {r.page: r for r in segmentation.page_iou(spark.createDataFrame(made, f"page int, truth {kind}, found {kind}")).collect()}

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    for page, truth, found in made:
        used, ious = set(), []
        for t in truth:
            best, at = 0.0, None
            for j, f in enumerate(found):
                if j not in used and iou(t, f) > best:
                    best, at = iou(t, f), j
            used.add(at)
            ious.append(best)
        assert got[page].n_lines == len(truth) and got[page].iou_mean == pytest.approx(sum(ious) / len(ious) if ious else 0.0)
    m = segmentation.manuscript_iou(spark.createDataFrame([("a", 0.5, 1.0, 3), ("a", 0.7, 0.0, 5), ("a", None, None, None)], "manuscript string, iou_mean double, iou_share double, n_lines bigint")).first()
    assert (m.iou_mean, m.n_lines, m.pages) == (pytest.approx(0.6), 8, 3)
    assert segmentation.overall_iou(spark.createDataFrame([(0.8535, 0.8, 424), (0.7168, 0.5, 711)], "iou_mean double, iou_share double, n_lines bigint")).first().iou_mean == pytest.approx(0.78515)


# --- pages ---

PAGE = """<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Description><sourceImageInformation><fileName>i.jpg</fileName></sourceImageInformation></Description>
<Layout><Page WIDTH="1000" HEIGHT="2000"><PrintSpace><TextBlock><TextLine ID="a" BASELINE="10 20 30 20"><Shape><Polygon POINTS="1 2 3 4.7"/></Shape>
<String CONTENT="li"><Glyph CONTENT="l" GC="0.99"/><Glyph CONTENT="i" GC="0.98"/></String><String CONTENT="rois"><Glyph CONTENT="r" GC="0.97"/></String></TextLine>
<TextLine><String CONTENT="xx"><Glyph CONTENT="x" GC="0.4"/></String></TextLine><TextLine BASELINE="1 1 2 2"/></TextBlock></PrintSpace></Page></Layout></alto>"""
LOOSE = '<alto><Layout><Page><PrintSpace><TextLine><String CONTENT="li"/><String CONTENT="rois"/></TextLine><TextLine><String CONTENT="de France"/></TextLine></PrintSpace></Page></Layout></alto>'
DEEP = '<a:alto xmlns:a="x"><a:Layout><a:ComposedBlock><a:TextLine><a:String CONTENT="deep"/></a:TextLine></a:ComposedBlock></a:Layout></a:alto>'


def test_page_xml(spark):
    df = spark.createDataFrame([(1, PAGE), (2, LOOSE), (3, "<broken"), (4, ""), (5, None), (6, DEEP)], "id int, xml string")
    c = {r.id: r.contract for r in alto.to_contract(df).collect()}
    assert c[1].source_image == "i.jpg" and c[1].page.width == 1000 and [x.id for x in c[1].lines] == ["a", "line_1"]
    first, second = c[1].lines
    assert first.text == "li rois" and first.polygon == [[1, 2], [3, 4]] and first.baseline == [[10, 20], [30, 20]] and first.mean_confidence == 0.98 and not first.needs_review
    assert second.mean_confidence == 0.4 and second.needs_review and c[3] is None and c[4] is None and c[5] is None
    t = {r.id: (r.t, r.g, r.b) for r in df.select("id", alto.plain_text(F.col("xml")).alias("t"), alto.true_lines(F.col("xml")).alias("g"), alto.baselines(F.col("xml")).alias("b")).collect()}
    assert t[1][0] == "li rois\nxx" and t[2][0] == "li rois\nde France" and t[3][0] == "" == t[4][0] == t[5][0]
    assert t[1][1] == ["li rois", "xx"] and t[1][2].baselines == [[[10, 20], [30, 20]], [[1, 1], [2, 2]]] and t[1][2].texts == ["li", ""]
    deep = {r.id: r.texts for r in alto.text_any_nesting(df, "id").collect()}
    assert deep[6] == ["deep"] and deep[1] == ["li rois", "xx", ""] and deep[3] == [] == deep[5]
    assert {r.id: r.texts for r in alto.text_any_nesting(df, "id", strict=True).collect()}[6] == []
    j = lambda s: one(spark, alto.segmenter_baselines(F.col("t")), t=s)
    assert j('{"lines": [{"baseline": [[1.9, 2], [3, 4]]}, {"x": 1}]}') == [[[1, 2], [3, 4]]] and j("{}") == [] and j("broken") == []


def test_contract_validation(spark, tmp_path):
    df = spark.createDataFrame([(1, PAGE)], "id int, xml string")
    good = alto.to_contract(df)
    alto.save_contracts(good, "id", str(tmp_path / "c"))
    bad = spark.createDataFrame([(1, '{"lines":[{"id":"x"}]}'), (2, "no json"), (3, alto.empty_contract()), (4, '{"source_image":1,"page":{},"review_threshold":"high","lines":3}')], "id int, contract string")
    got = rows(alto.contract_violations(bad, "id"))
    assert {g[1] for g in got if g[0] == 1} == {"missing source_image", "line missing text", "line missing char_confidences", "line missing mean_confidence", "line missing needs_review"}
    assert (2, "invalid json") in got and not [g for g in got if g[0] == 3]
    assert {g[1] for g in got if g[0] == 4} == {"type source_image", "type lines", "type review_threshold"}


def test_page_scores(spark):
    line = "struct<text:string,mean_confidence:double,needs_review:boolean>"
    pages = spark.createDataFrame([(1, [("abcd", 0.9, False), ("xx", 0.4, True)], ["abcd", "ef"]), (2, [("a", None, None)], []), (3, [], None)], f"id int, lines array<{line}>, truth array<string>")
    e = {r.id: r for r in runs.evaluate_pages(pages).collect()}
    assert e[1].n_lines == 2 and e[1].n_review == 1 and e[1].cer_raw == pytest.approx(2 / 7) and e[1].cer_reviewed == pytest.approx(3 / 7) and e[1].mean_confidence == pytest.approx(0.65)
    assert e[2].cer_raw == 0.0 and e[3].n_lines == 0
    a = runs.aggregate_pages(runs.evaluate_pages(pages)).first()
    assert a.n_pages == 3 and a.n_lines == 3 and a.needs_review_rate == pytest.approx(1 / 3)
    assert runs.aggregate_pages(runs.evaluate_pages(pages.limit(0))).count() == 0
    assert one(spark, runs.mean_confidence(F.array(F.lit(0.69994), F.lit(0.7)))) == 0.7 and one(spark, runs.mean_confidence(F.array().cast("array<double>"))) == 0.0


def test_runs_are_appended(spark, tmp_path):
    r, l = str(tmp_path / "runs"), str(tmp_path / "lines")
    run, lines = spark.createDataFrame([("m",)], "manuscript string"), spark.createDataFrame([(0, "x"), (1, "y")], "line_index int, text_raw string")
    assert runs.append_run(r, l, run, lines) == 1 and runs.append_run(r, l, run, lines) == 2
    assert spark.read.parquet(l).where("run_id = 2").count() == 2 and runs.latest_runs(spark.read.parquet(r), 1).count() == 1
