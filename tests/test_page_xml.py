"""Page XML of any nesting, contracts, two page sets, manuscripts."""

import json
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from folioscope.operators import runs, segmentation
from folioscope.sources import alto
from tests.conftest import rows
from tests.test_operators import levenshtein

NS = alto.NAMESPACE


def made(rng):
    """A page of random nesting and its lines as (words, confidences, id)."""
    lines = []

    def line():
        words = [rng.choice(["li", "rois", "", "a&amp;b", "ſi"]) for _ in range(rng.randint(0, 4))]
        confs = [[round(rng.random(), 7) for _ in w] for w in words]
        own = f' ID="l{len(lines)}"' if rng.random() < 0.5 else ""
        base = ' BASELINE="10 20 30 20.7"' if rng.random() < 0.7 else ""
        lines.append(([w.replace("&amp;", "&") for w in words], [c for g in confs for c in g], own[5:-1] or None, bool(base)))
        return f"<TextLine{own}{base}>" + "".join(f'<String CONTENT="{w}">' + "".join(f'<Glyph CONTENT="x" GC="{c}"/>' for c in g) + "</String><SP/>" for w, g in zip(words, confs)) + "</TextLine>"

    def block(depth):
        if depth and rng.random() < 0.4:
            return "<ComposedBlock>" + "".join(block(depth - 1) for _ in range(rng.randint(1, 2))) + "</ComposedBlock>"
        return "<TextBlock>" + "".join(line() for _ in range(rng.randint(0, 3))) + "</TextBlock>" if rng.random() < 0.8 else line()

    pages = "".join(f'<Page WIDTH="9" HEIGHT="8"><PrintSpace>{"".join(block(2) for _ in range(rng.randint(0, 3)))}</PrintSpace></Page>' for _ in range(rng.choice((1, 1, 2))))
    return f'<alto xmlns="{NS}"><Description><sourceImageInformation><fileName> i.jpg\n</fileName></sourceImageInformation></Description><Layout>{pages}</Layout></alto>', lines


def test_any_nesting(spark):
    rng = random.Random(8)
    pages = [made(rng) for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(pages)] + [(900, None), (901, "no xml <TextLine/>")], "id int, xml string")
    got = {r.id: r for r in alto.to_contract(df, model="m").select("id", "contract").join(df.select("id", alto.plain_text(F.col("xml")).alias("t"), alto.true_lines(F.col("xml")).alias("g"), alto.baselines(F.col("xml"), F.lit("n")).alias("b")), "id").collect()}
    nested = 0
    for i, (x, lines) in enumerate(pages):
        nested += "ComposedBlock" in x or x.count("<Page ") > 1
        want = [(k, own, " ".join(w for w in words if w), confs) for k, (words, confs, own, _) in enumerate(lines) if any(words)]
        c = got[i].contract
        assert [(z.id, z.text, z.char_confidences) for z in c.lines] == [(own or f"line_{k}", t, [round(v, 4) for v in confs]) for k, own, t, confs in want]
        for z, (*_, confs) in zip(c.lines, want):
            mean = round(sum(round(v, 4) for v in confs) / len(confs), 4) if confs else 0.0
            assert z.mean_confidence == pytest.approx(mean, abs=1.1e-4) and z.needs_review == (z.mean_confidence < 0.7) and z.candidates == []
        assert (c.source_image, c.model, c.page.width, c.page.height) == ("i.jpg", "m", 9, 8)
        assert got[i].g == [t for _, _, t, _ in want] and got[i].t == "\n".join(got[i].g)
        assert len(got[i].b.baselines) == sum(b for *_, b in lines) and got[i].b.image == "i.jpg"
        ET.fromstring(x)
    assert nested > 10 and got[900].contract is None and got[901].contract is None and got[901].t == "" and got[901].g is None


def test_contract_image(spark):
    xml = "<alto><Layout><TextLine><String CONTENT='a'/></TextLine></Layout></alto>"
    df = spark.createDataFrame([(1, xml, None), (2, xml, "own.png"), (3, xml, "")], "id int, xml string, image string")
    assert rows(alto.to_contract(df, source_image=F.col("image")).select("id", "contract.source_image")) == [(1, "unknown"), (2, "own.png"), (3, "unknown")]
    good = alto.to_contract(df)
    as_json = good.select("id", F.to_json("contract", {"ignoreNullFields": "false"}).alias("contract"))
    assert alto.contract_violations(as_json, "id").count() == 0
    assert json.loads(as_json.first().contract)["lines"][0]["candidates"] == []
    assert df.select(alto.baselines(F.col("xml"), F.lit("p1"))["image"].alias("i")).first()[0] == "p1.jpg"


def test_two_page_sets(spark):
    page = lambda lines: "<alto><Layout><Page><TextBlock>" + "".join(f"<TextLine><String CONTENT='{t}'><Glyph GC='{c}'/></String></TextLine>" for t, c in lines) + "</TextBlock></Page></Layout></alto>"
    found = spark.createDataFrame([("a", page([("li rois", 0.9), ("vint", 0.2), ("", 0.9)])), ("b", "broken"), ("c", page([("x", 0.9)]))], "page string, xml string")
    truth = spark.createDataFrame([("a", page([("li roys", 1), ("uint", 1)])), ("b", page([("x", 1)]))], "page string, xml string")
    got = {r.page: r for r in runs.evaluate_contracts(alto.page_pairs(found, truth, ["page"])).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    gt = "li roys uint"
    assert (a.n_lines, a.n_lines_kept, a.n_lines_gt, a.n_review, a.mean_confidence) == (2, 1, 2, 1, 0.55)
    assert (a.cer_raw, a.cer_reviewed, a.cer_normalized) == tuple(round(levenshtein(x, y) / len(y), 4) for x, y in (("li rois vint", gt), ("li rois", gt), ("li rois", gt)))
    assert (b.n_lines, b.n_lines_gt, b.cer_raw, b.mean_confidence) == (0, 1, 1.0, 0.0)


def test_manuscripts(spark):
    base = lambda *ys: [[[0, y], [100, y]] for y in ys]
    kind = "array<array<array<int>>>"
    pages = spark.createDataFrame([("m", "p1", ("a.jpg", base(50, 200))), ("m", "p2", ("b.jpg", base(50))), ("m", "p3", ("c.jpg", base(9))), ("n", "p1", ("z.jpg", base(5))), ("m", "p4", ("a.jpg", []))], f"manuscript string, page string, true struct<image:string,baselines:{kind}>")
    images = spark.createDataFrame([("m", "a.jpg"), ("m", "b.jpg"), ("n", "a.jpg"), ("m", "a.jpg")], "manuscript string, image string")
    segments = spark.createDataFrame([("m", "p1", base(50)), ("m", "p4", base(1)), ("n", "p1", base(5))], f"manuscript string, page string, found {kind}")
    got = {r.manuscript: r for r in segmentation.evaluate_manuscripts(pages, images, segments).collect()}
    assert (got["m"].iou_mean, got["m"].iou_share, got["m"].n_lines, got["m"].pages, got["m"].reached) == (0.25, 0.25, 2, 4, False)
    assert (got["n"].iou_mean, got["n"].n_lines, got["n"].pages) == (None, 0, 1)
