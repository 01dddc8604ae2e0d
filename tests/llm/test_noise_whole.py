"""Problem 5 on tables of any size."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm import noise, queries
from folioscope.llm.overlap import edit_distance

FORMS = "li rois vint a la grant cort et si parla".split()


def chosen(found, plain):
    """The rules of names on one machine."""
    heads, tails = defaultdict(set), defaultdict(set)
    for w in map(str.lower, found):
        for i in range(2, len(w) - 2):
            heads[w[:i]].add(w)
            tails[w[i:]].add(w)
    parted = lambda w: any(len(heads[w[:i]]) >= 3 and len(tails[w[i:]]) >= 3 and not heads[w[:i]] & tails[w[i:]] - {w} for i in range(2, len(w) - 2))
    misread = lambda w, n: bool(plain.nearest(w, 1)[1]) or any(m >= 8 * n and edit_distance(w, x, 2) <= 2 for x, m in found.items())
    return sorted(w for w, n in found.items() if (n >= 2 or parted(w.lower())) and not misread(w, n))


def test_names_do_not_depend_on_the_table(spark):
    found = {h + t: 1 for h in ("Melo", "Trisi", "Aube") for t in ("mar", "ronde", "dant")} | {"Perceval": 20, "Pencevul": 2, "Xanfrit": 2, "Zorgnax": 1, "Grent": 2}
    texts = [f"li {w} vint" for w, n in found.items() for _ in range(n)]
    small = spark.createDataFrame([(t, "body") for t in texts], "clean string, label string")
    want = chosen(found, noise.Vocabulary(FORMS, []))
    assert "Melomar" in want and "Xanfrit" in want and not {"Zorgnax", "Pencevul", "Grent"} & set(want)
    assert sorted(noise.proper_names(small, FORMS, [])) == want
    large = small.unionByName(spark.range(30_000).select(F.lit("li rois vint").alias("clean"), F.lit("body").alias("label")))
    assert sorted(noise.proper_names(large, FORMS, [])) == want


def test_too_many_names_are_refused(spark, monkeypatch):
    monkeypatch.setattr(noise, "MAX_FORMS", 1)
    lines = spark.createDataFrame([(f"li {w} vint", "body") for w in ("Xanfrit", "Perceval") * 2], "clean string, label string")
    with pytest.raises(ValueError, match="names"):
        noise.proper_names(lines, FORMS, [])


def test_paragraphs_of_a_run(spark, monkeypatch):
    """Paragraphs are joined, numbered and ended alike in one chunk and in many; long lines come first, short ones last."""
    rng = random.Random(6)
    long = lambda n: [" ".join(rng.sample(FORMS, 10)) for _ in range(n)]
    pairs = [f"{a} {b}" for a in FORMS for b in FORMS if a < b]  # no line stands twice, as a title does
    rng.shuffle(pairs)
    texts = long(40) + ["si parla."] + long(40) + pairs[:20] + ["a la cort."] + pairs[20:40] + long(1)
    lexicon = spark.createDataFrame([(f,) for f in FORMS], "form string")
    lines = spark.createDataFrame([(run, i, t) for run in (1, 2) for i, t in enumerate(texts)], "run_id bigint, line_index int, text_raw string")
    want = [" ".join(texts[:41]), " ".join(texts[41:102]), " ".join(texts[102:])]
    for chunk in (2000, 30):
        monkeypatch.setattr(noise, "CHUNK", chunk)
        monkeypatch.setattr(noise, "MARGIN", 10)
        got = sorted(map(tuple, noise.run_paragraphs(lines, lexicon).collect()))
        assert got == [(run, n, t) for run in (1, 2) for n, t in enumerate(want)]
    assert noise.run_paragraphs(lines.limit(0), lexicon).count() == 0


def test_text_query_gives_paragraphs(spark):
    df = queries.p5_text(spark, "/root/testdata/sf0.001")
    got = df.collect()
    assert df.columns == ["run_id", "paragraph_no", "text"] and got
    numbers = defaultdict(list)
    for r in got:
        numbers[r.run_id].append(r.paragraph_no)
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values()) and not any("\n" in r.text for r in got)


def test_too_many_name_forms_are_refused(spark, monkeypatch):
    monkeypatch.setattr(noise, "MAX_FORMS", 2)
    lexicon = spark.createDataFrame([("li",), ("rois",)], "form string")
    labelled = spark.createDataFrame([("li rois", "body")], "clean string, label string")
    names = spark.createDataFrame([(f, "given") for f in ("Anne", "Paul", "Marie")], "form string, role string")
    assert noise.vocabulary_of(lexicon, labelled, names.limit(2)).names == {"anne", "paul"}
    with pytest.raises(ValueError, match="name_forms"):
        noise.vocabulary_of(lexicon, labelled, names)
