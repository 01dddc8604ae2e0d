"""Problem 5: training over all lines, titles without limits of number or length, nearest forms, results by chunk."""

import random

import pytest

from folioscope.llm import noise
from folioscope.llm.overlap import edit_distance
from tests.conftest import rows
from tests.llm.test_noise_whole import FORMS


def plain_path(model, symbols):
    """Viterbi by the definition, first state on ties."""
    import math

    local = [[sum(math.log(model.emit[s][f][v]) for f, v in enumerate(x)) for s in range(3)] for x in symbols]
    score, back = [math.log(p) + x for p, x in zip(model.first, local[0])], []
    for x in local[1:]:
        came = [max(range(3), key=lambda r: score[r] + math.log(model.move[r][s])) for s in range(3)]
        score = [score[came[s]] + math.log(model.move[came[s]][s]) + x[s] for s in range(3)]
        back.append(came)
    path = [max(range(3), key=score.__getitem__)]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def test_best_paths_and_training():
    rng = random.Random(2)
    sequences = [[rng.choice(noise.SYMBOLS) for _ in range(rng.randint(1, 40))] for _ in range(30)]
    model = noise.LineModel()
    for s in sequences:
        assert model.label(s) == plain_path(model, s)
    fitted = model.fit(sequences)
    # Counts of parts add up, whatever the parts.
    coded = [[noise.code(x) for x in s] for s in sequences]
    assert (model.counts(coded) == model.counts(coded[:7]) + model.counts(coded[7:])).all()
    assert sum(fitted.first) == pytest.approx(1) and all(sum(m) == pytest.approx(1) for m in fitted.move) and all(sum(f) == pytest.approx(1) for e in fitted.emit for f in e)
    assert model.label([]) == []


def test_nearest_like_comparing_with_all():
    rng = random.Random(3)
    word = lambda a, z: "".join(rng.choice("abcé") for _ in range(rng.randint(a, z)))
    forms = [word(1, 9) for _ in range(300)] + [word(60, 70) for _ in range(20)]
    v = noise.Vocabulary(forms, [])
    for w in [word(0, 9) for _ in range(150)] + ["zzz", "", forms[-1] + "a", forms[-1][:62]]:
        for limit in (1, 2, 3):
            d = {f: edit_distance(w, f, limit) for f in v.known}
            best = min(d.values())
            want = (best, sorted(f for f in d if d[f] == best)) if best <= limit else (limit + 1, [])
            got = v.nearest(w, limit)
            assert (got[0], sorted(got[1])) == want
    assert noise.Vocabulary([], []).nearest("a") == (3, [])


def many_titles():
    """A run with eight titles, one of them long, each on three pages."""
    rng = random.Random(5)
    long = " ".join(["LI", "LIVRES"] + ["DE", "LA", "CORT"] * 8)
    titles = [f"LI ROMANS {a} {b}" for a, b in (("PREMIER", "MELOMAR"), ("SECONT", "TRISIRONDE"), ("TIERZ", "AUBEDANT"), ("QUART", "FALOMIN"), ("QUINT", "GERBELAN"), ("SISTE", "HUONEL"), ("SETME", "IVORAT"))] + [long]
    lines, want = [], {}
    for t in titles:
        for _ in range(3):
            want[len(lines)] = "header"
            lines.append(t)
            for _ in range(9):
                lines.append(" ".join(rng.sample(FORMS, 7)) + " " + rng.choice(FORMS))
    return lines, want


def test_all_titles_of_a_run(spark):
    lines, want = many_titles()
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "run_id bigint, line_index int, text_raw string")
    lexicon = spark.createDataFrame([(f,) for f in FORMS], "form string")
    got = {r.line_index: r.noise for r in noise.line_noise(df, lexicon).collect() if r.noise == "header"}
    assert got == want


def test_openings_do_not_depend_on_the_number_of_runs(spark):
    some = [(i, f"Le romans de {n}") for i, n in enumerate(("Melomar", "Trisironde", "Aubedant"))] + [(3, "La vie Huonel"), (4, "La vie Ivorat"), (5, "La vie Ivorat")]
    df = spark.createDataFrame(some, "run_id bigint, title string")
    assert noise.title_openings(df) == ["leromansde"]
    more = df.unionByName(spark.range(10, 5000).selectExpr("id as run_id", "concat('Titre', id) as title"))
    assert noise.title_openings(more) == ["leromansde"] and noise.title_openings(None) == []


@pytest.mark.parametrize("seed", range(4))
def test_chunks_agree(spark, monkeypatch, seed):
    rng = random.Random(seed)
    lines = []
    for page in range(20):
        lines += ["LI ROMANS DE MELOMAR"] * (rng.random() < 0.7) + [str(page)] * (rng.random() < 0.5)
        for _ in range(rng.randint(3, 12)):
            words = rng.sample(FORMS, 6)
            lines.append(" ".join(words)[: rng.randint(9, 30)] + rng.choice(["", "-", "", ""]))
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "run_id bigint, line_index int, text_raw string")
    lexicon = spark.createDataFrame([(f,) for f in FORMS], "form string")
    whole = rows(noise.line_noise(df, lexicon))
    model = noise.fit_model(noise.line_symbols(noise.prepared_lines(df), noise.run_titles(noise.prepared_lines(df), None), []))
    monkeypatch.setattr(noise, "CHUNK", 23)
    monkeypatch.setattr(noise, "MARGIN", 11)
    monkeypatch.setattr(noise, "fit_model", lambda symbols: model)  # chunks begin anew in training
    assert rows(noise.line_noise(df, lexicon)) == whole


def test_family_names_are_known(spark):
    labelled = spark.createDataFrame([("li rois", "body")], "clean string, label string")
    names = spark.createDataFrame([("Anne", "given"), ("Arbnay", "family")], "form string, role string")
    v = noise.vocabulary_of(spark.createDataFrame([("li",), ("rois",)], "form string"), labelled, names)
    assert v.names == {"anne"} and v.has("Arbnay") and v.has("Anne") and not v.has("Arbnoy")
