"""The operators of the llm subpackage against brute force, round trips and stated cases."""

import os
import random
import re
import unicodedata
from collections import Counter

import pytest

from folioscope.llm import encode, leaks, lookalikes, noise, overlap, privacy, terms
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


# --- 1 ---


@pytest.mark.parametrize(
    "text,form,kinds",
    [
        (None, None, []),
        ("", "", []),
        ("roi ſaint ⁊ ꝑ · — q̃", "roi ſaint ⁊ ꝑ · — q̃", []),
        ("λόγος et roi", "λόγος et roi", []),
        ("r​oi­", "roi", ["invisible"]),
        ("a b　c", "a b c", ["space"]),
        ("ｒｏｉ", "roi", ["wide"]),
        ("ﬁn ĳ ⅱ ﬆ", "fin ij ii st", ["ligature"]),
        ("été", "été", ["decomposed"]),
        ("rоi", "roi", ["mixed_script"]),  # Cyrillic o
        ("ϲhoіr", "choir", ["mixed_script"]),  # lunate sigma, Cyrillic i
        ("ｒоi", "roi", ["mixed_script", "wide"]),
        ("роса", "poca", ["whole_script"]),
        ("ｑ̃", "q̃", ["wide"]),
    ],
)
def test_inspect(text, form, kinds):
    assert lookalikes.inspect(text) == (form, kinds)


def test_consistent_form_is_stable():
    rng = random.Random(1)
    alphabet = "aeéẽoir ſ⁊.· ​́̃оеіｅｏﬁⅱλός"
    for _ in range(2000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        once = lookalikes.inspect(t)[0]
        assert set(lookalikes.inspect(once)[1]) <= {"whole_script"} and unicodedata.normalize("NFC", once) == once


def test_fields(spark):
    df = spark.createDataFrame([(1, 0, "rоi", None, "", "x"), (1, 0, "rоi", None, "", "x"), (None, 1, "ok", "a b", "x" * 200_000, "y")], "run_id bigint, line_index int, text_raw string, text_normalized string, text_gt string, kinds string")
    cases = lookalikes.differing_fields(df, ["run_id", "line_index"], ["text_raw", "text_normalized", "text_gt"])
    assert rows(cases.select("run_id", "line_index", "field")) == [(1, 0, "text_raw"), (None, 1, "text_normalized")]
    fixed = lookalikes.normalize_fields(df, ["text_raw"])
    assert fixed.count() == 3 and fixed.first().text_raw == "roi" and fixed.first().kinds == "x"
    assert lookalikes.differing_fields(df.limit(0), ["run_id"], ["text_raw"]).count() == 0


# --- 2 ---


def test_terms_like_counting(spark, monkeypatch):
    rng = random.Random(2)
    words = ["Rei", "rei", "éte", "été", "ſaint", "λόγος", "q̃", "x1y", "--"]
    lines = [(i, " ".join(rng.choice(words[: 1 + i % 9]) for _ in range(rng.randint(0, 6))), "t") for i in range(300)] + [(7, None, "t"), (300, None, "t"), (301, "", "t"), (3, "zz", "t"), (302, "hapax", "t")]
    df = spark.createDataFrame(lines + lines[:50], "line_id bigint, text string, term string").repartition(7)
    best: dict = {}
    for i, t, _ in lines:
        if t is not None:
            best[i] = t if i not in best else min(best[i], t)
    occ, pres = Counter(), Counter()
    for t in best.values():
        w = re.findall(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*", unicodedata.normalize("NFC", t.lower()))
        occ.update(w)
        pres.update(set(w))
    mark = lambda k: "rare" if k < 3 else "common" if k > 0.05 * len(best) else None
    want = sorted(((t, occ[t], pres[t], len(best), mark(pres[t])) for t in occ), key=repr)
    got = terms.term_frequencies(df, "line_id", "text")
    assert rows(got.drop("term_id")) == want
    assert got.select("term_id").distinct().count() == len(want)
    assert terms.term_frequencies(df.limit(0), "line_id", "text").count() == 0


def test_term_blocks_add_up():
    import pyarrow as pa

    word = lambda i: "b" + chr(97 + i // 26) + chr(97 + i % 26)
    batches = [pa.RecordBatch.from_arrays([pa.array([f"a {word(i)} {word(i)}" for i in range(k, k + 50)])], ["t"]) for k in range(0, 500, 50)]
    old, terms.BLOCK_TERMS = terms.BLOCK_TERMS, 60
    try:
        out = list(terms._encode_blocks(iter(batches)))
    finally:
        terms.BLOCK_TERMS = old
    total = Counter()
    for b in out:
        for t, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total[t] += o
    assert len(out) > 3 and total["a"] == 500 and total[word(7)] == 2 and sum(b.column(2).to_pylist()[-1] for b in out) == 500


# --- 4 ---


def corpus(n=260, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioustrnlmp") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    out = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(2, 9)))
        if i % 3 == 0 and out:
            t = list(rng.choice(out)[1])
            for _ in range(rng.randint(0, max(1, len(t) // 4))):
                k, p = rng.randint(0, 2), rng.randrange(len(t) + 1)
                t[p : p + (k != 1)] = [] if k == 0 else [rng.choice("aeé\U0001f600")]
            t = "".join(t)
        out.append((i, t, rng.choice(["train", " Train ", "val", "test", "pool", None])))
    return out


def test_overlaps_like_brute_force(spark):
    lines = corpus() + [(900, None, "val"), (901, "", "train"), (902, "Ci fenist li liures de Rome", "train"), (903, "Ci fenist li liures de Rome", "VAL"), (904, "x" * 5000, "train"), (905, "x" * 4400 + "y" * 500, "val")]
    df = spark.createDataFrame([(i, 1, s, t, "src", "eval") for i, t, s in lines + lines[:30]], "line_id bigint, manifest_id bigint, split string, text string, source string, is_train string").repartition(5)
    manifest = spark.createDataFrame([(1, {"train": 9, "Val": 1, "test": 1}), (1, {"train": 8, "Val": 2, "test": 1}), (2, None)], "manifest_id bigint, splits map<string,int>")
    plain = [(i, t, s.strip().lower()) for i, t, s in lines if s and t and len(t) >= 20]
    want = sorted({(e[0], t[0], d) for e in plain if e[2] in ("val", "test") for t in plain if t[2] == "train" and abs(len(e[1]) - len(t[1])) <= max(len(e[1]), len(t[1])) // 5 for d in [overlap.edit_distance(e[1], t[1], 10_000)] if d <= max(len(e[1]), len(t[1])) // 5})
    assert len(want) > 10
    for buckets, block in ((3, 20), (24, 40_000)):
        got = overlap.find_overlaps(df, manifest, buckets, block)
        assert sorted((r.eval_id, r.train_id, r.distance) for r in got.collect()) == want
    report = overlap.overlap_report(got).agg({"n_pairs": "sum"}).first()[0]
    assert report == len(want)
    assert overlap.find_overlaps(df.limit(0), manifest).count() == 0 and overlap.find_overlaps(df, manifest.limit(0)).count() == 0


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(800):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 20))) for _ in range(2))
        limit, d = rng.randint(0, 20), lev(a, b)
        assert overlap.edit_distance(a, b, limit) == min(d, limit + 1)


def test_hot_text_is_joined_once(spark):
    n = 3000
    df = spark.range(n).selectExpr("id as line_id", "1L as manifest_id", "if(id = 0, 'val', 'train') as split", "'Ci commence li romans de Rome' as text", "'s' as source")
    manifest = spark.createDataFrame([(1, {"train": 9, "val": 1})], "manifest_id bigint, splits map<string,int>")
    assert overlap.find_overlaps(df, manifest).count() == n - 1


# --- 5 ---


def page(title, number, body):
    return [number, title, *body]


def run_fixture():
    forms = "li rois vint a la grant cort et si parla a son baron por la guerre qui estoit mout fiere commencement".split()
    rng = random.Random(8)
    lines = []
    for p in range(6):
        body = [" ".join(rng.choice(forms) for _ in range(7)) for _ in range(12)]
        body[3], body[4] = body[3] + " commen=", "cement " + body[4]
        body[6] += " —"
        body[8] = "l1 rois v0nt " + body[8]
        lines += page("· Li romans de Troie ·" if p != 2 else "· Li romanf de Troi ·", f"[{p + 7}]" if p % 2 else f"xx{'i' * (p // 2)}j.", body)
    return forms, lines


def test_noise(spark):
    forms, lines = run_fixture()
    lexicon = spark.createDataFrame([(f,) for f in forms] + [(None,), ("",), ("Rois",)], "form string")
    data = [(1, i, t, None) for i, t in enumerate(lines)]
    df = spark.createDataFrame(data + data[:9] + [(1, 500, None, "h"), (1, 501, "  ", "h"), (None, 1, "x", "h")], "run_id bigint, line_index int, text_raw string, noise string")
    got = {(r.line_index, r.noise): r.detail for r in noise.line_noise(df, lexicon).collect()}
    at = lambda kind: sorted(i for i, k in got if k == kind)
    assert at("header") == [14 * p + 1 for p in range(6)] and at("page_no") == [14 * p for p in range(6)]
    assert at("hyphen") == [14 * p + 5 for p in range(6)] and at("misread") == [14 * p + 10 for p in range(6)]
    assert got[5, "hyphen"] == "commencement" and got[10, "misread"] == "l1 v0nt"
    whole = noise.repaired_lines(df, lexicon).orderBy("line_index").collect()
    text = " ".join(r.text for r in whole)
    assert "commencement" in text and "romans" not in text and "=" not in text and "v0nt" not in text
    assert noise.line_noise(df.limit(0), lexicon).count() == 0


def test_noise_chunks_agree(spark, monkeypatch):
    forms, lines = run_fixture()
    lexicon = spark.createDataFrame([(f,) for f in forms], "form string")
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "run_id bigint, line_index int, text_raw string")
    whole = rows(noise.line_noise(df, lexicon))
    monkeypatch.setattr(noise, "CHUNK", 50)
    monkeypatch.setattr(noise, "MARGIN", 20)
    assert rows(noise.line_noise(df, lexicon)) == whole


def test_noise_against_ground_truth(spark):
    """Held-out lines: those with a ground truth, which the operator never reads."""
    read = lambda t: spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet")
    lines = read("run_lines")
    found = noise.line_noise(lines, read("lexicon"), read("runs"), read("name_forms")).collect()
    misread = {(r.run_id, r.line_index) for r in found if r.noise == "misread"}
    other = {(r.run_id, r.line_index) for r in found if r.noise in ("header", "page_no")}
    good = bad = missed = 0
    for r in lines.where("text_gt is not null").distinct().collect():
        k = (r.run_id, r.line_index)
        if k in other or not noise.clean(r.text_raw):
            continue
        same = re.sub("[-‐–—¬⸗=~]$", "-", noise.clean(r.text_raw)) == re.sub("[-‐–—¬⸗=~]$", "-", noise.clean(r.text_gt))
        good += k in misread and not same
        bad += k in misread and same
        missed += k not in misread and not same
    assert good >= 100 and bad <= 0.03 * good and missed <= 0.03 * good


@pytest.mark.parametrize("text,shape", [("[69]", 2), ("f. 43v", 2), ("lxij.", 2), ("·lxxij·", 2), ("fol. xvijr", 2), ("p. 8l", 2), ("- 47 -", 2), ("li", 1), ("mil", 0), ("", 0), ("rois", 0), ("[l3]", 2)])
def test_number_shape(text, shape):
    assert noise.number_shape(text) == shape


# --- 6 ---


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_encoding_like_library():
    bpe, ref, rng = encode.load(encode.DEFAULT_VOCABULARY), library(), random.Random(7)
    parts = ["a", "aa", "é", "é", " ", "  ", "\n", "\t", "1", "½", "Ⅷ", "'s", "'", "中", "🙂", "\x1c", "\x85", "​", "　", "the", "ing", "<|endoftext|>", "_", "İ", "ß", "ªb", "xº", "ñſ", "µ"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert bpe.encode(s) == ref.encode(s, add_special_tokens=False).ids, repr(s)
    long = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    assert bpe.encode(long) == ref.encode(long, add_special_tokens=False).ids and not bpe.queue.top


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "li rois"), (2, None), (3, ""), (None, "x"), (1, "li rois")], "doc_id bigint, text string").selectExpr("*", "1 as ids")
    got = sorted(encode.encode_ids(df).collect(), key=repr)
    ids = library().encode("li rois", add_special_tokens=False).ids
    assert len(got) == 5 and sum(r.ids == ids for r in got) == 2 and sum(r.ids == [] for r in got) == 2
    assert encode.encode_ids(df.limit(0)).count() == 0 and dict(encode.encode_ids(df).dtypes)["ids"] == "array<int>"


# --- 7 ---


def brute_words(text):
    text = re.sub(r"(?<=[^\W\d_])[-‐¬][ ]*\n\s*(?=[^\W\d_])", "", text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return re.findall(r"[^\W\d_]+", text.replace("v", "u").replace("j", "i"))


def test_leaks_like_brute_force(spark):
    rng = random.Random(9)
    words = ["vient", "Jour", "ſaint", "été", "rei", "guerre", "et", "la", "par", "mer"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 14)))) for i in range(30)] + [(99, None), (98, ""), (None, "a b c d e f g h i")]
    docs = []
    for d in range(120):
        t = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        if d % 2:
            t[5:5] = items[rng.randrange(30)][1].upper().replace("V", "U").split()[rng.randint(0, 2) :]
        body = " ".join(t)
        docs.append((d, body.replace(" ", " — ", 2) if d % 3 else body.replace("guerre", "guer-\nre").replace("GUERRE", "GUER¬ \nRE")))
    docs += [(500, None), (501, ""), (None, items[0][1])]
    df = spark.createDataFrame(docs + docs[:20], "doc_id bigint, text string").selectExpr("*", "1 as item_id").repartition(4)
    it = spark.createDataFrame(items + items[:3], "item_id bigint, text string")
    grams = lambda t: {tuple(w[i : i + 8]) for w in [brute_words(t)] for i in range(len(w) - 7)}
    want = sorted((d, i) for d, t in docs if t and d is not None for i, x in items if x and i is not None and grams(t) & grams(x))
    assert len(want) > 20
    assert rows(leaks.find_leaks(df, it)) == sorted(want, key=repr)
    assert rows(leaks.find_leaks(df, it, max_set_bytes=9_000)) == sorted(want, key=repr)  # several blocks
    assert leaks.find_leaks(df.limit(0), it).count() == 0 == leaks.find_leaks(df, it.limit(0)).count()
    kept = leaks.drop_leaking_documents(df, leaks.find_leaks(df, it))
    assert not {d for d, _ in want} & {r.doc_id for r in kept.collect()} and kept.where("doc_id is null").count() == 1


# --- 8 ---

NAMES = [(f, "given") for f in "Aldbal Aldmar Aldnor Aldric Brenlis Brenmar Brenbal Brenric Cydlis Cydmar Cydnor Cydric Torlis Torbal Tornor Torric Vaxnor Zelnor Zelbal".split()] + [(f, "family") for f in "Arbnay Arbthon Arbluc Arbsard Bruluc Bruthon Brugny Brusard Cornay Corthon Corluc Corsard Falgny Falluc Falnay Falsard Mirgny Mirluc Mirthon Mirnay Hulgny Hulthon Quenthon".split()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ecrire à t.bruluc+htr@lab.test.", [("email", "t.bruluc+htr@lab.test")]),
        ("mail a-b [at] lab [dot] x [dot] test, vite", [("email", "a-b [at] lab [dot] x [dot] test")]),
        ("mail a_b(arobase)lab.test ou c @ lab.example", [("email", "a_b(arobase)lab.test"), ("email", "c @ lab.example")]),
        ("See the flag @threshold. Mark f.9r@col.9", []),
        ("Tél. 06\xa039\xa098\xa012\xa040 ; +33 (0)1-99-00-12-13 ; 0033 5 36 49 12 13", [("phone", "06\xa039\xa098\xa012\xa040"), ("phone", "+33 (0)1-99-00-12-13"), ("phone", "0033 5 36 49 12 13")]),
        ("(01632) 960 479, 01632 960391, (212) 555-0149, 212.555.0116, +1 212 555 0146", [("phone", p) for p in ("(01632) 960 479", "01632 960391", "(212) 555-0149", "212.555.0116", "+1 212 555 0146")]),
        ("zéro six trois neuf neuf huit un deux quatre zéro", [("phone", "zéro six trois neuf neuf huit un deux quatre zéro")]),
        ("Lines 237 50 310 00 17, batch 459-433-355 of 06/09/2024, v261.232.409, ms. 625, ark:/99999/x246331b226", []),
        ("no 2 55 08 41 139 565 99, 000-59-6155, 18XX2190, CNI no 2076806 et PASS:3665962.", [("id_number", p) for p in ("2 55 08 41 139 565 99", "000-59-6155", "18XX2190", "CNI no 2076806", "PASS:3665962")]),
        ("à 72 bis, rue de l'Encrier, 99100 Ostrmont. Le 128 de la rue haute est une glose.", [("address", "72 bis, rue de l'Encrier, 99100 Ostrmont")]),
        ("at Flat 4, 134 bis Rubric Close, Ostermere.\nQuill Lane was a street.", [("address", "Flat 4, 134 bis Rubric Close, Ostermere")]),
        ("Dr Aldbal Arbnay et BRULUC, Cydnor ; T. de Cornay", [("name", "Aldbal Arbnay"), ("name", "BRULUC, Cydnor"), ("name", "T. de Cornay")]),
        ("Brennor Corgny and Cydbal-Aldmar Falthon-Arbluc", [("name", "Brennor Corgny"), ("name", "Cydbal-Aldmar Falthon-Arbluc")]),  # unlisted forms
        ("King Aldbal speaks to Cydlis. La lecture de Bruluc, Cydnor. M. Arbnay Torlis", [("name", "Bruluc, Cydnor"), ("name", "Arbnay Torlis")]),
        ("aldbal.arbnay@lab.test", [("email", "aldbal.arbnay@lab.test")]),
        ("А​ldbal Аrbnay ｔ＠lab.test", [("name", "А​ldbal Аrbnay"), ("email", "ｔ＠lab.test")]),  # Cyrillic A, zero width
        ("", []),
    ],
)
def test_personal(text, want):
    spans = privacy.find_spans(text, privacy.NameModel(NAMES))
    assert [(k, text[a:z]) for k, a, z in spans] == want
    clean = privacy.redact(text, spans)
    assert all(p not in clean for _, p in want) and clean.count("[") >= len(want)


def test_transducers_keep_positions():
    rng = random.Random(11)
    for _ in range(400):
        t = "".join(rng.choice(["a", "é", "​", "ｗ", " [at] ", "x [dot] y", "１", "\xa0", ". ", "mot", "zéro six trois neuf neuf huit un "]) for _ in range(rng.randint(0, 15)))
        p = privacy.plain_form(t)
        at = [p.source(i) for i in range(len(p.text))]
        assert at == sorted(at) and all(0 <= x < len(t) for x in at)
        for i, c in enumerate(p.text):
            if c in "aéw" and t[at[i]] in "aéｗ":
                assert {"ｗ": "w"}.get(t[at[i]], t[at[i]]) == c or c == "a"


def test_personal_tables(spark):
    names = spark.createDataFrame(NAMES + [(None, "given"), ("X", None)], "form string, role string")
    df = spark.createDataFrame([(1, "Aldbal Arbnay, 0639989537"), (1, "Aldbal Arbnay, 0639989537"), (2, None), (3, ""), (None, "a@b.test"), (4, "mot " * 100_000 + "a@b.test")], "doc_id bigint, text string").selectExpr("*", "'c' as pii_kind")
    got = rows(privacy.find_personal(df, names).select("doc_id", "pii_kind", "start_pos"))
    assert got == [(1, "name", 0), (1, "phone", 15), (4, "email", 400_000), (None, "email", 0)]
    red = [r.text for r in privacy.redact_personal(df, names).collect()]
    assert red.count("[NAME], [PHONE]") == 2 and None in red and "" in red
    assert privacy.find_personal(df.limit(0), names).count() == 0
    assert [r[1] for r in rows(privacy.find_personal(df, names.limit(0)))] == ["phone", "email", "email"]


# --- registry ---


def test_twins(spark):
    import duckdb

    from folioscope.llm import queries, sql

    assert set(sql.oracle_sql()) <= set(queries.queries())
    con = duckdb.connect()
    for t in "corpus_lines dataset_manifest run_lines documents eval_items".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in sql.oracle_sql():
        df, rel = queries.queries()[name](spark, SF), con.sql(sql.oracle_sql()[name])
        assert df.columns == rel.columns and rows(df) == sorted(map(tuple, rel.fetchall()), key=repr)


def test_nothing_else_imports_it():
    root = os.path.join(os.path.dirname(__file__), "..", "..", "folioscope")
    for base, _, names in os.walk(root):
        if os.sep + "llm" not in base:
            assert not [n for n in names if n.endswith(".py") and "folioscope.llm" in open(os.path.join(base, n)).read()]
