"""Problem 7: leaked stretches taken out of the texts, against a plain search word by word."""

import random

import pytest

from folioscope.llm import leaks

N = 4


def brute(text, grams):
    """The text without every letter between the first and last of N words in a row of an item."""
    words, starts, ends = [], [], []
    i = 0
    while i < len(text):
        if text[i].isalpha():
            j = i
            word = ""
            while True:
                while j < len(text) and text[j].isalpha():
                    word += text[j]
                    j += 1
                if text[j : j + 2] == "-\n" and text[j + 2 : j + 3].isalpha():
                    j += 2
                    continue
                break
            words.append(word.lower().replace("v", "u").replace("j", "i"))
            starts.append(i)
            ends.append(j)
            i = j
        else:
            i += 1
    gone = set()
    for k in range(len(words) - N + 1):
        if tuple(words[k : k + N]) in grams:
            gone.update(range(starts[k], ends[k + N - 1]))
    return "".join(c for i, c in enumerate(text) if i not in gone)


@pytest.mark.parametrize("most", [64 << 20, 3000])
def test_spans_removed_like_brute_force(spark, most):
    rng = random.Random(3)
    pool = "li rois vint a la cort grant joie iure vie tote gent".split()
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(12)] + [(99, None)]
    sep = lambda: rng.choice([" ", " ", ", ", "\n", "  ", "-\n", " 12 "])
    some = lambda: (rng.choice(items)[1] or "").split() if rng.random() < 0.3 else [rng.choice(pool)]
    docs = [(i, "".join(w.capitalize() + sep() for _ in range(rng.randint(0, 30)) for w in some())) for i in range(80)] + [(200, None), (201, ""), (None, items[3][1]), (None, items[3][1])]
    grams = set()
    for _, t in items:
        w = (t or "").replace("v", "u").replace("j", "i").split()
        grams |= {tuple(w[k : k + N]) for k in range(len(w) - N + 1)}
    corpus = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, d string")
    got = leaks.remove_leaks(corpus, spark.createDataFrame(items, "item_id bigint, text string"), n=N, max_set_bytes=most).collect()
    want = [(i, None if t is None else brute(t, grams)) for i, t in docs]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(a[1] != b[1] for a, b in zip(want, docs)) > 10 and all((r.n_spans > 0) == (dict(docs).get(r.doc_id, items[3][1]) != r.text) for r in got if r.doc_id is not None)
    assert leaks.remove_leaks(corpus.limit(0), spark.createDataFrame(items, "item_id bigint, text string"), n=N).count() == 0


def test_places_of_words():
    text = "Le ro-\ni vi-\r\nnt la-\nX 9-\nb fin"
    words, starts, ends = leaks.located_words(text)
    assert words == leaks.raw_words(text) and [text[a:z] for a, z in zip(starts, ends)] == ["Le", "ro-\ni", "vi-\r\nnt", "la-\nX", "b", "fin"]
