"""Lexicon loading, lookup, bounded-distance candidates and correction of lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import split_affixes, strip, tokens

#: From candidates (word, form, distance, rank) to (word, best).
Scorer = Callable[[DataFrame], DataFrame]
#: From batches of token lists, places in them and candidate lists, nearest first, to the best candidates or nulls.
Context = Callable[[pd.Series, pd.Series, pd.Series], pd.Series]


def load_lexicon(forms: DataFrame, min_len: int = 2) -> DataFrame:
    """(form): distinct lower-case forms of letters only, of `min_len` letters at least."""
    form = F.lower(strip(F.col("form")))
    return forms.select(form.alias("form")).where(F.col("form").rlike(r"^\p{L}+$") & (F.length("form") >= min_len)).distinct()


def words_of(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Words of lines with their affixes: keys, pos, token, before, core, after, word (lower case)."""
    w = lines.select(*keys, F.posexplode(tokens(F.col(text))).alias("pos", "token"))
    return w.withColumn("a", split_affixes(F.col("token"))).select(*keys, "pos", "token", "a.before", "a.core", "a.after", F.lower("a.core").alias("word"))


def unknown_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, n): distinct words that are no forms of the lexicon, with their numbers; counted before the join."""
    counted = words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(lexicon, F.col("word") == F.col("form"), "left_anti")


def _deletions(c: Column, k: int) -> Column:
    """All strings that arise by deleting up to k characters."""

    def fewer(xs: Column) -> Column:
        cut = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        return F.array_distinct(F.concat(xs, F.flatten(F.transform(xs, cut))))

    out = F.array(c)
    for _ in range(k):
        out = fewer(out)
    return out


def candidates(words: DataFrame, lexicon: DataFrame, max_distance: int = 2, max_len_diff: int = 2, k: int | None = 10, compare: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(word, form, distance, rank): forms within `max_distance` of each distinct word, the `k` nearest.

    Two strings within d edits have a string in common that each gives by deleting d characters at most.
    So the search is an equi-join on deletions, exact and without comparing every word with every form; the
    edit distance then settles it. `compare` maps both sides before they are compared.
    """
    w = words.select("word").distinct().withColumn("cw", compare(F.col("word")))
    f = lexicon.select("form").distinct().withColumn("cf", compare(F.col("form")))
    # Words longer than any form and the difference have no candidate; their deletions are never made.
    longest = f.agg(F.coalesce(F.max(F.length("cf")), F.lit(0)).alias("longest"))  # one row
    w = w.join(F.broadcast(longest)).where(F.length("cw") <= F.col("longest") + max_len_diff).drop("longest")
    left = w.withColumn("key", F.explode(_deletions(F.col("cw"), max_distance)))
    right = f.withColumn("key", F.explode(_deletions(F.col("cf"), max_distance)))
    near = left.join(right, "key").where(F.abs(F.length("cw") - F.length("cf")) <= max_len_diff)
    pairs = near.select("word", "form", "cw", "cf").distinct().withColumn("distance", F.levenshtein("cw", "cf", max_distance)).where("distance >= 0").select("word", "form", "distance")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("distance", "form")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def nearest_first(found: DataFrame) -> DataFrame:
    """Scorer: the first candidate."""
    return found.where("rank = 1").select("word", F.col("form").alias("best"))


def by_frequency(counts: DataFrame) -> Scorer:
    """Scorer: of the candidates the one most frequent in `counts` (form, n), ties as ranked."""

    def choose(found: DataFrame) -> DataFrame:
        n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
        return found.join(counts, "form", "left").groupBy("word").agg(F.max_by("form", F.struct(n, -F.col("rank"))).alias("best"))

    return choose


def correct_lines(lines: DataFrame, keys: list[str], text: str, lexicon: DataFrame, scorer: Scorer = nearest_first, max_distance: int = 2, compare: Callable[[Column], Column] = lambda c: c, context: Context | None = None) -> DataFrame:
    """keys, corrected, n_changes, changes (pos, original, corrected, core, best, candidates): unknown words replaced by their best candidate.

    `scorer` chooses for each distinct word; `context`, if given, chooses for each occurrence and sees the line's tokens, the place and
    the candidates, nearest first; where it gives null the nearest candidate is taken. A choice that is the word itself is no change.
    `original` and `corrected` are the tokens with the signs around the word, which stay, `core` and `best` those without; words of no
    candidate stay; words are joined by single spaces. Rows without words give none; a row of each other, repeated ones too; null keys are keys.

    Only words that the lexicon lacks are joined with candidates, each distinct one searched once; a line takes its own changes back.
    """
    words = lines.select(*keys, tokens(F.col(text)).alias("__tokens")).where("size(__tokens) > 0")
    each = words.select("*", F.posexplode("__tokens").alias("pos", "__token")).withColumn("__a", split_affixes(F.col("__token")))
    each = each.select(*keys, "__tokens", "pos", "__a.before", "__a.core", "__a.after", F.lower("__a.core").alias("word"))
    unknown = each.where("word <> ''").join(lexicon.select(F.col("form").alias("word")), "word", "left_anti")
    found = candidates(unknown, lexicon, max_distance, compare=compare)
    listed = found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "form"))).alias("c"))  # ten a word at most
    if context is None and scorer is not nearest_first:
        listed = listed.join(scorer(found), "word")
    fixed = unknown.join(listed, "word").withColumn("c", F.transform("c", lambda x: x["form"]))
    if context is not None:
        fixed = fixed.withColumn("best", F.coalesce(_asked(context)("__tokens", "pos", "c"), F.get("c", F.lit(0))))
    elif scorer is nearest_first:
        fixed = fixed.withColumn("best", F.get("c", F.lit(0)))
    change = F.struct("pos", F.concat("before", "core", "after").alias("original"), F.concat("before", "best", "after").alias("corrected"), "core", "best", F.col("c").alias("candidates"))
    changed = fixed.where(F.lower("best") != F.lower("core")).groupBy(*keys, "__tokens").agg(F.array_sort(F.collect_set(change)).alias("__changes"))
    own = (*keys, "__tokens")
    other = changed.select(*[F.col(k).alias(f"__{n}") for n, k in enumerate(own)], "__changes")
    same = [F.col(k).eqNullSafe(F.col(f"__{n}")) for n, k in enumerate(own)]
    joined = words.join(other, same, "left").select(*own, "__changes")
    places = F.map_from_arrays(F.transform("__changes", lambda x: x["pos"]), F.transform("__changes", lambda x: x["corrected"]))
    corrected = F.when(F.col("__changes").isNull(), F.col("__tokens")).otherwise(F.transform("__tokens", lambda t, i: F.coalesce(F.try_element_at(places, i), t)))
    shown = F.coalesce("__changes", F.array().cast("array<struct<pos:int,original:string,corrected:string,core:string,best:string,candidates:array<string>>>"))
    return joined.select(*keys, F.array_join(corrected, " ").alias("corrected"), F.size(shown).cast("bigint").alias("n_changes"), shown.alias("changes"))


def _asked(context: Context):
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for words, index, found in batches:
            yield pd.Series(context(words, index, found), dtype=object)

    return run


def most_probable(probabilities: Callable[[list[tuple[list[str], int, list[str]]]], list[list[float | None]]]) -> Context:
    """Context of a model: from (tokens, place, candidates) of a batch to a probability of each candidate, None where it cannot say.

    The first candidate of the highest probability is taken; null, hence the nearest, where there is none.
    """

    def choose(words: pd.Series, index: pd.Series, found: pd.Series) -> pd.Series:
        asked = [(list(w), int(i), list(c)) for w, i, c in zip(words, index, found)]
        out = []
        for (_, _, names), ps in zip(asked, probabilities(asked) if asked else []):
            known = [(p, -k) for k, p in enumerate(ps) if p is not None]
            out.append(names[-max(known)[1]] if known else None)
        return pd.Series(out, dtype=object)

    return choose


def masked_model(model: str) -> Context:
    """Context of a masked language model, a name or folder that the transformers library loads, once a worker; that library is optional.

    The word's place is masked; only candidates of one token of the model's have a probability.
    """
    loaded: dict = {}

    def probabilities(asked: list[tuple[list[str], int, list[str]]]) -> list[list[float | None]]:
        if not loaded:
            import torch
            from transformers import AutoModelForMaskedLM, AutoTokenizer

            loaded.update(torch=torch, names=AutoTokenizer.from_pretrained(model), model=AutoModelForMaskedLM.from_pretrained(model).eval())
        names, out = loaded["names"], []
        for words, i, found in asked:
            encoded = names(" ".join([*words[:i], names.mask_token, *words[i + 1 :]]), return_tensors="pt", truncation=True)
            place = (encoded.input_ids[0] == names.mask_token_id).nonzero()
            ids = [names.encode(" " + c, add_special_tokens=False) for c in found]
            if not len(place):
                out.append([None] * len(ids))
                continue
            with loaded["torch"].no_grad():
                p = loaded["model"](**encoded).logits[0, place[0, 0]].softmax(-1)
            out.append([p[x[0]].item() if len(x) == 1 else None for x in ids])
        return out

    return most_probable(probabilities)
