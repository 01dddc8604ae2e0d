"""Edit distances and error rates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import tokens

#: First code point of the private signs that stand for tokens, and how many there are.
_FIRST, _ROOM = 0xE000, 6400
#: Distinct tokens of a pair for which there are signs.
TOKENS = _ROOM + 2 * 65_536


def token_distance(a: Column, b: Column) -> Column:
    """Unit-cost edit distance of two token arrays: each distinct token becomes one sign, the signs are compared.

    Pairs with more than 6,400 distinct tokens take signs from the two private planes above; over `TOKENS` of them raise an error.
    """
    known = F.array_distinct(F.concat(a, b))

    def sign(t: Column) -> Column:
        k = F.array_position(known, t) - 1
        # The private use area, then the supplementary private planes, as UTF-16 pairs.
        low = F.decode(F.unhex(F.lpad(F.hex(k + _FIRST), 4, "0")), "UTF-16BE")
        high = F.decode(F.unhex(F.concat(F.hex(F.lit(0xDB80) + F.floor((k - _ROOM) / 1024)), F.hex(F.lit(0xDC00) + (k - _ROOM) % 1024))), "UTF-16BE")
        return F.when(k < _ROOM, low).when(k < TOKENS, high).otherwise(F.raise_error(F.lit(f"over {TOKENS} distinct tokens in a pair")))

    return F.levenshtein(F.array_join(F.transform(a, sign), ""), F.array_join(F.transform(b, sign), ""))


def _rate(distance: Column, size: Column, other: Column) -> Column:
    return F.when(size > 0, distance / size).when(other == 0, F.lit(0.0)).otherwise(F.lit(1.0))


def char_error_rate(ref: Column, hyp: Column) -> Column:
    """Distance by length of the reference; for an empty reference 0 if the hypothesis is empty too, else 1. Null is empty."""
    ref, hyp = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    return _rate(F.levenshtein(ref, hyp), F.length(ref), F.length(hyp))


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """The same on words between white space."""
    a, b = tokens(F.coalesce(ref, F.lit(""))), tokens(F.coalesce(hyp, F.lit("")))
    return _rate(token_distance(a, b), F.size(a), F.size(b))
