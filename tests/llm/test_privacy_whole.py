"""Problem 8: forms that the transducers know, in texts with no other hint at them."""

import pytest

from folioscope.llm.privacy import plain_form


@pytest.mark.parametrize("text", ["x [ at ] lab.org", "x (chez) lab.fr", "x [@] lab.org", "x@lab[.]fr", "x{ arobase }lab.org", "x@lab (.) fr"])
def test_written_out_alone(text):
    plain = plain_form(f"Write to {text} soon").text
    assert "x@lab.org" in plain or "x@lab.fr" in plain


@pytest.mark.parametrize("word,digit", [("three", "3"), ("trois", "3"), ("five", "5"), ("cinq", "5"), ("seven", "7"), ("huit", "8"), ("neuf", "9"), ("nine", "9"), ("quatre", "4"), ("un", "1")])
def test_any_spelled_digit(word, digit):
    assert digit * 10 in plain_form("call " + " ".join([word] * 9 + ["zero"]).replace("zero", word)).text
