"""Problems 1 and 8: words of any script with letters of another, words run together, names in disguise."""

import unicodedata

import pytest

from folioscope.llm import lookalikes
from folioscope.llm.privacy import NameModel, find_spans, plain_form, redact


@pytest.mark.parametrize(
    "text,form,kinds",
    [
        ("Рoссия", "Россия", ["mixed_script"]),  # Latin o
        ("мoсква", "москва", ["mixed_script"]),
        ("λόγoς", "λόγος", ["mixed_script"]),
        ("κόσμoς", "κόσμος", ["mixed_script"]),
        ("ϑεός", "ϑεός", []),
        ("ℵ", "ℵ", []),
        ("µέτρον", "μέτρον", ["whole_script"]),
        ("Россия роса", "Россия роса", []),
        ("сaо de la", "cao de la", ["mixed_script"]),
        ("сaо", "cao", ["mixed_script"]),  # no other word tells the script
        ("Россия сaо", "Россия сао", ["mixed_script"]),
        ("braiteχάρις roi", "braiteχάρις roi", []),  # two words run together
        ("braiteχάρις rоi", "braiteχάρις roi", ["mixed_script"]),
        ("τοut", "tout", ["mixed_script"]),
        ("étе́", "été", ["mixed_script"]),
        ("ⅼab ﬁn", "lab fin", ["ligature", "mixed_script"]),
        ("𝐚bc", "abc", ["mixed_script"]),
    ],
)
def test_resolved_scripts(text, form, kinds):
    text = unicodedata.normalize("NFC", text)
    assert lookalikes.inspect(text) == (form, kinds)
    assert lookalikes.inspect(form)[0] == form


MODEL = NameModel([("René", "given"), ("Aldbal", "given"), ("Arbnay", "family")])


@pytest.mark.parametrize("name", ["René Arbnay", "René Arbnay", "Aldbαl Arbnay", "Ａldbal Arbnаy", "Ald​bal Arbnay"])
def test_names_in_disguise(name):
    text = f"écrit par {name} hier"
    assert find_spans(text, MODEL) == [("name", 10, 10 + len(name))]
    assert redact(text, find_spans(text, MODEL)) == "écrit par [NAME] hier"


def test_addresses_in_disguise():
    for mail in ("user@ⅼab.test", "usеr@lab.test", "user＠lab.test"):
        assert find_spans(f"voir {mail} ou", MODEL) == [("email", 5, 5 + len(mail))]
    greek = "λόγος καὶ θεός"
    assert plain_form(greek).text == greek
