"""Page XML (ALTO): to contract, texts and baselines.

Every TextLine of a page counts, in document order and however deep it lies. Pages of the usual nesting are read by
`from_xml` with a declared schema, all in the JVM. Where that finds other numbers of lines or strings than the page
has, or lines beside blocks (deeper nesting, strings within strings), a reader of any nesting takes over, in Arrow batches that hold
such pages alone. Namespaces are ignored; `text_any_nesting` with `strict` drops pages that are not in the version 4 namespace.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.geometry import points
from folioscope.functions.text import strip
from folioscope.operators.runs import REVIEW_THRESHOLD, mean_confidence, needs_review

NAMESPACE = "http://www.loc.gov/standards/alto/ns-v4#"

_STRING = "struct<_CONTENT:string,Glyph:array<struct<_CONTENT:string,_GC:double>>>"
_LINE = f"struct<_ID:string,_BASELINE:string,Shape:struct<Polygon:struct<_POINTS:string>>,String:array<{_STRING}>>"
_BLOCKS = f"array<struct<TextLine:array<{_LINE}>>>"
_SPACE = f"struct<TextBlock:{_BLOCKS},TextLine:array<{_LINE}>,ComposedBlock:array<struct<TextBlock:{_BLOCKS}>>>"
SCHEMA = f"Description struct<sourceImageInformation:struct<fileName:string>>, Layout struct<Page:array<struct<_WIDTH:int,_HEIGHT:int,PrintSpace:{_SPACE}>>>"

#: What either reader gives: `words` are the strings right below the line, `deep` those at any depth.
PAGE = "struct<image:string,width:int,height:int,lines:array<struct<id:string,words:array<string>,deep:array<string>,polygon:string,baseline:string,confidences:array<double>>>>"
#: Fields that a contract and its lines must have (fixed values).
CONTRACT_FIELDS = ("source_image", "lines")
LINE_FIELDS = ("id", "text", "char_confidences", "mean_confidence", "needs_review")


def parse(xml: Column) -> Column:
    """Struct of a page in the declared nesting; null for text that is no XML."""
    return F.from_xml(xml, SCHEMA, {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"})


def _once(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _usual(page: Column) -> Column:
    """PAGE of a page in the declared nesting; null where lines stand beside blocks, so that their order is not known."""
    empty, no_blocks, no_strings = (F.array().cast(t) for t in (f"array<{_LINE}>", _BLOCKS, f"array<{_STRING}>"))
    of_blocks = lambda blocks: F.flatten(F.transform(F.coalesce(blocks, no_blocks), lambda b: F.coalesce(b["TextLine"], empty)))

    def kinds(p: Column) -> Column:
        space = p["PrintSpace"]
        nested = F.flatten(F.transform(F.coalesce(space["ComposedBlock"], F.array().cast(f"array<struct<TextBlock:{_BLOCKS}>>")), lambda c: of_blocks(c["TextBlock"])))
        return F.array(of_blocks(space["TextBlock"]), nested, F.coalesce(space["TextLine"], empty))

    def line(x: Column) -> Column:
        strings = F.coalesce(x["String"], no_strings)
        words = F.transform(strings, lambda w: F.coalesce(w["_CONTENT"], F.lit("")))
        glyphs = F.flatten(F.transform(strings, lambda w: F.coalesce(w["Glyph"], F.array().cast("array<struct<_CONTENT:string,_GC:double>>"))))
        confidences = F.transform(F.filter(glyphs, lambda g: g["_GC"].isNotNull()), lambda g: g["_GC"])
        return F.struct(x["_ID"].alias("id"), words.alias("words"), words.alias("deep"), x["Shape"]["Polygon"]["_POINTS"].alias("polygon"), x["_BASELINE"].alias("baseline"), confidences.alias("confidences"))

    # Inner functions name their own argument alone: copies of an expression are known as such only then.
    def gathered(p: Column) -> Column:
        pages = F.coalesce(p["Layout"]["Page"], F.array().cast(f"array<struct<_WIDTH:int,_HEIGHT:int,PrintSpace:{_SPACE}>>"))
        head = p["Description"]["sourceImageInformation"]["fileName"]
        return F.struct(p["Layout"].isNotNull().alias("there"), head.alias("image"), F.get(pages, F.lit(0)).alias("first"), F.transform(pages, kinds).alias("found"))

    def made(x: Column) -> Column:
        mixed = F.exists(x["found"], lambda k: F.size(F.filter(k, lambda lines: F.size(lines) > 0)) > 1)
        page = F.struct(x["image"], x["first"]["_WIDTH"].alias("width"), x["first"]["_HEIGHT"].alias("height"), F.transform(F.flatten(F.flatten(x["found"])), line).alias("lines"))
        return F.when(x["there"] & ~mixed, page)

    return _once(_once(page, gathered), made)


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _whole(text: str | None) -> int | None:
    return int(text) if text and text.strip().lstrip("-").isdigit() else None


def _decimal(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def read_any(xml: str | None) -> dict | None:
    """PAGE of a page of any nesting; None for what is no XML."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    every = lambda tag, at=root: (e for e in at.iter() if _local(e.tag) == tag)
    page, image = next(every("Page"), None), next(every("fileName"), None)
    lines = []
    for line in every("TextLine"):
        own = [e for e in line if _local(e.tag) == "String"]
        shape = next((p for s in line if _local(s.tag) == "Shape" for p in s if _local(p.tag) == "Polygon"), None)
        known = [g.get("GC") for s in own for g in every("Glyph", s) if g.get("GC") is not None]
        lines.append({"id": line.get("ID"), "words": [s.get("CONTENT", "") for s in own], "deep": [s.get("CONTENT", "") for s in every("String", line)], "polygon": None if shape is None else shape.get("POINTS"), "baseline": line.get("BASELINE"), "confidences": [c for g in known if (c := _decimal(g)) is not None]})
    return {"image": None if image is None else image.text, "width": page is not None and _whole(page.get("WIDTH")) or None, "height": page is not None and _whole(page.get("HEIGHT")) or None, "lines": lines}


def _any(xml: Column) -> Column:
    """PAGE by `read_any`, in an array of one; null for null and for what is no XML."""

    @F.pandas_udf(f"array<{PAGE}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            read = [None if t is None else read_any(t) for t in s]
            yield pd.Series([None if r is None else [r] for r in read], dtype=object)

    return run(xml)


def _either(xml: Column, use) -> Column:
    """`use` of a page's PAGE by whichever reader fits; null for what is no XML and for null."""
    count = lambda tag: F.regexp_count(xml, F.lit(rf"<(?:[\w.-]+:)?{tag}[\s/>]"))

    def checked(p: Column) -> Column:
        return F.when((F.size(p["lines"]) == count("TextLine")) & (F.aggregate(p["lines"], F.lit(0), lambda n, x: n + F.size(x["words"])) == count("String")), p)

    usual = _once(_usual(parse(xml)), checked)
    other = F.get(_any(F.when(usual.isNull(), xml)), F.lit(0))
    return F.coalesce(_once(usual, lambda p: F.when(p.isNotNull(), use(p))), F.when(other.isNotNull(), use(other)))


def read_page(xml: Column) -> Column:
    """PAGE of a page; null for what is no XML and for null."""
    return _either(xml, lambda p: p)


def _text(words: Column) -> Column:
    """Contents joined by spaces, empty ones left out."""
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def to_contract(pages: DataFrame, xml: str = "xml", review_threshold: float = REVIEW_THRESHOLD, source_image: Column | None = None, model: str | None = None) -> DataFrame:
    """`pages` with `contract`: source_image, model, page (width, height), review_threshold, lines.

    The image is the column `source_image` where that is set and not empty, else the page's file name without outer blanks, else `unknown`.
    A line has id (`line_<i>` if it has none, i counting all lines), text, polygon, baseline, the glyphs'
    confidences and their mean, both rounded to four places, whether it needs review, and no candidates yet. Lines without
    text are left out. What is no XML, and null, has a null contract.
    """
    p, empty = F.col("__p"), F.array().cast("array<array<int>>")
    numbered = F.transform(p["lines"], lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def line(z: Column) -> Column:
        x = z["x"]
        confs = F.transform(x["confidences"], lambda g: F.round(g, 4))
        mean = mean_confidence(confs)
        return F.struct(
            F.coalesce(x["id"], F.concat(F.lit("line_"), z["i"].cast("string"))).alias("id"),
            _text(x["words"]).alias("text"),
            F.coalesce(points(x["polygon"]), empty).alias("polygon"),
            F.coalesce(points(x["baseline"]), empty).alias("baseline"),
            confs.alias("char_confidences"),
            mean.alias("mean_confidence"),
            needs_review(mean, review_threshold).alias("needs_review"),
            F.array().cast("array<string>").alias("candidates"),
        )

    filled = lambda c: F.when(c != "", c)
    contract = F.struct(
        F.coalesce(filled(source_image) if source_image is not None else F.lit(None), filled(strip(p["image"])), F.lit("unknown")).alias("source_image"),
        F.lit(model).cast("string").alias("model"),
        F.struct(p["width"].alias("width"), p["height"].alias("height")).alias("page"),
        F.lit(review_threshold).alias("review_threshold"),
        F.transform(F.filter(numbered, lambda z: _text(z["x"]["words"]) != ""), line).alias("lines"),
    )
    return pages.withColumn("__p", read_page(F.col(xml))).withColumn("contract", F.when(p.isNotNull(), contract)).drop("__p")


def true_lines(xml: Column) -> Column:
    """Texts of the lines of a page that have any; null for what is no XML."""
    return _either(xml, lambda p: F.filter(F.transform(p["lines"], lambda x: _text(x["deep"])), lambda t: t != ""))


def plain_text(xml: Column) -> Column:
    """The page's text, a line feed between lines that have any; empty for what is no XML."""
    return F.coalesce(F.array_join(true_lines(xml), "\n"), F.lit(""))


def page_pairs(found: DataFrame, truth: DataFrame, keys: list[str], xml: str = "xml", **options) -> DataFrame:
    """keys, contract, truth: found pages with the true lines of the page of the same keys; pages without a true one are left out."""
    own = to_contract(found.select(*keys, xml), xml, **options).select(*keys, "contract")
    return own.join(truth.select(*keys, true_lines(F.col(xml)).alias("truth")), keys)


def baselines(xml: Column, name: Column | None = None) -> Column:
    """Struct image, baselines (points of lines that have one), texts (their first strings).

    The image is the page's file name without outer blanks, else `name` and `.jpg`, else null.
    """

    def read(p: Column) -> Column:
        kept = F.filter(p["lines"], lambda x: F.coalesce(x["baseline"], F.lit("")) != "")
        image = F.when(strip(p["image"]) != "", strip(p["image"])).otherwise(F.concat(name, F.lit(".jpg")) if name is not None else F.lit(None))
        return F.struct(
            image.alias("image"),
            F.transform(kept, lambda x: points(x["baseline"])).alias("baselines"),
            F.transform(kept, lambda x: F.coalesce(F.get(x["words"], F.lit(0)), F.lit(""))).alias("texts"),
        )

    return _either(xml, read)


def segmenter_baselines(c: Column) -> Column:
    """Baselines of a segmenter's JSON, coordinates cut to integers; an empty array where there are none."""
    parsed = F.from_json(c, "lines array<struct<baseline:array<array<double>>>>")
    out = F.transform(F.filter(parsed["lines"], lambda x: x["baseline"].isNotNull()), lambda x: F.transform(x["baseline"], lambda p: F.transform(p, lambda v: v.cast("int"))))
    return F.coalesce(out, F.array().cast("array<array<array<int>>>"))


def text_any_nesting(pages: DataFrame, key: str, xml: str = "xml", strict: bool = False) -> DataFrame:
    """(key, texts): texts of the lines in document order, however deep they lie; none for text that is no XML."""

    def read(t: str | None) -> list[str]:
        found = read_any(t)
        if found is None or strict and not ET.fromstring(t).tag.startswith("{" + NAMESPACE):
            return []
        return [" ".join(w for w in line["deep"] if w) for line in found["lines"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "texts": pdf[xml].map(read)})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, xml).mapInPandas(run, f"{key} {kind}, texts array<string>")


def contract_violations(contracts: DataFrame, key: str, text: str = "contract") -> DataFrame:
    """(key, problem): what is wrong with contracts given as JSON; valid ones have no row.

    Problems: `invalid json`, `missing <field>`, `line missing <field>`, `type <field>`. Of the contract only its image and lines, of a line
    only id, text, confidences, their mean and the flag must be there; the image must be a string, the threshold a number.
    """
    keys = F.json_object_keys(F.col(text))
    lines = F.from_json(F.get_json_object(F.col(text), "$.lines"), "array<string>")
    absent = lambda fields, have: F.array_except(F.array(*map(F.lit, fields)), F.coalesce(have, F.array().cast("array<string>")))
    wrong = lambda c, name: F.when(c, F.array(F.lit(f"type {name}"))).otherwise(F.array().cast("array<string>"))
    # Variants keep the kinds of JSON values apart.
    kind = lambda name: F.schema_of_variant(F.variant_get(F.try_parse_json(F.col(text)), f"$.{name}", "variant"))
    problems = F.when(keys.isNull(), F.array(F.lit("invalid json"))).otherwise(
        F.concat(
            F.transform(absent(CONTRACT_FIELDS, keys), lambda f: F.concat(F.lit("missing "), f)),
            F.array_distinct(F.flatten(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.transform(absent(LINE_FIELDS, F.json_object_keys(x)), lambda f: F.concat(F.lit("line missing "), f))))),
            wrong(F.array_contains(keys, "lines") & lines.isNull(), "lines"),
            wrong(F.array_contains(keys, "source_image") & (F.coalesce(kind("source_image"), F.lit("VOID")) != "STRING"), "source_image"),
            wrong(F.array_contains(keys, "review_threshold") & ~F.coalesce(kind("review_threshold"), F.lit("VOID")).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), "review_threshold"),
        )
    )
    return contracts.select(key, F.explode(problems).alias("problem"))


def to_json_contract(contract: Column) -> Column:
    return F.to_json(contract)


def save_contracts(pages: DataFrame, key: str, path: str) -> None:
    """Write contracts as JSON rows; refuses if one of them is not valid."""
    rows = pages.select(key, F.to_json("contract", {"ignoreNullFields": "false"}).alias("contract"))
    bad = contract_violations(rows, key).limit(1).collect()
    if bad:
        raise ValueError(f"contract {bad[0][0]}: {bad[0][1]}")
    rows.write.mode("overwrite").json(path)


def empty_contract() -> str:
    """A valid contract without lines, for tests and documentation."""
    return json.dumps({"source_image": "unknown", "page": {}, "review_threshold": REVIEW_THRESHOLD, "lines": []})
