"""Table-driven cases of the text and quantity functions."""

import html.entities
import unicodedata

import pytest
from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.functions import units as U


def value(spark, column, **inputs):
    kinds = {str: "string", int: "bigint"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in inputs.items())
    return spark.createDataFrame([tuple(inputs.values())], schema).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("raw", "want"), [("Über-Maß_2", "uber mass 2"), ("  A  b ", "a b"), ("…", ""), ("", ""), (None, None), ("CO₂", "co2"), ("É́tat", "etat"), ("x™", "xtm")])
def test_normalise(spark, raw, want):
    assert value(spark, T.normalise(F.col("x")), x=raw) == want


def test_normalise_every_character(spark):
    """By the definition, for every character that folds to letters or digits and for marks of all kinds."""
    def by_definition(text):
        plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
        return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in plain).split())

    texts = [f"a{chr(cp)}b" for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and (cp < 0x3000 or T._folded(chr(cp)).strip() or unicodedata.combining(chr(cp)))]
    texts += ["½ inch", "Ⅳ ﬃ ㎏", "\U0001d400\U0001d7ce", "x" * 50 + "ĳ"]
    found = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.normalise(F.col("x")).alias("y")).collect()
    assert [(r["x"], r["y"]) for r in found if r["y"] != by_definition(r["x"])] == []


@pytest.mark.parametrize(("raw", "want"), [("Gas bottles", "gas bottle"), ("glass", "glass"), ("status", "status"), ("basis", "basis"), ("gas", "gas"), ("cups", "cup")])
def test_merge_key(spark, raw, want):
    assert value(spark, T.merge_key(F.col("x")), x=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("4,500", 4500.0), ("2,4", 2.4), ("1,249.00", 1249.0), ("1.234,56", 1234.56), ("6", 6.0), ("0.8", 0.8), ("-123,456", -123.456), ("6.5.", None), ("6.", 6.0), ("1,2345", 1.2345), ("12,345,678", 12345678.0), ("1234,567", 1234.567), ("+5", 5.0)])
def test_number(spark, raw, want):
    assert value(spark, U.parse_number(F.col("x")), x=raw) == want


@pytest.mark.parametrize(("raw", "dimension", "canonical"), [("1 year", "duration_calendar", 12.0), ("30 L/h", "flow", 0.5), ("about 5 bar", "pressure", 5.0), ("20 °C", "temperature_c", 20.0), ("£3", "money_gbp", 3.0), ("€ 1.234,50", "money_eur", 1234.5), ("7 parsecs", None, None), ("2,4 L/min", "flow", 2.4), ("45", None, None)])
def test_quantity(spark, raw, dimension, canonical):
    found = value(spark, U.parse_quantity(F.col("x")), x=raw)
    assert (found["dimension"], found["canonical"]) == (dimension, canonical)
    assert found["approximate"] == raw.startswith("about")


@pytest.mark.parametrize("raw", ["n/a", "varies", "", None, "no number"])
def test_absent(spark, raw):
    assert value(spark, U.parse_quantity(F.col("x")), x=raw) is None


@pytest.mark.parametrize(("raw", "want"), [("what is the gas bottle", "gas bottle"), ("point of entry", "point of entry"), ("point of use", "point"), ("is the", ""), ("quelle est la pression", "pression"), ("The CO₂ Cylinder?", "co2 cylinder")])
def test_content_phrase(spark, raw, want):
    assert value(spark, T.content_phrase(F.col("x")), x=raw) == want


def test_html(spark):
    assert value(spark, T.flatten_html(F.col("x")), x="<!-- a\nb --><tr><td>1</td><td>2 <b>x</b>y &amp; z</td></tr>") == "1 2 xy & z"


def test_entities(spark):
    texts = ["caf&eacute;&rsquo;s &mdash; &hellip;", "&#233;&#x27;&#X1F600;&#x1f600 &#39;", "&copyright; &notit; &notin; &amp;lt; & &; &x; &#; &amp", "&#0;&#x80;&#129;&#xD800;&#x110000;&#99999999999999999999;&#1;&#xfeff;&#xfdd0;&#000065;x", "&NotEqualTilde;&ngE;&AMP&lt&gt;&quot;&middot;", "none", ""]
    every = "".join(f"[&{name}]" for name in html.entities.html5 if name != "nbsp;") + "".join(f"[&#{n};]" for n in (*range(1, 300), 0xFFFE, 0x10FFFF))
    for text in [*texts, every]:
        assert value(spark, T.unescape(F.col("x")), x=text) == html.unescape(text)
    assert value(spark, T.flatten_html(F.col("x")), x="<p>a&nbsp;&nbsp;b&ndash;&#163;7</p>") == "a b–£7"


def test_small_functions(spark):
    cases = [
        (T.token_estimate(F.col("x")), "\t \n", 1), (T.token_estimate(F.col("x")), "one two\u3000three", 4), (T.word_count(F.col("x")), None, 0),
        (T.add_gutter(F.col("x"), F.lit(7)), "a\n\nb", "L7|a\nL8|\nL9|b"), (T.strip_gutter(F.col("x")), "L7|a\nL1234567|b\nc L2|d", "a\nL1234567|b\nc L2|d"),
        (T.whole_word_in(F.lit("gas"), F.col("x")), "no gas here", True), (T.whole_word_in(F.lit("gas"), F.col("x")), "gasket", False), (T.whole_word_in(F.lit(""), F.col("x")), "x", False),
        (T.holds_stem(F.col("x"), ["scal", "lime"]), "DeScaling", True), (T.entities(F.col("x")), "&lt;a&amp;&lt; &#39;&;", ["&#39;", "&amp;", "&lt;"]),
        (T.is_iri(F.col("x")), "http://a/b", True), (T.is_iri(F.col("x")), "a b:c", False), (T.is_iri(F.col("x")), "plain", False), (T.is_iri(F.col("x")), "a:\x01", False),
        (T.is_language_tag(F.col("x")), "en-GB", True), (T.is_language_tag(F.col("x")), "e n", False), (T.literal(F.col("x"), F.lit("en")), 'a"\\\n', '"a\\"\\\\\\n"@en'),
        (T.shown_as(F.col("x")), "altLabel", "Also called"), (T.shown_as(F.col("x")), "odd", "odd"), (T.jargon(F.col("x")), "see SKOS:x", ["(?i)skos:"]), (T.jargon(F.col("x")), "plain", []),
        (T.server_event(F.struct(F.col("x"))), "y", 'data: {"x":"y"}\n\n'), (T.readable(F.col("x"), F.lit(True)), "<b>a</b>", "a"), (T.heading_text(F.col("x")), "## A b ", "A b"),
    ]
    for column, raw, want in cases:
        assert value(spark, column, x=raw) == want, (raw, want)


def test_differences(spark):
    cases = [((2.0, 1.0, "flow", "flow"), 0.5), ((2.0, 1.0, "flow", None), None), ((0.0, 0.0, None, None), 0.0), ((None, 1.0, None, None), None)]
    rows = spark.createDataFrame([c for c, _ in cases], "a double, b double, x string, y string")
    assert [r["d"] for r in rows.select(U.relative_difference(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("d")).collect()] == [w for _, w in cases]


def test_normal_and_plain_texts_are_not_looked_up(spark):
    """What is normal stays, and a text of single bytes needs no table: both as the whole way has them."""
    texts = ["gas bottle", "a", "A-b", "a  b", " a", "a\n", "a b\n", "", "Straße", "ﬁn", "é", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(T.normalise(F.col("x"))).collect()] == ["gas bottle", "a", "a b", "a b", "a", "a", "a b", "", "strasse", "fin", "e", None]
    assert [r[0] for r in df.where(F.col("x").rlike(T.NORMAL)).collect()] == ["gas bottle", "a"]
