"""Hand-made rows, mostly Greek, for the column functions."""

import pytest
from pyspark.sql import functions as F

from larder.functions import dates, numbers, search, structures, text


def one(spark, column, **values):
    schema = ", ".join(
        f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}"
        for k, v in values.items()
    ) or "x int"
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("fn, given, want", [
    (text.norm_text, "Γάλα ΦΡΈΣΚΟ ", "γαλα φρεσκο"),
    (text.norm_text, "Crème Brûléé ", "creme brulee"),
    (text.greeklish_to_greek, "gala", "γαλα"),
    (text.greeklish_to_greek, "kotopoulo", "κοτοπουλο"),
    (text.greeklish_to_greek, "γάλα", None),
    (text.iota_canonical, "ξυδι ζαχαρη", "ξιδι ζαχαρι"),
    (text.substitute_norm, "Γάλα Φρέσκο", "γαλα"),
    (text.strip_quantity, "200γρ κοτόπουλο στήθος", "κοτόπουλο στήθος"),
    (text.extract_grams, "200γρ κοτόπουλο στήθος", 200),
    (text.extract_grams, "2 αυγά (120γρ)", 120),
    (text.extract_grams, "αλάτι", None),
    (text.clean_ingredient_name, "200γρ Κοτόπουλο (στήθος)", "κοτόπουλο"),
    (text.clean_html, "<p>a&nbsp;&amp; b</p>&#39;<br>c &copy;", "a & b c"),
    (text.strip_step_prefix, "FITNESS ΣΥΝΤΑΓΉ: Βράζουμε", "Βράζουμε"),
    (text.strip_packaging_words, "Μήλα το Τεμάχιο", "Μήλα"),
    (text.url_canonical, "http://a/b?x=1#t", "http://a/b"),
    (text.title_from_page, "Φακές – Site", "Φακές"),
    (text.is_section_line, "Για τη σάλτσα:", True),
    (text.is_section_line, "Υλικά", True),
    (text.is_section_line, "Υλικάκια", False),
    (text.is_noise_line, "ΒΑΣΙΚΑ ΥΛΙΚΑ", True),
    (text.is_noise_line, "Μπορεί να σας ενδιαφέρουν", True),
    (text.is_noise_line, "2 αυγά", False),
    (numbers.parse_price, "€ 1,23", 1.23),
    (numbers.parse_price, "1 10", 1.10),
    (numbers.parse_price, "129", 1.29),
    (numbers.parse_price, "99", 99.0),
    (numbers.parse_price, "350,00", 3.5),
    (numbers.parse_price, "1.234,56", 1.234),
    (numbers.parse_price, "abc", None),
    (numbers.int_prefix, "12abc", 12),
    (numbers.int_prefix, "-3", 0),
    (numbers.int_prefix, "x", 0),
    (dates.iso_duration_minutes, "PT1H30M", 90),
    (dates.iso_duration_minutes, "PT45M", 45),
    (dates.iso_duration_minutes, None, None),
    (structures.minutes_sum, "10' και 20'", 30),
    (structures.category_web, "Τούρτα ΣΟΚΟΛΑΤΑ τουρτα", "Επιδόρπια"),
])
def test_text_to_value(spark, fn, given, want):
    got = one(spark, fn("a"), a=given)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_unit_price(spark):
    assert one(spark, numbers.parse_price(numbers.unit_price_guard("a")), a="2,98 €/κιλό") == 2.98


@pytest.mark.parametrize("name, q, want", [
    ("Γάλα", "γαλα", 100), ("Γάλα φρέσκο", "γαλα", 90), ("Φρέσκο γάλα", "γαλα", 80), ("Γαλακτομπούρεκο", "γαλα", 60),
    ("Αγάλακτη", "γαλα", 20), ("Τυρί", "γαλα", 0), ("Ξίδι", "ξυδι", 100), ("Τροφή γάτας κοτόπουλο", "κοτοπουλο", 8),
    ("Τσιπς με γεύση ντομάτα", "ντοματα", 24), ("Τροφή γάτας", "γατα", 60),
])
def test_match_score(spark, name, q, want):
    assert one(spark, search.match_score("n", "q"), n=name, q=q) == want


@pytest.mark.parametrize("terms, want", [(["φρεσκο", "γαλα"], 200), (["γαλα", "φρεσκο"], 170), (["γαλα"], 90), (["τυρι", "γαλα"], 0)])
def test_multi_word_score(spark, terms, want):
    assert one(spark, search.multi_word_score("n", F.col("ts")), n="Φρέσκο γάλα", ts=terms) == want


def test_expand_query(spark):
    assert one(spark, search.expand_query("q"), q=" Milk ") == [["γαλα"], ["μιλκ"], ["milk"]]
    assert one(spark, search.expand_query("q"), q="γάλα") == [["γαλα"]]
    assert one(spark, search.expand_query("q"), q="x") == []


@pytest.mark.parametrize("price, unit, grams, want", [
    (5.0, "2,98€/κιλό", 200, 0.60), (3.0, None, 250, 0.75), (3.0, None, 1500, 3.0), (3.0, None, 0, 3.0),
])
def test_ingredient_cost(spark, price, unit, grams, want):
    assert one(spark, numbers.ingredient_cost("p", "u", "g"), p=price, u=unit, g=grams) == pytest.approx(want)


def test_macro_ratio_sums_to_100(spark):
    assert [one(spark, c) for c in numbers.macro_ratio(F.lit(1), F.lit(1), F.lit(1))] == [33, 34, 33]
    assert [one(spark, c) for c in numbers.macro_ratio(F.lit(None).cast("int"), F.lit(0), F.lit(30))] == [30, 40, 30]


@pytest.mark.parametrize("stated, want", [(110, 110), (120, 100), (0, 100)])
def test_reconcile(spark, stated, want):
    assert one(spark, numbers.reconcile(F.lit(stated), F.lit(100))) == want


def test_rounding_is_half_up_on_the_double(spark):
    assert one(spark, numbers.js_round("x", 2), x=1.005) == 1.0
    assert one(spark, numbers.js_round("x"), x=-2.5) == -2


def test_lines(spark):
    lines = ["• 2 αυγά", "2 ΑΥΓΆ", "", "Για τη ζύμη:", "1. αλεύρι", "γάλα €2", "x"]
    assert one(spark, text.sanitize_lines("a"), a=lines) == ["2 αυγά", "αλεύρι"]
    assert one(spark, text.dedupe_lines("a"), a=["b", "Á", "a", "", "b"]) == ["b", "Á"]


def test_sections(spark):
    page = "Μια συνταγή. Υλικά: αλάτι Εκτέλεση: βράζουμε Οδηγίες: τέλος"
    got = one(spark, text.section_split("a"), a=page)
    assert (got["ingredients"], got["instructions"]) == (" αλάτι ", "βράζουμε Οδηγίες: τέλος")


def test_long_tail_without_end_mark_is_quick(spark):
    body = "One. Two! " + "word " * 20_000
    assert one(spark, text.sentence_chunks("a"), a=body) == ["One. Two!"]
    assert one(spark, text.sentence_chunks("a", 5), a="abc. def. g") == ["abc.", "def."]


def test_tags_keep_missing_value_rules(spark):
    none = F.lit(None).cast("int")
    assert one(spark, structures.recipe_tags_web(none, none, F.lit(0), F.lit(5), none, F.lit(20))) == ["healthy", "low-fat", "quick"]
    assert one(spark, structures.recipe_tags_api({}, none, none, none, none, F.lit(12), F.array())) == ["low-carb"]


def test_images(spark):
    pick = lambda **v: one(spark, structures.image_choice("src", "lazy", srcset="ss"), **v)
    assert pick(src="https://a.example/x.jpg", lazy=None, ss=None) == "https://a.example/x.jpg"
    assert pick(src="data:image/gif;base64,AAAA", lazy="https://b.example/y.jpg", ss=None) == "https://b.example/y.jpg"
    assert pick(src="", lazy=None, ss="https://c.example/z.jpg 1x, q 2x") == "https://c.example/z.jpg"
    assert pick(src="x.gif", lazy=None, ss=None) is None


def test_fenced_json(spark):
    assert one(spark, structures.fenced_json("a"), a='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, structures.fenced_json("a"), a='so: {"a": {"b": 2}} ok') == '{"a": {"b": 2}}'
    assert one(spark, structures.fenced_json("a"), a="none") is None


def test_facts(spark):
    assert one(spark, structures.fact_of_line("a"), a="Λιπαρά 12.5 γρ")["field"] == "fat"
    assert one(spark, structures.fact_of_line("a"), a="Λιπαρά κορεσμένα 3") is None
