"""Expressions over arrays, maps and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import fixed_values as fv
from larder.functions.numbers import falsy_to_null, health_score, num_or_zero
from larder.functions.text import clean_text, js_trim, let, norm_text, strip_packaging_words


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- recipe pages -----------------------------------------------------------

JSONLD = "(?is)<script[^>]*type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"
RECIPE_FIELDS = """name STRING, description STRING, image STRING, recipeYield STRING, totalTime STRING,
    cookTime STRING, prepTime STRING, recipeCuisine STRING, keywords STRING,
    recipeIngredient ARRAY<STRING>, recipeInstructions ARRAY<STRING>,
    nutrition STRUCT<calories STRING, proteinContent STRING, carbohydrateContent STRING,
    fatContent STRING, fiberContent STRING>"""


def recipe_body(bodies: Column) -> Column:
    """Of JSON-LD texts: the first Recipe, else the first Recipe inside a @graph."""
    is_recipe = lambda b: F.get_json_object(b, "$['@type']") == "Recipe"
    none = F.array().cast("array<string>")

    def pick(bs):
        nodes = F.flatten(
            F.transform(bs, lambda b: F.coalesce(F.from_json(F.get_json_object(b, "$['@graph']"), "array<string>"), none))
        )
        return F.coalesce(F.get(F.filter(bs, is_recipe), 0), F.get(F.filter(nodes, is_recipe), 0))

    return let(bodies, pick)


def jsonld_recipe(html) -> Column:
    """The recipe among the JSON-LD blocks of a page, as raw JSON."""
    return recipe_body(F.regexp_extract_all(_c(html), F.lit(JSONLD), F.lit(1)))


def jsonld_fields(body) -> Column:
    """Parsed recipe; text-or-object members stay JSON text."""
    return F.from_json(_c(body), RECIPE_FIELDS)


def first_image(image) -> Column:
    """First of an array, the url of an object, or the text itself."""
    c = _c(image)
    return F.when(F.startswith(c, F.lit("[")), F.get_json_object(c, "$[0]")).when(
        F.startswith(c, F.lit("{")), F.get_json_object(c, "$.url")
    ).otherwise(c)


# --- offer tiles ------------------------------------------------------------

TILE_SCHEMA = """fullTitle STRING, title STRING,
    price STRUCT<price: DOUBLE, oldPrice: DOUBLE, priceTheme: STRING,
      packaging: STRUCT<text: STRING>, basePrice: STRUCT<text: STRING>>,
    ribbons ARRAY<STRUCT<text: STRING, label: STRING>>,
    stockAvailability STRUCT<available: BOOLEAN>,
    media ARRAY<STRUCT<url: STRING>>, imageUrl STRING, totalTime STRING"""


def parse_tile(payload) -> Column:
    return F.from_json(_c(payload), TILE_SCHEMA)


def in_stock(tile: Column) -> Column:
    return ~F.coalesce(tile["stockAvailability"]["available"] == F.lit(False), F.lit(False))


def offer_from_tile(tile: Column) -> Column:
    """Offer record of a parsed tile (name, prices, sale flags, image, unit price text)."""
    price = tile["price"]
    old = F.when(price["oldPrice"] > 0, price["oldPrice"])
    ribbon = F.transform(
        F.coalesce(tile["ribbons"], F.array().cast("array<struct<text:string,label:string>>")),
        lambda r: F.lower(F.coalesce(F.nullif(r["text"], F.lit("")), F.nullif(r["label"], F.lit("")), F.lit(""))),
    )
    percents = F.filter(
        F.transform(ribbon, lambda t: F.regexp_extract(t, "-?\\d+\\s*%", 0)), lambda t: t != ""
    )
    plus_one = F.exists(ribbon, lambda t: t.contains("+1"))
    name = strip_packaging_words(F.coalesce(F.nullif(tile["fullTitle"], F.lit("")), tile["title"], F.lit("")))
    image = F.coalesce(F.get(tile["media"], 0)["url"], tile["imageUrl"])
    theme = F.coalesce(price["priceTheme"], F.lit("")) == "white_red"
    return F.struct(
        name.alias("name"),
        norm_text(name).alias("normalized_name"),
        price["price"].alias("price"),
        old.alias("old_price"),
        (theme | old.isNotNull() | plus_one | (F.size(percents) > 0)).alias("is_on_sale"),
        plus_one.alias("is_1plus1"),
        F.try_element_at(percents, F.lit(-1)).alias("discount_percent"),
        image.alias("image_url"),
        price["basePrice"]["text"].alias("price_per_unit"),
    )


# --- fenced JSON ------------------------------------------------------------

def fenced_json(raw) -> Column:
    """JSON object text out of a reply with code fences or prose around it, else null."""
    bare = js_trim(F.regexp_replace(_c(raw), "```json|```", ""))
    widest = F.regexp_extract(bare, "(?s)\\{.*\\}", 0)
    is_json = lambda t: F.try_parse_json(t).isNotNull() & (t != "")
    return F.when(is_json(bare), bare).when(is_json(widest), widest)


# --- plate scans ------------------------------------------------------------

SCAN_SCHEMA = """foods ARRAY<STRUCT<name: STRING, nameEn: STRING, emoji: STRING, portion: STRING,
    calories: STRING, protein: STRING, carbs: STRING, fat: STRING, sugar: STRING, fiber: STRING>>,
    totals MAP<STRING, STRING>, healthScore STRING, confidence STRING, mealType STRING, tip STRING,
    question STRUCT<text: STRING, choices: ARRAY<STRING>>"""


def scan_result(scan: Column) -> Column:
    """Validated scan header: confidence, meal type, tip, score, question."""
    question = scan["question"]
    asked = F.slice(
        F.filter(F.transform(question["choices"], lambda c: clean_text(c)), lambda c: c != ""), 1, 3
    )
    valid = (F.coalesce(question["text"], F.lit("")) != "") & (F.size(asked) > 0)
    return F.struct(
        health_score(scan["healthScore"]).alias("health_score"),
        F.when(scan["confidence"].isin("high", "medium", "low"), scan["confidence"])
        .otherwise("medium").alias("confidence"),
        clean_text(scan["mealType"], fv.DEFAULT_MEAL_TYPE).alias("meal_type"),
        clean_text(scan["tip"], fv.DEFAULT_TIP).alias("tip"),
        F.when(valid, F.struct(clean_text(question["text"]).alias("text"), asked.alias("choices"))).alias("question"),
    )


def top_labels(labels: Column, floor: float = 0.05, k: int = 5) -> Column:
    """First ``k`` labels scored above ``floor``, score as a whole percentage."""
    kept = F.slice(F.filter(labels, lambda d: d["score"] > floor), 1, k)
    return F.transform(
        kept,
        lambda d: F.struct(d["label"].alias("label"), F.floor(d["score"] * 100 + 0.5).alias("score")),
    )


# --- text marks -------------------------------------------------------------

# Label that names a nutrient in a fact line, first class that matches wins.
FACT_LABELS = [
    ("calories", "(?iu)θερμίδ|kcal"), ("protein", "(?iu)πρωτεΐν"), ("carbs", "(?iu)υδατάνθρ"),
    ("fat", "(?iu)λιπαρ(?!.*κορεσ)"), ("fiber", "(?iu)φυτικ"),
]


def fact_of_line(line) -> Column:
    """struct(field, value) of one nutrition fact line; null without a number or a label."""
    c = _c(line)
    value = falsy_to_null(F.regexp_extract(c, "(\\d+(?:\\.\\d+)?)", 1).try_cast("double"))
    field = F.coalesce(*[F.when(c.rlike(pattern), name) for name, pattern in FACT_LABELS])
    return F.when(value.isNotNull() & field.isNotNull(), F.struct(field.alias("field"), value.alias("value")))


def labelled_numbers(text, labels: dict[str, str]) -> dict[str, Column]:
    """Number standing before each label, null when missing or zero."""
    c = _c(text)
    return {
        name: falsy_to_null(F.regexp_extract(c, f"(?iu)(\\d+(?:\\.\\d+)?)\\s*{label}", 1).try_cast("double"))
        for name, label in labels.items()
    }


# Labels that follow a number in a flat nutrition text.
FLAT_LABELS = {"calories": "Θερμίδ", "fat": "Λιπαρά", "carbs": "Υδατ", "protein": "Πρωτεΐνη", "fiber": "Φυτικές"}


def minutes_sum(text) -> Column:
    """Sum of all n' marks; zero becomes null."""
    marks = F.regexp_extract_all(_c(text), F.lit("(\\d+)'"), F.lit(1))
    return falsy_to_null(F.aggregate(marks, F.lit(0).cast("bigint"), lambda a, m: a + F.coalesce(m.try_cast("bigint"), F.lit(0))))


def servings_of(text, default: int) -> Column:
    return F.coalesce(falsy_to_null(F.regexp_extract(_c(text), "(\\d+)", 1).try_cast("int")), F.lit(default))


def image_choice(src, *lazy, srcset=None, data_srcset=None) -> Column:
    """The src unless it is a placeholder, then lazy-load attributes, then the first srcset url."""
    s = F.coalesce(_c(src), F.lit(""))
    blank = lambda c: F.nullif(_c(c), F.lit(""))
    first_url = lambda c: blank(F.split_part(js_trim(F.split_part(_c(c), F.lit(","), F.lit(1))), F.lit(" "), F.lit(1)))
    options = [blank(x) for x in lazy]
    options += [first_url(x) for x in (srcset, data_srcset) if x is not None]
    placeholder = F.startswith(s, F.lit("data:")) | (F.length(s) < 10)
    picked = F.when(placeholder, F.coalesce(*options, s)).otherwise(s)
    return F.when(F.length(picked) >= 10, picked)


def promo_flags(promos) -> Column:
    """struct(is_on_sale, is_1plus1) from promo texts."""
    low = F.transform(_c(promos), lambda p: F.lower(p))
    gift = F.exists(low, lambda p: p.contains("1+1") | p.contains("δωρο"))
    sale = F.exists(low, lambda p: p.contains("%") | p.contains("-") | p.contains("super"))
    return F.struct((sale | gift).alias("is_on_sale"), gift.alias("is_1plus1"))


def brand_name(structured, brand, name, fallback) -> Column:
    """Structured name, else 'brand name', else the generic title."""
    blank = lambda c: F.nullif(js_trim(c), F.lit(""))
    joined = js_trim(F.concat_ws(" ", blank(brand), blank(name)))
    return F.coalesce(blank(structured), F.nullif(joined, F.lit("")), js_trim(fallback))


# --- tags and classes -------------------------------------------------------

def recipe_tags_web(protein, calories, carbs, fat, fiber, minutes) -> Column:
    """Tags of a scraped recipe; missing carbs and fat do not count as low, missing calories do."""
    or_big = lambda x: F.coalesce(falsy_to_null(x), F.lit(999))
    return F.array_compact(
        F.array(
            F.when(num_or_zero(protein) > 25, "high-protein"),
            F.when(num_or_zero(calories) < 400, "healthy"),
            F.when(or_big(carbs) < 15, "low-carb"),
            F.when(or_big(fat) < 8, "low-fat"),
            F.when(num_or_zero(fiber) > 5, "high-fiber"),
            F.when((num_or_zero(minutes) > 0) & (_c(minutes) <= 25), "quick"),
        )
    )


def recipe_tags_api(flags: dict, health, minutes, protein, carbs, fat, dish_types) -> Column:
    """Tags of an API recipe: flags, missing-as-zero macros, meal types."""
    types = F.transform(_c(dish_types), lambda t: F.lower(t))
    has = lambda *names: F.arrays_overlap(types, F.array(*[F.lit(n) for n in names]))
    yes = lambda name: F.coalesce(flags.get(name, F.lit(False)), F.lit(False))
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.when(yes("very_healthy") | (num_or_zero(health) > 70), "healthy"),
                F.when(_c(minutes) <= 25, "quick"),
                F.when(yes("cheap"), "budget"),
                F.when(yes("vegan"), "vegan"),
                F.when(yes("vegetarian"), "vegetarian"),
                F.when(yes("gluten_free"), "gluten-free"),
                F.when(yes("dairy_free"), "dairy-free"),
                F.when(num_or_zero(protein) > 25, "high-protein"),
                F.when(num_or_zero(carbs) < 15, "low-carb"),
                F.when(num_or_zero(fat) < 10, "low-fat"),
                F.when(has("breakfast", "morning meal"), "breakfast"),
                F.when(has("snack"), "snack"),
                F.when(has("dessert"), "dessert"),
            )
        )
    )


def category_web(*hints) -> Column:
    text = F.lower(F.concat_ws(" ", *[_c(h) for h in hints]))
    return F.coalesce(
        *[F.when(text.rlike(f"(?iu){pattern}"), label) for label, pattern in fv.CATEGORY_PATTERNS],
        F.lit(fv.DEFAULT_CATEGORY),
    )


def category_api(dish_types) -> Column:
    types = F.transform(_c(dish_types), lambda t: F.lower(t))
    return F.coalesce(
        *[
            F.when(F.arrays_overlap(types, F.array(*[F.lit(n) for n in names])), label)
            for label, names in fv.CATEGORY_DISH_TYPES
        ],
        F.lit(fv.DEFAULT_CATEGORY),
    )


def label_map(labels: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])


def cuisine_label(cuisines) -> Column:
    """First cuisine that has a label, else the international label."""
    labels = label_map(fv.CUISINES)
    found = F.array_compact(F.transform(_c(cuisines), lambda c: F.try_element_at(labels, F.lower(c))))
    return F.coalesce(F.get(found, 0), F.lit(fv.DEFAULT_CUISINE))


def difficulty(minutes, items, unknown_time: str | int = fv.MEDIUM) -> Column:
    """Easy to 20 min and 6 items, medium to 45 and 12, else hard.

    ``unknown_time`` is the label (pages) or the minutes (API) used when time is missing or 0.
    """
    m = falsy_to_null(minutes)
    if isinstance(unknown_time, int):
        m = F.coalesce(m, F.lit(unknown_time))
    n = _c(items)
    rated = (
        F.when((m <= 20) & (n <= 6), fv.EASY).when((m <= 45) & (n <= 12), fv.MEDIUM).otherwise(fv.HARD)
    )
    return rated if isinstance(unknown_time, int) else F.when(m.isNull(), unknown_time).otherwise(rated)


def has_palm_oil(text) -> Column:
    return F.coalesce(_c(text).rlike("(?i)palm"), F.lit(False))
