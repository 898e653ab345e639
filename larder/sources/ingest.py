"""Outside payloads to flat records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed_values as fv
from larder.functions.numbers import js_round, salt_from_sodium
from larder.functions.structures import has_palm_oil
from larder.functions.text import js_trim
from larder.operators.scaling import add_kept

RECIPE_API_SCHEMA = """title STRING, summary STRING, image STRING, servings INT, readyInMinutes INT,
    healthScore DOUBLE, sourceUrl STRING, instructions STRING, cuisines ARRAY<STRING>, dishTypes ARRAY<STRING>,
    nutrition STRUCT<nutrients: ARRAY<STRUCT<name: STRING, amount: DOUBLE>>>,
    extendedIngredients ARRAY<STRUCT<original: STRING, originalString: STRING, amount: STRING, unit: STRING, name: STRING>>,
    analyzedInstructions ARRAY<STRUCT<steps: ARRAY<STRUCT<step: STRING>>>>"""


def api_recipes(raw: DataFrame, key: str, payload: str) -> DataFrame:
    """Nested recipe JSON to one row: nutrients by lower-case name, ingredient lines, steps.

    Recipes without steps are dropped.
    """
    r = raw.select(key, F.from_json(payload, RECIPE_API_SCHEMA).alias("r"))
    nutrient = lambda name: js_round(
        F.get(F.filter("r.nutrition.nutrients", lambda n: F.lower(n["name"]) == name), 0)["amount"]
    )
    blank = lambda c: F.nullif(c, F.lit(""))
    lines = F.transform(
        F.coalesce(F.col("r.extendedIngredients"), F.array()),
        lambda i: F.coalesce(blank(i["original"]), blank(i["originalString"]), F.concat_ws(" ", i["amount"], i["unit"], i["name"])),
    )
    analysed = F.filter(
        F.transform(F.get("r.analyzedInstructions", 0)["steps"], lambda s: s["step"]),
        lambda s: F.coalesce(s, F.lit("")) != "",
    )
    prose = F.regexp_replace("r.instructions", "<[^>]*>", "")
    spelt = F.filter(F.transform(F.split(prose, "(?:\\d+\\.\\s*|\\n)+"), js_trim), lambda s: F.length(s) > 10)
    steps = F.when(F.size("r.analyzedInstructions") > 0, analysed).otherwise(spelt)
    return add_kept(r, "steps", steps, lambda s: F.size(s) > 0).select(
        key,
        F.col("r.title").alias("title"),
        *[nutrient(n).alias(alias) for n, alias in
          (("calories", "calories"), ("protein", "protein"), ("carbohydrates", "carbs"), ("fat", "fat"), ("fiber", "fiber"), ("sugar", "sugar"))],
        F.coalesce("r.servings", F.lit(4)).alias("servings"),
        F.coalesce("r.readyInMinutes", F.lit(30)).alias("minutes"),
        lines.alias("ingredients"),
        F.col("steps").alias("instructions"),
        F.col("r.cuisines").alias("cuisines"),
        F.col("r.dishTypes").alias("dish_types"),
        F.col("r.sourceUrl").alias("url"),
    )


def wide_to_array(columns: list[str], n: int = 20) -> Column:
    """Columns strIngredient1..n and strMeasure1..n to one array of 'measure name'."""
    items = []
    for i in range(1, n + 1):
        if f"strIngredient{i}" not in columns:
            continue
        name = F.nullif(js_trim(f"strIngredient{i}"), F.lit(""))
        measure = F.nullif(js_trim(f"strMeasure{i}"), F.lit(""))
        items.append(F.when(name.isNotNull(), F.concat_ws(" ", measure, name)))
    return F.array_compact(F.array(*items))


def wide_meal(df: DataFrame) -> DataFrame:
    """Wide meal payload to a recipe row."""
    tags = F.filter(F.transform(F.split("strTags", ","), js_trim), lambda t: t != "")
    return df.select(
        F.concat(F.lit("mealdb_"), F.col("idMeal").cast("string")).alias("id"),
        F.col("strMeal").alias("title"),
        F.col("strMealThumb").alias("image"),
        F.col("strCategory").alias("category"),
        F.col("strArea").alias("area"),
        F.coalesce("strInstructions", F.lit("")).alias("instructions"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        wide_to_array(df.columns).alias("ingredients"),
    )


NUTRIENT_COLUMNS = ["kcal", "proteins", "fat", "saturated", "carbs", "sugars", "fiber", "sodium", "cholesterol"]


def _with_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", salt_from_sodium("sodium"))


def _usda(df: DataFrame) -> DataFrame:
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    first = lambda ids: F.get(
        F.filter("foodNutrients", lambda n: n["nutrientId"].isin(*ids) & n["value"].isNotNull()), 0
    )["value"]
    ids_of = lambda field: [i for i, f in fv.NUTRIENT_FIELDS_BY_ID.items() if f == field]
    return _with_salt(
        df.select(
            "barcode", F.lit("usda").alias("source"), F.col("description").alias("name"),
            F.coalesce(have("brandOwner"), have("brandName")).alias("brand"),
            has_palm_oil(have("ingredients")).alias("has_palm_oil"),
            *[js_round(first(ids_of(f)), 1).alias(f) for f in NUTRIENT_COLUMNS],
        )
    )


def _edamam(df: DataFrame) -> DataFrame:
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    code = lambda field: F.coalesce(*[F.try_element_at("nutrients", F.lit(c)) for c, f in fv.NUTRIENT_FIELDS_BY_CODE if f == field])
    return _with_salt(
        df.select(
            "barcode", F.lit("edamam").alias("source"), F.col("label").alias("name"), have("brand").alias("brand"),
            F.lit(False).alias("has_palm_oil"), *[js_round(code(f), 1).alias(f) for f in NUTRIENT_COLUMNS],
        )
    )


# Field names of the third nutrition source.
NF_FIELDS = {
    "proteins": "nf_protein", "fat": "nf_total_fat", "saturated": "nf_saturated_fat",
    "carbs": "nf_total_carbohydrate", "sugars": "nf_sugars", "fiber": "nf_dietary_fiber", "sodium": "nf_sodium",
}


def _nutritionix(df: DataFrame) -> DataFrame:
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    text = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select(
        "barcode", F.lit("nutritionix").alias("source"), F.col("food_name").alias("name"),
        text("brand_name").alias("brand"), F.lit(False).alias("has_palm_oil"),
        js_round(have("nf_calories")).cast("double").alias("kcal"),
        *[js_round(have(column), 1).alias(field) for field, column in NF_FIELDS.items()],
        F.lit(None).cast("double").alias("cholesterol"),
        salt_from_sodium(have("nf_sodium")).alias("salt"),  # from the unrounded sodium
    )


def nutrition_products(usda: DataFrame, edamam: DataFrame, nutritionix: DataFrame) -> DataFrame:
    """Three nutrition payloads in one product schema."""
    parts = [_usda(usda), _edamam(edamam), _nutritionix(nutritionix)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
