"""From raw page records to stored recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed_values as fv
from larder.functions import structures as st
from larder.functions import text as tx
from larder.functions.dates import iso_duration_minutes
from larder.functions.numbers import falsy_to_null
from larder.operators.scaling import as_cols

NO_LINES = "array<string>"
MACROS = ["calories", "protein", "carbs", "fat", "fiber"]
# Nutrition members of structured recipe data.
LD_MACROS = {
    "calories": "calories", "protein": "proteinContent", "carbs": "carbohydrateContent", "fat": "fatContent", "fiber": "fiberContent",
}


def _first_full(*arrays: Column) -> Column:
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays], F.array().cast(NO_LINES))


def build_recipes(raw: DataFrame, default_servings: int = 4) -> DataFrame:
    """Recipe rows of raw page records (see sources.html), with an ``outcome`` of 'ok' or 'error'.

    Structured data wins over page elements, and those over sections found in the text.
    An error has no title, or neither ingredients nor instructions.
    """
    ld = st.jsonld_fields(st.recipe_body(F.coalesce("jsonld", F.array().cast(NO_LINES))))
    r = raw.withColumn("ld", ld).withColumn("parts", tx.section_split(F.coalesce("content", F.lit(""))))
    step_text = lambda s: F.coalesce(F.when(F.startswith(s, F.lit("{")), F.get_json_object(s, "$.text")), s)
    ingredients = _first_full(F.col("ld.recipeIngredient"), F.col("ingredients"), F.split("parts.ingredients", "\n", -1))
    steps = _first_full(
        F.transform("ld.recipeInstructions", step_text), F.col("instructions"), tx.split_instructions("parts.instructions")
    )
    time_text = F.coalesce("ld.totalTime", "ld.cookTime", "ld.prepTime", "time_raw")
    r = r.select(
        *[c for c in raw.columns if c in ("page_id", "site", "url")],
        tx.clean_html(F.coalesce(F.nullif("ld.name", F.lit("")), tx.title_from_page("title"), F.lit(""))).alias("title"),
        tx.clean_html(F.substring(F.coalesce("ld.description", "description", F.lit("")), 1, 300)).alias("description"),
        F.coalesce(F.nullif("image", F.lit("")), st.first_image("ld.image"), F.lit("")).alias("image"),
        st.servings_of(F.coalesce("ld.recipeYield", "servings_text", F.lit("")), default_servings).alias("servings"),
        F.coalesce(falsy_to_null(iso_duration_minutes(time_text)).cast("bigint"), st.minutes_sum("minutes_text")).alias("minutes"),
        tx.sanitize_lines(ingredients).alias("ingredients"),
        tx.sanitize_lines(steps, instructions=True).alias("instructions"),
        ((F.size(ingredients) <= 0) & (F.size(steps) <= 0)).alias("empty"),
        F.coalesce(F.nullif("ld.recipeCuisine", F.lit("")), F.lit(fv.CUISINES["greek"])).alias("cuisine"),
        tx.split_keywords(F.regexp_replace(F.coalesce("ld.keywords", F.lit("")), '[\\[\\]"]', "")).alias("keywords"),
        *[_macro(name).alias(name) for name in MACROS],
    )
    hints = F.concat_ws(" ", "title", "description", "keywords", "ingredients")
    tags = st.recipe_tags_web(*[F.col(c) for c in ("protein", "calories", "carbs", "fat", "fiber", "minutes")])
    return r.select(
        "*",
        st.difficulty("minutes", F.size("ingredients")).alias("difficulty"),
        st.category_web(hints).alias("category"),
        tags.alias("tags"),
        (F.coalesce(falsy_to_null("calories"), F.lit(999)) < 600).alias("is_healthy"),
        F.when((F.col("title") == "") | F.col("empty"), "error").otherwise("ok").alias("outcome"),
    ).drop("empty", "keywords")


def _macro(name: str) -> Column:
    """Number from the structured data, else from the last fact line that names it."""
    stated = F.regexp_extract(F.col(f"ld.nutrition.{LD_MACROS[name]}"), "^\\s*(\\d+(?:\\.\\d+)?)", 1).try_cast("double")
    facts = F.filter(F.transform(F.coalesce("facts", F.array().cast(NO_LINES)), st.fact_of_line), lambda f: f["field"] == name)
    flat = st.labelled_numbers(F.array_join("facts", " "), st.FLAT_LABELS)[name]
    return F.coalesce(falsy_to_null(stated), F.try_element_at(facts, F.lit(-1))["value"], flat)


def store_new(built: DataFrame, stored: DataFrame, order) -> DataFrame:
    """Outcome of every built recipe: 'error', 'skipped' (url or title known, or a repeat
    within the run) or 'added'. ``stored`` has url, title, site."""
    key = F.lower(F.trim("title"))
    at = F.struct(*as_cols(order))
    urls = stored.select("url").where("url IS NOT NULL").distinct().withColumn("url_known", F.lit(True))
    titles = stored.select("site", key.alias("title_key")).distinct().withColumn("title_known", F.lit(True))
    b = built.withColumn("title_key", key).join(urls, "url", "left")
    fresh = F.col("url_known").isNull() & (F.col("outcome") == "ok")
    first = b.where(fresh).groupBy("site", "title_key").agg(F.min(at).alias("first"))
    known = first.join(titles, ["site", "title_key"], "left")
    j = b.join(known, ["site", "title_key"], "left")
    added = fresh & F.col("title_known").isNull() & (at == F.col("first"))
    outcome = F.when(F.col("url_known").isNotNull(), "skipped").when(F.col("outcome") == "error", "error").when(added, "added")
    return j.withColumn("outcome", outcome.otherwise("skipped")).drop("url_known", "title_known", "title_key", "first")
