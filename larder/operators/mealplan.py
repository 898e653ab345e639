"""Meal plans: ingredient totals, best prices, costs, macros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed_values as fv
from larder.functions import numbers as nm
from larder.functions.text import clean_ingredient_name, extract_grams, norm_text, strip_quantity, words
from larder.operators.scaling import keep_first
from larder.operators.search import cheapest_matches
from larder.session import cut_lineage


def ingredient_totals(lines: DataFrame, summary: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Grams per (plan, cleaned ingredient), plus summary ingredients not seen, with 0 g.

    ``lines`` has plan, raw; ``summary`` has plan, ingredient. The raw lines stay
    rows (count and first are reported); a popular ingredient is never gathered.
    """
    listed = lines.select(
        plan, clean_ingredient_name("raw").alias("ingredient"), extract_grams("raw").alias("grams"), "raw", F.lit(1).alias("line")
    )
    extra = summary.select(plan, F.lower(F.trim("ingredient")).alias("ingredient"))
    both = listed.unionByName(extra, allowMissingColumns=True)  # one aggregation serves both
    return both.groupBy(plan, "ingredient").agg(
        F.coalesce(F.sum("grams"), F.lit(0)).alias("total_grams"),
        F.count("line").alias("n_lines"),
        F.coalesce(F.min("raw"), F.col("ingredient")).alias("first_raw"),
    )


def _tiers(ingredient: Column) -> Column:
    w = words(norm_text(strip_quantity(ingredient)), 2)
    tier = lambda n, terms: F.struct(F.lit(n).alias("tier"), terms.alias("terms"))
    return F.filter(
        F.array(
            tier(1, F.slice(w, 1, 3)), tier(2, F.slice(w, 1, 2)), tier(3, F.slice(w, 1, 1)), tier(4, F.slice(w, 2, 1)),
        ),
        lambda t: F.size(t["terms"]) > 0,
    )


def best_prices(ingredients: DataFrame, products: DataFrame) -> DataFrame:
    """Best product of each distinct ingredient: the most specific tier with a hit, then the lowest price.

    Term sets are shared between ingredients and tiers, so each is matched once and
    reduced to its one cheapest product before it is joined back.
    """
    asked = ingredients.select("ingredient").distinct().select("ingredient", F.inline(_tiers(F.col("ingredient"))))
    asked = cut_lineage(asked)  # read by the matching and again by the join back
    pool = products.where("price > 0").withColumn("match_key", F.lower("normalized_name"))
    best = cheapest_matches(pool, asked.select("terms").distinct(), 1)
    unit = F.col("price_per_unit") if "price_per_unit" in products.columns else F.lit(None).cast("string")
    found = asked.join(best, "terms").select(
        "ingredient", "tier", F.col("id").alias("product_id"), F.col("name").alias("product_name"), "price",
        F.col("supermarket").alias("store"), unit.alias("unit"),
    )
    return keep_first(found, ["ingredient"], ["tier"])


def shopping_list(totals: DataFrame, prices: DataFrame) -> DataFrame:
    """Each ingredient with its cost; not found when no product matched."""
    j = totals.join(prices, "ingredient", "left")
    cost = F.when(F.col("total_grams") > 0, nm.ingredient_cost("price", "unit", "total_grams")).otherwise(F.col("price"))
    return j.select(
        *[c for c in totals.columns],
        F.col("product_id").isNotNull().alias("found"),
        cost.alias("cost"),
        "store",
        F.coalesce("product_name", "ingredient").alias("product_name"),
    )


def price_plans(lines: DataFrame, summary: DataFrame, products: DataFrame) -> DataFrame:
    """Shopping lists of all plans, from ingredient lines to costs."""
    totals = cut_lineage(ingredient_totals(lines, summary))  # the ingredients to price, and the rows to cost
    return shopping_list(totals, best_prices(totals, products))


def shopping_stats(shopping: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Totals per plan; coverage is null for a plan without ingredients."""
    cents = F.sum(F.when(F.col("found"), F.coalesce("cost", F.lit(0.0)).cast("decimal(18,2)"))).cast("double")
    n, found = F.count("ingredient"), F.count_if(F.col("found"))
    return shopping.groupBy(plan).agg(
        n.alias("total_ingredients"), found.alias("found_in_db"), (n - found).alias("not_found"),
        nm.js_round(F.coalesce(cents, F.lit(0.0)), 2).alias("estimated_cost"),
        nm.js_round(F.try_divide(found, n) * 100).alias("coverage_percent"),
    )


def enrich_meals(meals: DataFrame, prices: DataFrame, key: str = "meal_id") -> DataFrame:
    """Nested ingredients of each meal with price and store; missing snacks get the defaults.

    ``meals`` has a unique key, ingredients (array of text) and snacks (struct). An
    array is rebuilt from its own meal's rows only, so groups are as long as one meal.
    """
    lines = meals.select(key, F.posexplode("ingredients").alias("pos", "raw")).withColumn("ingredient", clean_ingredient_name("raw"))
    grams = extract_grams("raw")
    priced = lines.join(prices, "ingredient", "left").select(
        key, "pos", "raw", F.col("product_id").isNotNull().alias("found"),
        F.when(nm.num_or_zero(grams) > 0, nm.ingredient_cost("price", "unit", grams)).otherwise(F.col("price")).alias("price"),
        "store",
    )
    nested = priced.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col("raw").alias("name"), "found", "price", "store"))).alias("ingredients")
    )
    morning, afternoon = fv.DEFAULT_SNACKS
    default = F.struct(F.lit(morning).alias("morning"), F.lit(afternoon).alias("afternoon"))
    return meals.drop("ingredients").join(nested, key, "left").withColumn("snacks", F.coalesce("snacks", default))


def day_macros(meals: DataFrame, keys) -> DataFrame:
    """Macro sums per day over the main slots; alternatives (``*_alt``) do not add."""
    main = ~F.col("slot").endswith("_alt")
    total = lambda c: F.sum(F.when(main, nm.num_or_zero(c)).otherwise(0))
    return meals.withColumn("kcal", nm.macro_kcal("protein", "carbs", "fat")).groupBy(*keys).agg(
        *[total(c).alias(c) for c in ("kcal", "protein", "carbs", "fat")]
    )


def plan_summary(days: DataFrame, plan: str, target=(30, 40, 30)) -> DataFrame:
    """Average kcal per day and achieved macro shares; the target when there is no energy."""
    s = days.groupBy(plan).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("kcal", "protein", "carbs", "fat")]
    )
    avg_kcal = nm.js_round(F.col("kcal") / F.col("n"))

    def share(column, per_gram, fallback):
        part = F.col(column) / F.col("n") * per_gram / (F.col("kcal") / F.col("n")) * 100
        return F.when(avg_kcal > 0, nm.js_round(part)).otherwise(fallback)

    return s.select(
        plan, avg_kcal.alias("avg_kcal_per_day"), share("protein", 4, target[0]).alias("protein_pct"),
        share("carbs", 4, target[1]).alias("carbs_pct"), share("fat", 9, target[2]).alias("fat_pct"),
    )
