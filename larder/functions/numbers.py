"""Number expressions. Rounding is half-up on the binary value (floor(x + 0.5))."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_round(x, places: int = 0) -> Column:
    """Half-up on the double itself: 1.005 to 2 places is 1.00, -2.5 is -2."""
    if places == 0:
        return F.floor(_c(x) + 0.5)
    scale = 10**places
    return F.floor(_c(x) * scale + 0.5) / F.lit(float(scale))


def falsy_to_null(x) -> Column:
    """0 counts as missing, as in ``x || other``."""
    return F.nullif(_c(x), F.lit(0))


def num_or_zero(x) -> Column:
    return F.coalesce(_c(x), F.lit(0))


def estimate_1dp(x) -> Column:
    """One decimal; negative and NaN become null."""
    c = _c(x)
    return F.when((c >= 0) & ~F.isnan(c), js_round(c, 1))


def clamp_macro(x) -> Column:
    r = js_round(x)
    return F.when(r >= 0, F.least(r, F.lit(9999)))


def int_prefix(text) -> Column:
    """Leading integer of a text; negative or missing gives 0."""
    return F.greatest(
        F.coalesce(F.regexp_extract(_c(text), "^\\s*([+-]?\\d+)", 1).try_cast("bigint"), F.lit(0)), F.lit(0)
    )


def parse_price(text) -> Column:
    """Price text to euros: decimals, 'euros cents', cents without a mark; else null."""
    t = F.trim(F.regexp_replace(F.replace(_c(text), F.lit("€"), F.lit("")), "\\s+", " "))
    decimal = "^(\\d+)[,.](\\d+)"
    pair = "^(\\d+) (\\d{1,2})$"
    value = F.concat(F.regexp_extract(t, decimal, 1), F.lit("."), F.regexp_extract(t, decimal, 2)).try_cast("double")
    whole = t.try_cast("double")
    return (
        F.when(t.rlike(decimal), F.when(value > 300, value / 100).otherwise(value))
        .when(
            t.rlike(pair),
            F.regexp_extract(t, pair, 1).try_cast("double") + F.regexp_extract(t, pair, 2).try_cast("double") / 100,
        )
        .when(t.rlike("^\\d+$"), F.when(whole > 99, whole / 100).otherwise(whole))
    )


UNIT_PRICE = "(?iu)/\\s*(τεμ|kg|lt|κιλ|λίτρ|100g|100ml)|ανά\\s*(κιλό|λίτρο|τεμ|kg|lt)"


def unit_price_guard(text) -> Column:
    """Keep only the part before '/' of a price per unit."""
    t = _c(text)
    per_unit = t.rlike(UNIT_PRICE) | t.rlike(" τεμ\\.\\s*$")
    return F.when(per_unit, F.substring_index(t, "/", 1)).otherwise(t)


def split_price(structured, whole, fraction, text) -> Column:
    """Structured value, else whole and fraction (0 < p < 999), else the price text."""
    joined = F.coalesce(_c(whole).try_cast("int"), F.lit(0)) + F.coalesce(_c(fraction).try_cast("int"), F.lit(0)) / 100
    has_parts = _c(whole).isNotNull() & _c(fraction).isNotNull()
    return F.coalesce(
        F.nullif(_c(structured).try_cast("double"), F.lit(0.0)),
        F.when(has_parts & (joined > 0) & (joined < 999), joined),
        parse_price(text),
    )


def ingredient_cost(price, unit_text, grams) -> Column:
    """Cost of ``grams`` of a product: by its price per kilo, else as part of a 1 kg pack."""
    p, g = _c(price), _c(grams)
    per_kilo_pattern = "(?iu)([\\d,.]+)\\s*€?\\s*/\\s*κιλ"
    per_kilo = F.regexp_replace(F.regexp_extract(_c(unit_text), per_kilo_pattern, 1), ",", ".").try_cast("double")
    share = lambda unit: js_round(unit * g / 1000, 2)
    return (
        F.when(num_or_zero(p) == 0, p)
        .when(num_or_zero(g) == 0, p)
        .when(F.coalesce(_c(unit_text).rlike(per_kilo_pattern), F.lit(False)), share(per_kilo))
        .otherwise(F.least(share(p), p))
    )


def macro_kcal(protein, carbs, fat) -> Column:
    return js_round(num_or_zero(protein) * 4 + num_or_zero(carbs) * 4 + num_or_zero(fat) * 9)


def macro_ratio(protein, carbs, fat) -> tuple[Column, Column, Column]:
    """Integer percentages that sum to 100; zero or missing parts count 30/40/30."""
    p, c, f = (
        F.coalesce(falsy_to_null(x), F.lit(d)) for x, d in ((protein, 30), (carbs, 40), (fat, 30))
    )
    total = p + c + f
    pct = [js_round(x / total * 100) for x in (p, c, f)]
    drift = F.lit(100) - pct[0] - pct[1] - pct[2]
    return pct[0], pct[1] + drift, pct[2]


def daily_grams(kcal, protein_pct, carbs_pct, fat_pct) -> tuple[Column, Column, Column]:
    k = F.coalesce(falsy_to_null(kcal), F.lit(1800))
    share = lambda pct, per_gram: js_round(js_round(k * pct / 100) / per_gram)
    return share(protein_pct, 4), share(carbs_pct, 4), share(fat_pct, 9)


# Share of the day by meal slot.
SLOT_SHARES = [("breakfast", 0.25), ("lunch", 0.40), ("dinner", 0.35)]


def salt_from_sodium(sodium) -> Column:
    return F.floor(_c(sodium) * 2.5 * 10 + 0.5) / 10.0


def reconcile(stated, computed) -> Column:
    """Keep the stated total when non-zero and within max(15, 15 %) of the computed one."""
    s, c = _c(stated), _c(computed)
    tolerance = F.greatest(F.lit(15), js_round(c * 0.15))
    return F.when((num_or_zero(s) != 0) & (F.abs(s - c) <= tolerance), s).otherwise(c)


def health_score(x) -> Column:
    i = F.regexp_extract(_c(x).cast("string"), "^\\s*([+-]?\\d+)", 1).try_cast("int")
    return F.when(i.between(1, 10), i).otherwise(5)


def sale_price_rule(start, discounted) -> Column:
    """struct(price, old_price, is_on_sale) of a store that shows a start and maybe a discounted price."""
    s, d = _c(start), _c(discounted)
    return F.struct(
        F.coalesce(d, s).alias("price"), F.when(d.isNotNull(), s).alias("old_price"), d.isNotNull().alias("is_on_sale")
    )
