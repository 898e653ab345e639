"""Reusable row filters; all are plain predicates that reach the scan where they can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import js_trim

ALL = "Όλα"  # fixed value: the choice that means no store filter
EMAIL = "^[^\\s@]+@[^\\s@]+\\.[^\\s@]{2,}$"
BARCODE = "^\\d{6,14}$"


def where_equal(df: DataFrame, **wanted) -> DataFrame:
    """Equality on each given column; an absent, empty or 'all' value is no filter."""
    for column, value in wanted.items():
        if value not in (None, "", ALL):
            df = df.where(F.col(column) == value)
    return df


def contains_ci(columns, text: str) -> Column:
    """Any of the columns holds the text, ignoring case, taken literally."""
    needle = text.lower()
    return reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(needle) for c in columns])


def same_key(a, b) -> Column:
    clean = lambda c: F.upper(js_trim(c))
    return clean(a) == clean(b)


def all_terms(column, terms) -> Column:
    return reduce(lambda a, b: a & b, [F.col(column).contains(t) for t in terms])


def is_email(column) -> Column:
    return F.lower(js_trim(column)).rlike(EMAIL)


def registration_outcome(name, password, email, taken: Column) -> Column:
    """First rule a registration breaks, else 'ok'."""
    n, p = js_trim(name), F.col(password)
    missing = (F.coalesce(n, F.lit("")) == "") | (F.coalesce(js_trim(email), F.lit("")) == "") | (F.coalesce(p, F.lit("")) == "")
    return (
        F.when(missing, "missing")
        .when(~F.length(n).between(3, 30), "name")
        .when(F.length(p) < 6, "password")
        .when(~is_email(email), "email")
        .when(taken, "taken")
        .otherwise("ok")
    )


def target_store(store, store_id, target: str | None) -> Column:
    """All stores, all but the first-party one ('rest'), or one by id or part of its name."""
    if not target:
        return F.lit(True)
    t = target.lower()
    if t == "rest":
        return F.col(store_id) != "ab"
    return (F.col(store_id) == t) | F.lower(F.col(store)).contains(t)


def request_label(ms, status) -> Column:
    """Label of a slow (500 ms or more) or failed (400 or more) request; null for the others."""
    return F.when(F.col(status) >= 400, "failed").when(F.col(ms) >= 500, "slow")
