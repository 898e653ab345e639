"""Readers for the warehouse tables and the record shapes derived from them.

Every reader returns a lazy DataFrame over a whole parquet table, so filters and
column choices made by the caller reach the scan. Total orders are carried as an
orderable struct ``pos`` instead of a global row number: a global number would
need all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.scaling import spread

LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.lower("p_name").alias("normalized_name"),
        F.col("p_brand").alias("supermarket"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
    )


def offers(spark, sf_dir) -> DataFrame:
    """Price observations; ``pos`` is the total order of observation."""
    return offers_of(table(spark, sf_dir, "lineitem"))


def offers_of(line: DataFrame) -> DataFrame:
    return line.select(
        F.struct(*LINE_ORDER).alias("pos"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("store_id"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_discount") > 0).alias("is_on_sale"),
        F.concat(
            F.lit("-"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").cast("string"), F.lit("%")
        ).alias("discount_percent"),
        F.col("l_shipdate").alias("date_scraped"),
    )


SEARCH_TERMS = [
    (1, "red"), (2, "widget"), (3, "red widget"), (4, "ring"), (5, "zzz bolt"), (6, "gi"),
]


def search_queries(spark) -> DataFrame:
    """The query set searched for; in production a table of user queries."""
    rows = ", ".join(f"({i}, '{q}')" for i, q in SEARCH_TERMS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(qid, q)")


def recipes(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    lines = F.split("text", "\n", -1)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.substring("text", 1, 40).alias("title"),
        F.substring("text", 1, 300).alias("description"),
        F.col("text").alias("body"),
        F.col("lang").alias("category"),
        F.col("source").alias("source_api"),
        (F.col("n_chars") % 90).alias("minutes"),
        (F.col("n_chars") % 40).alias("protein"),
        F.when(F.col("quality").isNotNull(), F.col("n_chars") % 900).alias("calories"),
        (F.col("n_chars") % 60).alias("carbs"),
        (F.col("n_chars") % 25).alias("fat"),
        (F.col("doc_id") % 6 + 1).alias("servings"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT), 0)").alias(
            "created_at"
        ),
        F.filter(lines, lambda x: F.length(x) < 80).alias("ingredients"),
        F.filter(lines, lambda x: F.length(x) >= 80).alias("instructions"),
        F.array("lang", "source").alias("tags"),
    )


def users(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(""))), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("K"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("share_key"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_premium"),
        F.expr(
            "TIMESTAMP_NTZ '2024-01-16 12:00:00' + make_dt_interval(CAST(c_custkey % 30 AS INT), 0, 0, 0)"
        ).alias("trial_ends_at"),
    )


def edges(spark, sf_dir) -> DataFrame:
    """One directed half of each friendship."""
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    total = customer.agg(F.count("*").alias("n")).scalar()
    counted = customer.select(F.col("c_custkey").alias("a"), total.alias("n"))
    return counted.select("a", ((F.col("a") * 7 + 3) % F.col("n")).alias("b")).where("a <> b")


def messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        (F.col("conv_id") % 40).alias("share_key"),
        F.col("role").alias("sender"),
        F.when(F.col("turn") % 3 == 2, (F.col("conv_id") + 1) % 40).alias("target_key"),
        "text",
        F.expr(
            "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(conv_id * 1000 + turn AS INT))"
        ).alias("created_at"),
    )


def lists(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("list_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").alias("created_at"),
    )


MEAL_SLOTS = ["breakfast", "lunch", "dinner", "breakfast_alt", "lunch_alt", "dinner_alt"]


def meals(spark, sf_dir) -> DataFrame:
    slot = F.coalesce(F.get(F.lit(MEAL_SLOTS), F.col("l_linenumber") - 1), F.lit("supper"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("day"),
        slot.alias("slot"),
        F.col("l_quantity").alias("protein"),
        (F.col("l_partkey") % 60).cast("double").alias("carbs"),
        (F.col("l_suppkey") % 30).cast("double").alias("fat"),
        F.col("l_partkey").alias("part_key"),
    )


def ingredients(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        (F.col("l_orderkey") % 50).alias("plan_id"),
        F.concat(
            (F.col("l_quantity").cast("int") * 10).cast("string"), F.lit("g "), "p_name",
            F.lit(" ("), "p_type", F.lit(")"),
        ).alias("raw"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
    )


NUTRIENT_BY_LINE = [1008, 1003, 1004, 1005, 2000, 1079]


def nutrients(spark, sf_dir) -> DataFrame:
    """(food, source, nutrient id, value); ``pos`` orders the values of one food."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("food_id"),
        (F.col("l_suppkey") % 3).alias("source_rank"),
        F.coalesce(F.get(F.lit(NUTRIENT_BY_LINE), F.col("l_linenumber") - 1), F.lit(1093)).alias("nutrient_id"),
        F.col("l_quantity").alias("value"),
        F.struct(*LINE_ORDER).alias("pos"),
    )


def api_payloads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(
            F.lit('{"fullTitle":"'), "event_type", F.lit('","price":{"price":'), F.col("value").cast("string"),
            F.lit('},"ribbons":[{"text":"-'), (F.col("event_id") % 50).cast("string"),
            F.lit('%"}],"stockAvailability":{"available":'),
            F.when(F.col("event_id") % 7 == 0, "false").otherwise("true"),
            F.lit('},"totalTime":"PT1H'), (F.col("event_id") % 60).cast("string"), F.lit('M"}'),
        ).alias("payload"),
    )


def price_texts(spark, sf_dir) -> DataFrame:
    cents = F.floor(F.col("value") * 100 + 0.5)
    euros = F.floor(cents / 100).cast("bigint").cast("string")
    rest = F.lpad((cents % 100).cast("string"), 2, "0")
    kind = F.col("event_id") % 5
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == 0, F.concat(euros, F.lit(","), rest, F.lit(" €")))
        .when(kind == 1, F.concat(euros, F.lit(" "), rest))
        .when(kind == 2, cents.cast("string"))
        .when(kind == 3, F.concat(euros, F.lit("."), rest, F.lit(" € /kg")))
        .otherwise("n/a")
        .alias("price_text"),
    )


def graph(spark, sf_dir) -> DataFrame:
    """Customer-product link graph, both directions."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pairs = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .select(
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
            F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
        )
        .distinct()
    )
    return pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("src"), F.col("dst")),
                F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
            )
        ).alias("e")
    ).select("e.src", "e.dst")


def subscriptions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("e"), (F.col("event_id") % 700).cast("string")).alias("endpoint"),
        "user_id",
        (F.col("event_type") == "error").alias("failed"),
        "ts",
    )


def choices(spark, sf_dir) -> DataFrame:
    kind = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        (F.col("event_id") % 7).alias("day"),
        F.when(kind == 0, "breakfast").when(kind == 1, "lunch").otherwise("dinner").alias("meal_type"),
        F.when(F.col("value") < 245, "a").otherwise("b").alias("chosen"),
        "ts",
    )


def links(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")
    )


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )


# One listing page of a store as its pages show a product: {n} name, {e} euros, {b} brand, {sale}: only where the product is on sale.
# ``card`` has the store's own card element, ``bare`` only names and prices, so the card has to be found from them.
LISTINGS = {
    "ΑΒ Βασιλόπουλος": (
        '<div data-testid="product-block">{inner}</div>',
        '<i data-testid="product-brand">{b}</i><a data-testid="product-name">{n}</a><b data-testid="product-block-price">{e} 50</b>'
        '{sale<s data-testid="product-block-old-price">99 00</s><u data-testid="tag-promo-label">1+1 δώρο</u>}'
        '<picture><img data-src="https://img.example.com/{k}.jpg" src="data:image/gif;base64,R0"></picture>',
    ),
    "Σκλαβενίτης": (
        '<div class="product-list"><div>{inner}</div></div>',
        '<h4><a>{n}</a></h4><span class="price">{e},50 €</span>{sale<del>99,00 €</del><i class="offer-span">-20%</i>}'
        '<figure><img src="https://img.example.com/{k}.jpg"></figure>',
    ),
    "Κρητικός": (
        '<div class="x ProductListItem_productItem__a1">{inner}</div>',
        '<p class="ProductListItem_title__b2">{n} ΣΥΣΚΕΥΑΣΙΑ</p><p class="ProductListItem_finalPrice__c3">{e}.50€</p>'
        '{sale<p class="ProductListItem_beginPrice__d">99,00€</p><p class="ProductListItem_badge__e">SUPER</p>}'
        '<img class="ProductListItem_productImage__f" src="https://img.example.com/{k}.jpg">',
    ),
    "MyMarket": (
        '<article class="product--teaser">{inner}</article>',
        '<span class="line-clamp-2">{n}</span><i class="teaser-display-price-whole">{e}</i><i class="teaser-display-price-fraction">50</i>'
        '{sale<s class="diagonal-line">99,00€</s><i class="product-note-tag">-10%</i>}<picture><img src="https://img.example.com/{k}.jpg"></picture>',
    ),
    "Μασούτης": (
        '<div class="product">{inner}</div>',
        '<b class="productTitle">{n}</b>{sale<i class="pDscntPrice">{e},50€</i><i class="pStartPrice">99,00€</i>|<i class="pStartPrice">{e},50€</i>}'
        '<img srcset="https://img.example.com/{k}.jpg 2x, b.jpg">',
    ),
    "Market In": (
        '<div class="product-grid-box">{inner}</div>',
        '<p class="product-ttl">{n}</p><p class="new-price">{e},50€ / κιλό</p>{sale<p class="old-price">99,00</p><p class="disc-value">-5%</p>}'
        '<p class="product-thumb"><img src="https://img.example.com/{k}.jpg"></p>',
    ),
    "Γαλαξίας": (
        "<product-card>{inner}</product-card>",
        '<a class="text-black-i">{n}</a><span style="color: rgb(2, 88, 165)">{e},50</span>{sale<p class="bg-secondary text-primary">-7%</p>}'
        '<img src="https://galaxias.shop/api/media/{k}.jpg">',
    ),
    "Lidl": (
        '<div class="odsc-tile">{inner}</div>',
        '<p class="product-grid-box__title">{n}</p><p class="ods-price__value">{e}.50</p>'
        '{sale<p class="ods-price__strikethrough"><i class="ods-price__value">99.00</i></p><p class="ods-price__box-content-text-el">-30%</p>}'
        '<p class="ods-badge__label">1.1. - 7.1.</p>',
    ),
}
#: What a product stands in where the page has no card element: a list item, a plain box three above its name, a grid item.
BARE = ["<ul><li>{inner}</li></ul>", "<section><div><p>{inner}</p></div></section>", '<div class="s-grid__item"><div>{inner}</div></div>']


def store_pages(spark, sf_dir) -> DataFrame:
    """(page_id, store, html): a listing page for each part at one of the eight stores; every second round of pages has no card element."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand"))
    key, stores = F.col("p_partkey"), list(LISTINGS)
    sale = key % 3 == 0

    def filled(text: str):
        """Column of a template's text."""
        values = {"n": F.col("p_name"), "e": F.col("p_size").cast("string"), "b": F.col("p_brand"), "k": key.cast("string")}
        out, rest = [], text
        while "{" in rest:
            plain, rest = rest.split("{", 1)
            out.append(F.lit(plain))
            if rest.startswith("sale"):
                depth, end = 1, 4
                while depth:
                    depth += {"{": 1, "}": -1}.get(rest[end], 0)
                    end += 1
                shown, _, other = rest[4 : end - 1].partition("|")
                out.append(F.when(sale, filled(shown)).otherwise(filled(other)))
                rest = rest[end:]
            else:
                name, rest = rest.split("}", 1)
                out.append(values[name])
        return F.concat(*out, F.lit(rest))

    page = F.lit(None).cast("string")
    for k, (card, inner) in enumerate(LISTINGS.values()):
        bare = F.get(F.array(*(filled(b.replace("{inner}", inner)) for b in BARE)), F.floor(key / 16).cast("int") % 3)
        # the second card has no price that counts
        body = F.concat(filled(card.replace("{inner}", inner)), filled(card.replace("{inner}", "<h3>no price</h3>")))
        page = F.when(key % 8 == k, F.when(F.floor(key / 8) % 2 == 0, body).otherwise(bare)).otherwise(page)
    store = F.get(F.array(*map(F.lit, stores)), (key % 8).cast("int"))
    html = F.concat(F.lit("<!DOCTYPE html><html><body><nav><a href='/'>Home</a></nav><main>"), page, F.lit("</main></body></html>"))
    return part.select(key.alias("page_id"), store.alias("store"), html.alias("html"))
