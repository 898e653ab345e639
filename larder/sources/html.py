"""Stored pages to records: page fields, product cards, recipe pages, contracts.

Pages are parsed by Arrow batches in mapInPandas; the parser only lifts raw texts
and attributes out of a page. Prices, flags, names and lines are then worked out
by column expressions.
"""

from __future__ import annotations


import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.numbers import parse_price, split_price, unit_price_guard
from larder.functions.structures import brand_name, image_choice, promo_flags
from larder.functions.text import norm_text, strip_packaging_words
from larder.sources import dom

PAGE_SCHEMA = "title string, h1 string, image string, lines array<string>, jsonld array<string>"


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Title, first heading, og image, visible lines and JSON-LD blocks of each page."""
    key_type = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for ident, text in zip(batch[key], batch[html]):
                root = dom.parse(text)
                at = lambda sel: (lambda n: n.text() if n is not None else "")(root.first(sel))
                og = root.first('meta[property="og:image"]')
                body = root.first("article") or root
                ld = [n.raw_text() for n in root.all('script[type="application/ld+json"]')]
                lines = [s.strip() for s in body.text().split("\n") if s.strip()]
                rows.append((ident, at("title"), at("h1"), og.attrs.get("content", "") if og else "", lines, ld))
            yield pd.DataFrame(rows, columns=[key, "title", "h1", "image", "lines", "jsonld"])

    return pages.select(key, html).mapInPandas(run, f"{key} {key_type}, {PAGE_SCHEMA}")


# Selectors of each store's product cards.
STORE_SELECTORS = {
    "ΑΒ Βασιλόπουλος": {
        "card": '[data-testid="product-block"]',
        "name": '[data-testid="product-name"], [data-testid="product-block-name-link"]',
        "brand": '[data-testid="product-brand"]',
        "price": '[data-testid="product-block-price"]',
        "old_price": '[data-testid="product-block-old-price"]',
        "promo": '[data-testid="tag-promo-label"]',
        "image": 'img[data-testid="product-block-image"], img[data-testid="product-image"], picture img, img[src*="static.ab.gr"]',
    },
    "Σκλαβενίτης": {
        "card": ".product, li.item, .product-list > div, .product-card",
        "name": "h4 a, h4, .product__title a, .product__name a",
        "price": ".price, [data-price]",
        "old_price": "del, .price.old",
        "promo": ".offer-span, .text-minus",
        "image": '.product__figure img, figure img, img[src*="static.sklavenitis"]',
    },
    "Κρητικός": {
        "card": '[class*="ProductListItem_productItem"]',
        "name": '[class*="ProductListItem_title__"]',
        "price": '[class*="ProductListItem_finalPrice__"]',
        "old_price": '[class*="ProductListItem_beginPrice"]',
        "promo": '[class*="ProductListItem_badge"]',
        "image": 'img[class*="ProductListItem_productImage"], [class*="ProductListItem"] img',
    },
    "MyMarket": {
        "card": "article.product--teaser",
        "name": ".line-clamp-2",
        "data": "a[data-google-analytics-item-param]",
        "whole": ".teaser-display-price-whole",
        "fraction": ".teaser-display-price-fraction",
        "price": ".teaser-display-price",
        "old_price": ".diagonal-line",
        "promo": '.product-note-tag, [class*="badge-promo"], [class*="offer-label"]',
        "image": '.teaser-image-container img, picture img, img[loading="lazy"]',
    },
    "Μασούτης": {
        "card": ".product",
        "name": ".productTitle",
        "price": ".pStartPrice",
        "discounted": ".pDscntPrice",
        "old_price": ".pStartPrice",
        "promo": ".pDscntPercent",
        "image": ".productImage, .catImgCont img, img",
    },
    "Market In": {
        "card": ".product-grid-box, .product",
        "name": ".product-ttl",
        "price": ".new-price",
        "old_price": ".old-price",
        "promo": ".disc-value",
        "image": '.product-thumb img, img[src*="market-in"]',
    },
    "Γαλαξίας": {
        "card": "product-card",
        "name": "a.text-black-i",
        "price": 'span[style*="rgb(2, 88, 165)"], .current-price, .price-label, [class*="price"]:not([class*="old"]):not([class*="base"])',
        "promo": ".bg-secondary.text-primary",
        "image": 'img[src*="galaxias.shop/api/media"], img[src*="galaxias"]',
    },
    "Lidl": {
        "card": ".odsc-tile, .product-grid-box",
        "name": ".product-grid-box__title",
        "price": ".ods-price__value",
        "old_price": ".ods-price__strikethrough .ods-price__value",
        "promo": ".ods-price__box-content-text-el",
        "validity": ".ods-badge__label",
    },
}
ANY_NAME = 'h2, h3, h4, [class*="title"], [data-qa-label*="title"]'
ANY_PRICE = '[class*="price"]'
#: What a name or price stands in where a page shows no card of its store.
WRAPPER = (
    'article, li, .product, [data-testid^="product"], .relative, div[data-mkey], div.item, .product-card, '
    ".s-grid__item, .product-grid-box"
)
LAZY = ["data-src", "data-lazy-src", "data-original", "data-lazy", "srcset", "data-srcset"]
CARD_FIELDS = ["name", "title", "brand", "data", "whole", "fraction", "price", "discounted", "old_price", "validity"]
CARD_SCHEMA = (
    "pos int, " + ", ".join(f"{f}_text string" for f in CARD_FIELDS)
    + ", promos array<string>, src string, " + ", ".join(f"{a.replace('-', '_')} string" for a in LAZY)
)


def selector_registry(spark, stores: dict | None = None) -> DataFrame:
    """The selector table as rows, for joins and reports."""
    rows = [(store, field, sel) for store, table in (stores or STORE_SELECTORS).items() for field, sel in table.items()]
    return spark.createDataFrame(rows, "store string, field string, selector string")


def selector_matches(pages: DataFrame, stores: dict | None = None) -> DataFrame:
    """(store, field, matches, pages): elements that each selector of each store matches, and the pages that show any.

    Every page is walked once for all selectors. A batch sends one row for each selector that matched in it.
    """
    stores = stores or STORE_SELECTORS

    def run(batches):
        every = dom.Selectors({(store, field): sel for store, table in stores.items() for field, sel in table.items()})
        for batch in batches:
            many: dict = {}
            for text in batch["html"]:
                for key, places in every.walk(dom.parse(text)).found.items():
                    matches, shown = many.get(key, (0, 0))
                    many[key] = matches + len(places), shown + 1
            yield pd.DataFrame([(*key, *n) for key, n in many.items()], columns=["store", "field", "matches", "pages"])

    found = pages.select("html").mapInPandas(run, "store string, field string, matches long, pages long")
    sums = found.groupBy("store", "field").agg(F.sum("matches").alias("matches"), F.sum("pages").alias("pages"))
    known = selector_registry(pages.sparkSession, stores).select("store", "field")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return known.join(sums, ["store", "field"], "left").select("store", "field", zero("matches"), zero("pages"))


def _store_selectors(store: str) -> dom.Selectors:
    return dom.Selectors(STORE_SELECTORS[store] | {"any_name": ANY_NAME, "any_price": ANY_PRICE, "any_image": "img", "wrapper": WRAPPER})


def _card_places(page: dom.Page) -> list[int]:
    """The store's cards; where a page has none, what its names (else its prices) stand in."""
    return page.all("card") or page.lifted("name" if page.all("name") else "price", "wrapper")


def _card_row(page: dom.Page, card: int, store: str):
    def text(key):
        node = page.first(key, card)
        return node.text() if node is not None else None

    values = {f: text(f) for f in CARD_FIELDS if f not in ("title", "data")}
    data = page.first("data", card)
    values["data"] = data.attrs.get("data-google-analytics-item-param") if data is not None else None
    values["title"] = text("any_name")
    if values["price"] is None and store != "MyMarket":
        values["price"] = text("any_price")
    image = page.first("image", card) or page.first("any_image", card)
    attr = lambda a: image.attrs.get(a) if image is not None else None
    promos = [page.nodes[k].text() for k in page.all("promo", card)]
    return [values[f] for f in CARD_FIELDS] + [promos, attr("src")] + [attr(a) for a in LAZY]


def raw_cards(pages: DataFrame, key: str = "page_id", store: str = "store") -> DataFrame:
    """Texts and attributes of every card of pages that name their store; pages of other stores have none."""
    types = [pages.schema[c].dataType.simpleString() for c in (key, store)]
    columns = [key, store, "pos"] + [f"{f}_text" for f in CARD_FIELDS] + ["promos", "src"] + [a.replace("-", "_") for a in LAZY]

    def run(batches):
        compiled = {}
        for batch in batches:
            rows = []
            for ident, name, text in zip(batch[key], batch[store], batch["html"]):
                if name in STORE_SELECTORS:
                    page = compiled.setdefault(name, _store_selectors(name)).walk(dom.parse(text))
                    rows += [[ident, name, pos] + _card_row(page, card, name) for pos, card in enumerate(_card_places(page))]
            yield pd.DataFrame(rows, columns=columns)

    return pages.select(key, store, "html").mapInPandas(run, f"{key} {types[0]}, {store} {types[1]}, {CARD_SCHEMA}")


def extract_cards(pages: DataFrame, store: str | None = None, key: str = "page_id", store_col: str = "store") -> DataFrame:
    """Product records of listing pages, of one store or of the store that each page names.

    Rows without a name or a positive price are dropped.
    """
    if store is not None:
        pages = pages.select(key, "html", F.lit(store).alias(store_col))
    cards = raw_cards(pages, key, store_col)
    of = lambda name: F.col(store_col) == name
    data_name = F.get_json_object("data_text", "$.name")
    data_price = F.get_json_object("data_text", "$.price")
    shown = F.coalesce(F.nullif("name_text", F.lit("")), F.col("title_text"))
    name = strip_packaging_words(brand_name(data_name, "brand_text", "name_text", shown))
    listed = F.coalesce(
        F.when(F.col("discounted_text").isNotNull(), parse_price("discounted_text")),
        split_price(data_price, "whole_text", "fraction_text", unit_price_guard("price_text")),
    )
    old = parse_price("old_price_text")
    # at one store the start price is an old price only beside a discounted one
    old = F.when(~of("Μασούτης") | F.col("discounted_text").isNotNull(), old)
    flags = promo_flags("promos")
    lazy = [a.replace("-", "_") for a in LAZY[:4]]
    cut = F.when(of("Lidl"), F.nullif(F.trim(F.get("promos", 0)), F.lit("")))
    return (
        cards.select(
            key, "pos", name.alias("name"), norm_text(name).alias("normalized_name"),
            F.col(store_col).alias("supermarket"), listed.alias("price"), old.alias("old_price"),
            (flags["is_on_sale"] | F.col("discounted_text").isNotNull() | cut.isNotNull()).alias("is_on_sale"),
            flags["is_1plus1"].alias("is_1plus1"),
            image_choice("src", *lazy, srcset="srcset", data_srcset="data_srcset").alias("image_url"),
            F.col("validity_text").alias("validity_date"), cut.alias("discount_percent"),
        )
        .where((F.col("name") != "") & (F.col("price") > 0))
    )


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, pos, href) of every link of every page, taken from its tags."""
    key_type = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(ident, pos, href) for ident, text in zip(batch[key], batch["html"]) for pos, href in enumerate(dom.links(text))]
            yield pd.DataFrame(rows, columns=[key, "pos", "href"])

    return pages.select(key, "html").mapInPandas(run, f"{key} {key_type}, pos int, href string")


# Least number of elements each site's listing page must show, by check.
SITE_CONTRACTS = {
    "Lidl GR": [
        ("Product cards present", 'article, .offer-item, .product-item, [class*="product"]', 3),
        ("Images loading", "img", 3),
    ],
    "AB Βασιλόπουλος": [
        ("Product cards present", '[class*="product"], .product-card, article', 3),
        ("Images loading", "img[src]", 3),
    ],
    "Σκλαβενίτης": [
        ("Product cards present", '[class*="product"], .product-tile, article', 3),
        ("Images loading", "img", 3),
    ],
    "My Market": [("Product cards present", '[class*="product"], .item, article', 3)],
}


def contract_counts(pages: DataFrame, contracts, key: str = "page_id") -> DataFrame:
    """(page, check, expected, got): elements each selector matches on each page, counted in one walk."""
    key_type = pages.schema[key].dataType.simpleString()
    checks = list(contracts)

    def run(batches):
        every = dom.Selectors({k: sel for k, (_, sel, _) in enumerate(checks)})
        for batch in batches:
            rows = []
            for ident, text in zip(batch[key], batch["html"]):
                page = every.walk(dom.parse(text))
                rows += [(ident, label, least, len(page.all(k))) for k, (label, _, least) in enumerate(checks)]
            yield pd.DataFrame(rows, columns=[key, "check", "expected", "got"])

    return pages.select(key, "html").mapInPandas(run, f"{key} {key_type}, check string, expected int, got int")


def site_contracts(pages: DataFrame, contracts: dict | None = None, site: str = "site") -> DataFrame:
    """(site, check, passed, failed): pages of each site that show enough elements for its checks, and pages that do not.

    A page is walked once for its own site's checks; a site without pages has zeros, pages of other sites count nowhere.
    """
    contracts = contracts or SITE_CONTRACTS

    def run(batches):
        every = {name: dom.Selectors({k: sel for k, (_, sel, _) in enumerate(checks)}) for name, checks in contracts.items()}
        for batch in batches:
            many: dict = {}
            # texts are taken out of the batch one at a time, so no second copy of its pages is held
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name not in every:
                    continue
                page = every[name].walk(dom.parse(text.as_py()))
                for k, (label, _, least) in enumerate(contracts[name]):
                    passed, failed = many.get((name, label), (0, 0))
                    good = len(page.all(k)) >= least
                    many[name, label] = passed + good, failed + (not good)
            names = ["site", "check", "passed", "failed"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, *n))) for key, n in many.items()], pa.schema(zip(names, kinds)))

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
    found = pages.select(site, "html").mapInArrow(run, "site string, check string, passed long, failed long")
    sums = found.groupBy("site", "check").agg(F.sum("passed").alias("passed"), F.sum("failed").alias("failed"))
    known = pages.sparkSession.createDataFrame([(name, label) for name, checks in contracts.items() for label, _, _ in checks], "site string, check string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return known.join(sums, ["site", "check"], "left").select("site", "check", zero("passed"), zero("failed"))


# --- recipe sites -----------------------------------------------------------

RECORD_SCHEMA = """title string, description string, image string, servings_text string, time_raw string,
    minutes_text string, ingredients array<string>, instructions array<string>, facts array<string>,
    content string, jsonld array<string>"""


def _text(root, selector):
    node = root.first(selector)
    return node.text() if node is not None else ""


def _og(root):
    node = root.first('meta[property="og:image"], meta[name="twitter:image"]')
    return node.attrs.get("content", "") if node is not None else ""


def marked_page(root) -> dict:
    """Site with its own classes for ingredients, nutrition facts, times and yield."""
    content = _text(root, ".recipe-content")
    return {
        "title": _text(root, "h1"), "image": _og(root),
        "ingredients": [" ".join(n.text().split()) for n in root.all(".recipe-ingredient")],
        "instructions": [s.strip() for s in content.split("\n") if len(s.strip()) > 20],
        "facts": [n.text() for n in root.all(".nutri-fact")],
        "minutes_text": " ".join(n.text() for n in root.all('[class*="recipe-time"]')),
        "servings_text": _text(root, '[class*="recipe-yield"], [class*="portion"]'), "content": content,
    }


def article_page(root) -> dict:
    """Blog post whose text holds the sections; facts come from table rows."""
    content = _text(root, ".e-content, .entry-content, .post-content")
    return {
        "title": _text(root, "h1"), "image": _og(root), "content": content,
        "facts": [n.text() for n in root.all("table tr")],
        "description": content.split("\n\n")[0].strip(),
    }


def jsonld_page(root) -> dict:
    """Page with structured data; the record is read from it by column expressions."""
    flat = _text(root, '[class*="nutrition"]')
    return {
        "title": _text(root, "h1"), "image": _og(root), "facts": [flat] if flat else [],
        "jsonld": [n.raw_text() for n in root.all('script[type="application/ld+json"]')],
    }


def generic_page(root) -> dict:
    """Any other page: title without the site name, text blocks split by section headers."""
    title = _text(root, ".entry-title, .post-title, h1.elementor-heading-title") or _text(root, "title")
    blocks = [n.text() for n in root.all(".elementor-widget-text-editor .elementor-widget-container")]
    content = "\n\n".join(b for b in blocks if len(b) > 20) or _text(root, "article")
    return {
        "title": title, "image": _og(root), "content": content,
        "jsonld": [n.raw_text() for n in root.all('script[type="application/ld+json"]')],
    }


# Site registry: label, most recipes taken, page parser. Callers may add their own.
SITES = {
    "akis": ("Άκης Πετρετζίκης", 60, jsonld_page),
    "panos": ("Πάνος Ιωαννίδης", 40, marked_page),
    "gymbeam": ("GymBeam", 40, article_page),
    "nutriroots": ("NutriRoots", 20, generic_page),
}


def parse_recipe_pages(pages: DataFrame, sites: dict | None = None, key: str = "page_id") -> DataFrame:
    """Raw recipe records of pages that carry a ``site`` column; unknown sites are reported.

    Output keeps every page once, with ``known`` false where the site is not registered.
    """
    registry = dict(sites or SITES)
    key_type = pages.schema[key].dataType.simpleString()
    columns = [f.split()[0] for f in RECORD_SCHEMA.split(",")]

    def run(batches):
        for batch in batches:
            rows = []
            for ident, site, text in zip(batch[key], batch["site"], batch["html"]):
                entry = registry.get(site)
                record = entry[2](dom.parse(text)) if entry else {}
                rows.append([ident, site, entry is not None] + [record.get(c) for c in columns])
            yield pd.DataFrame(rows, columns=[key, "site", "known"] + columns)

    return pages.select(key, "site", "html").mapInPandas(
        run, f"{key} {key_type}, site string, known boolean, {RECORD_SCHEMA}"
    )


def site_rows(spark, sites: dict | None = None) -> DataFrame:
    rows = [(key, label, most) for key, (label, most, _) in (sites or SITES).items()]
    return spark.createDataFrame(rows, "site string, label string, max_rows int")
