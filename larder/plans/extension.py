"""Parsers, selectors and predicates that callers supply."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators.scaling import top_k
from larder.plans.registry import query
from larder.sources import dom, html, tables


def listed_page(root: dom.Node) -> dict:
    """A caller's own parser: heading, list items as ingredients, paragraphs as steps."""
    head = root.first("h1")
    return {
        "title": head.text() if head is not None else "",
        "ingredients": [n.text() for n in root.all("nav li")],
        "instructions": [n.raw_text() for n in root.all("article p")],
    }


CUSTOM = {"en": ("English pages", 20, listed_page), "fr": ("French pages", 12, listed_page)}


@query("site_registry", """
    WITH p AS (SELECT page_id, html, coalesce(nullif(regexp_extract(url, '/(en|fr|es|de)/', 1), ''), 'none') AS site FROM pages),
    t AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rn FROM p)
    SELECT page_id, site, site IN ('en', 'fr') AS known, CASE site WHEN 'en' THEN 'English pages' WHEN 'fr' THEN 'French pages' END AS label,
      CASE WHEN site IN ('en', 'fr') THEN len(regexp_extract_all(html, '<li>')) END AS n_items FROM t
    WHERE rn <= CASE site WHEN 'en' THEN 20 WHEN 'fr' THEN 12 ELSE 1000000000 END""")
def site_registry(spark, d):
    """Each site's parser over its pages, most rows per site applied, unknown sites reported."""
    site = F.coalesce(F.nullif(F.regexp_extract("url", "/(en|fr|es|de)/", 1), F.lit("")), F.lit("none"))
    pages = tables.table(spark, d, "pages").select("page_id", "html", site.alias("site"))
    sites = html.site_rows(spark, CUSTOM)
    listed = F.col("site").isin(*CUSTOM)
    most = max(m for _, m, _ in CUSTOM.values())
    # page ids are limited before their pages are read and parsed
    picked = top_k(pages.where(listed).select("page_id", "site"), ["site"], ["page_id"], most, rank="rn")
    picked = picked.join(F.broadcast(sites), "site").where("rn <= max_rows").select("page_id")
    wanted = pages.where(listed).join(picked, "page_id", "left_semi").unionByName(pages.where(~listed))
    parsed = html.parse_recipe_pages(wanted, CUSTOM)
    return parsed.join(F.broadcast(sites.select("site", "label")), "site", "left").select(
        "page_id", "site", "known", "label", F.when(F.col("known"), F.size("ingredients").cast("bigint")).alias("n_items"))


def tag_test(tests: list[dict]) -> str:
    """SQL condition on a start tag's columns (name, classes, attributes) for one step of a selector."""
    out = []
    for t in tests:
        if t["no"] is not None:
            out += [f"NOT ({tag_test(steps[-1][1])})" for steps in dom.compile_selector(t["no"])]
        elif t["attr"]:
            value = f"""regexp_extract(tag, '\\s{t["attr"]}="([^"]*)"', 1)"""
            test = {None: "true", "=": f"{value} = '{t['val']}'", "*=": f"contains({value}, '{t['val']}')", "^=": f"starts_with({value}, '{t['val']}')"}[t["op"]]
            out.append(f"""(contains(tag, ' {t["attr"]}=') AND {test})""")
        elif t["cls"]:
            out.append(f"list_contains(classes, '{t['cls']}')")
        else:
            out.append(f"name = '{t['tag']}'")
    return " AND ".join(out)


def registry_sql(stores: dict) -> str:
    """Counts of every selector over the start tags of ``pages``.

    Tags stand flat here, so a selector of several steps counts a tag of its last step on a page that also has a tag for
    each earlier step; no stored page has such a last step.
    """
    counts = []
    for store, fields in stores.items():
        for field, selector in fields.items():
            groups = []
            for steps in dom.compile_selector(selector):
                earlier = "".join(f" AND page_id IN (SELECT page_id FROM tags WHERE {tag_test(tests)})" for _, tests in steps[:-1])
                groups.append(f"({tag_test(steps[-1][1])}{earlier})")
            counts.append(f"SELECT '{store}' AS store, '{field}' AS field, count(*) AS matches, count(DISTINCT page_id) AS pages FROM tags WHERE {' OR '.join(groups)}")
    return r"""
    WITH shown AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<(?:script|style)[^>]*>).*?</(?:script|style)>', '\1', 'gs') AS h FROM pages),
    found AS (SELECT page_id, unnest(regexp_extract_all(h, '<[a-zA-Z][^>]*>')) AS tag FROM shown),
    tags AS MATERIALIZED (SELECT page_id, tag, regexp_extract(tag, '^<([\w-]+)', 1) AS name, string_split(regexp_extract(tag, ' class="([^"]*)"', 1), ' ') AS classes FROM found)
    """ + " UNION ALL ".join(counts)


#: Selectors looked for on the stored pages: those of the stores, what cards fall back to, and what every stored page has.
KNOWN = html.STORE_SELECTORS | {
    "any store": {"name": html.ANY_NAME, "price": html.ANY_PRICE, "image": "img", "wrapper": html.WRAPPER},
    "stored pages": {"card": "article, .ad", "name": "h1", "links": "a[href]", "inner": 'a[href^="/th"], b', "kept": "div:not(.card)"},
}


@query("selector_registry", registry_sql(KNOWN))
def selector_registry(spark, d):
    """Elements that each selector of each store matches on the stored pages, each page walked once for all of them."""
    return html.selector_matches(tables.table(spark, d, "pages"), KNOWN)


@query("selector_registry_listings", """
    WITH p AS (SELECT p_partkey % 8 AS s, p_partkey // 8 % 2 = 0 AS card, p_partkey % 3 = 0 AS sale FROM part),
    n AS (SELECT s, count(*) FILTER (WHERE card) AS cards, count(*) AS names, count(*) FILTER (WHERE sale) AS sales, count(*) FILTER (WHERE NOT sale) AS plain FROM p GROUP BY s),
    f(s, store, field, kind, times) AS (VALUES
      (0, 'ΑΒ Βασιλόπουλος', 'card', 'cards', 2), (0, 'ΑΒ Βασιλόπουλος', 'name', 'names', 1), (0, 'ΑΒ Βασιλόπουλος', 'brand', 'names', 1),
      (0, 'ΑΒ Βασιλόπουλος', 'price', 'names', 1), (0, 'ΑΒ Βασιλόπουλος', 'old_price', 'sales', 1), (0, 'ΑΒ Βασιλόπουλος', 'promo', 'sales', 1),
      (2, 'Κρητικός', 'card', 'cards', 2), (2, 'Κρητικός', 'name', 'names', 1), (2, 'Κρητικός', 'price', 'names', 1),
      (2, 'Κρητικός', 'old_price', 'sales', 1), (2, 'Κρητικός', 'promo', 'sales', 1), (2, 'Κρητικός', 'image', 'names', 1),
      (3, 'MyMarket', 'card', 'cards', 2), (3, 'MyMarket', 'name', 'names', 1), (3, 'MyMarket', 'whole', 'names', 1), (3, 'MyMarket', 'fraction', 'names', 1),
      (3, 'MyMarket', 'old_price', 'sales', 1), (4, 'Μασούτης', 'name', 'names', 1), (4, 'Μασούτης', 'price', 'names', 1), (4, 'Μασούτης', 'discounted', 'sales', 1),
      (5, 'Market In', 'name', 'names', 1), (5, 'Market In', 'price', 'names', 1), (5, 'Market In', 'old_price', 'sales', 1), (5, 'Market In', 'promo', 'sales', 1),
      (6, 'Γαλαξίας', 'card', 'cards', 2), (6, 'Γαλαξίας', 'name', 'names', 1), (6, 'Γαλαξίας', 'promo', 'sales', 1),
      (7, 'Lidl', 'name', 'names', 1), (7, 'Lidl', 'old_price', 'sales', 1), (7, 'Lidl', 'promo', 'sales', 1), (7, 'Lidl', 'validity', 'names', 1))
    SELECT store, field, CAST(times * x AS BIGINT) AS matches, x AS pages FROM (
      SELECT f.*, CASE kind WHEN 'cards' THEN cards WHEN 'names' THEN names ELSE sales END AS x FROM f JOIN n USING (s)) t""")
def selector_registry_listings(spark, d):
    """The same over listing pages of all stores, for the fields that one store alone shows."""
    found = html.selector_matches(tables.store_pages(spark, d))
    told = [("ΑΒ Βασιλόπουλος", "card name brand price old_price promo"), ("Κρητικός", "card name price old_price promo image"),
            ("MyMarket", "card name whole fraction old_price"), ("Μασούτης", "name price discounted"), ("Market In", "name price old_price promo"),
            ("Γαλαξίας", "card name promo"), ("Lidl", "name old_price promo validity")]
    wanted = F.lit(False)
    for store, fields in told:
        wanted |= (F.col("store") == store) & F.col("field").isin(*fields.split())
    return found.where(wanted)


@query("site_contracts", """
    WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '/(en|fr|es|de)/', 1), ''), 'none') AS site, len(regexp_extract_all(html, '<li>')) AS items,
      len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages)
    SELECT 'en' AS site, 'items' AS "check", count(*) FILTER (WHERE items >= 3) AS passed, count(*) FILTER (WHERE items < 3) AS failed FROM p WHERE site = 'en' UNION ALL
    SELECT 'en', 'images', 0, count(*) FROM p WHERE site = 'en' UNION ALL
    SELECT 'fr', 'paragraphs', count(*) FILTER (WHERE paragraphs >= 5), count(*) FILTER (WHERE paragraphs < 5) FROM p WHERE site = 'fr' UNION ALL
    SELECT 'xx', 'images', 0, 0""")
def site_contracts(spark, d):
    """Checks of each site over its own stored pages; a site without pages has zeros."""
    site = F.coalesce(F.nullif(F.regexp_extract("url", "/(en|fr|es|de)/", 1), F.lit("")), F.lit("none"))
    pages = tables.table(spark, d, "pages").select("html", site.alias("site"))
    checks = {"en": [("items", "nav li", 3), ("images", "img", 3)], "fr": [("paragraphs", "article p", 5)], "xx": [("images", "img", 3)]}
    return html.site_contracts(pages, checks)


@query("link_filter_udf", """
    SELECT page_id, href FROM v_links WHERE NOT contains(href, '/category/') AND length(href) > 3 AND NOT ends_with(href, '/the')""", ("v_links",))
def link_filter(spark, d):
    """A caller's predicate as a plain column condition, evaluated where the links are."""
    h = F.col("href")
    keep = ~h.contains("/category/") & (F.length(h) > 3) & ~h.endswith("/the")
    return tables.links(spark, d).where(keep)
