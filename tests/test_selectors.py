"""One walk for many selectors against a walk for each; cards of pages without card elements; links of any quoting."""

import random

import pytest

from larder.sources import dom, html

TAGS = ["div", "p", "li", "a", "article", "img", "span", "h4"]
CLASSES = ["product", "price", "old-price", "item", "card", "product-list", "x"]
SELECTORS = [
    "div", ".product", "div.item", ".product-list > div", "h4 a, h4", "li .price", "div div .x", "div > div > .x", "article p a", '[class*="price"]:not([class*="old"])',
    "a[href]", '[data-k="1"]', 'img[src*="ab"]', '[data-k^="1"] .x', ".product.item", "span:not(.x)", ":not(div)", "li > a, li a", ".card .card", "div, .product", "article, li, .product > p",
]


def some_html(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 3)):
        tag = rng.choice(TAGS)
        attrs = ""
        if rng.random() < 0.7:
            attrs += f' class="{" ".join(rng.sample(CLASSES, rng.randint(0, 3)))}"'
        if rng.random() < 0.3:
            attrs += rng.choice([' data-k="1"', ' data-k="12"', ' href="/a"', ' src="xaby"', " data-k"])
        inner = some_html(rng, depth + 1) if depth < 5 and rng.random() < 0.8 else "t"
        out.append(f"<{tag}{attrs}>" + ("" if tag == "img" else inner + rng.choice([f"</{tag}>", f"</{tag}>", ""])))
    return "".join(out)


def test_one_walk_equals_a_walk_for_each_selector():
    rng = random.Random(1)
    every = dom.Selectors(dict(enumerate(SELECTORS)))
    for _ in range(120):
        root = dom.parse(some_html(rng))
        page = every.walk(root)
        assert page.nodes == list(root.walk())
        for k, selector in enumerate(SELECTORS):
            assert [page.nodes[i] for i in page.all(k)] == root.all(selector), selector
        for place in range(0, len(page.nodes), 3):
            node = page.nodes[place]
            for k, selector in enumerate(SELECTORS):
                assert [page.nodes[i] for i in page.all(k, place)] == node.all(selector), selector
                assert page.first(k, place) is node.first(selector)


def test_registry_selectors_equal_a_walk_for_each(spark):
    rng = random.Random(5)
    names = ["product", "price", "new-price", "ProductListItem_title__x", "ods-price__strikethrough", "ods-price__value", "product-thumb", "product-card", "line-clamp-2"]
    texts = [some_html(rng).replace("card", rng.choice(names)).replace('"x"', f'"{rng.choice(names)}"') for _ in range(60)] + [None, "", "<"]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id int, html string").repartition(4)
    want = {}
    for store, fields in html.STORE_SELECTORS.items():
        for field, selector in fields.items():
            counts = [len(dom.parse(t).all(selector)) for t in texts]
            want[store, field] = sum(counts), sum(c > 0 for c in counts)
    got = {(r.store, r.field): (r.matches, r.pages) for r in html.selector_matches(pages).collect()}
    assert got == want and any(m for m, _ in want.values())
    empty = html.selector_matches(pages.where("false")).collect()
    assert len(empty) == len(want) and not any(r.matches for r in empty)


def cards(spark, body, store):
    return html.extract_cards(spark.createDataFrame([(1, store, body)], "page_id int, store string, html string")).orderBy("pos").collect()


def test_without_cards_names_are_lifted_to_their_wrapper_once(spark):
    body = '<ul><li><b class="product-ttl">Γάλα</b><b class="product-ttl">twice</b><i class="new-price">1,50</i></li><li><p><b class="product-ttl">Τυρί</b></p><i class="new-price">2,50</i></li></ul>'
    assert [(r.pos, r.name, r.price) for r in cards(spark, body, "Market In")] == [(0, "Γάλα", 1.5), (1, "Τυρί", 2.5)]


def test_without_names_prices_are_lifted(spark):
    body = '<div class="relative"><h3>Ψωμί</h3><i class="new-price">0,90</i></div><div class="relative"><h3>no price</h3></div>'
    assert [(r.name, r.price) for r in cards(spark, body, "Market In")] == [("Ψωμί", 0.9)]


def test_without_wrapper_the_node_three_above_counts(spark):
    body = '<section><div><p><b class="product-ttl">Ρύζι</b></p></div><i class="new-price">3,10</i></section>'
    assert [(r.name, r.price) for r in cards(spark, body, "Market In")] == [("Ρύζι", 3.1)]
    assert cards(spark, '<p><b class="product-ttl">Ρύζι</b><i class="new-price">3,10</i></p>', "Market In") == []  # nothing three above


def test_cards_win_over_names_outside(spark):
    body = '<li><b class="product-ttl">outside</b><i class="new-price">9,00</i></li><div class="product"><b class="product-ttl">Γάλα</b><i class="new-price">1,50</i></div>'
    assert [(r.name, r.price) for r in cards(spark, body, "Market In")] == [("Γάλα", 1.5)]


def test_pages_of_unknown_stores_and_missing_pages_have_no_cards(spark):
    assert cards(spark, '<div class="product"><h4>x</h4><i class="price">1,00</i></div>', "corner shop") == []
    assert cards(spark, None, "Lidl") == []


def test_blank_promotion_is_no_sale(spark):
    body = '<div class="odsc-tile"><p class="product-grid-box__title">Τυρί</p><p class="ods-price__value">1.50</p><p class="ods-price__box-content-text-el"> </p></div>'
    ((sale, cut),) = [(r.is_on_sale, r.discount_percent) for r in cards(spark, body, "Lidl")]
    assert not sale and cut is None


@pytest.mark.parametrize(
    "body, want",
    [
        ("<a href='/one'>x</a><a href=/two>y</a><a class=c href=\"/three?a=1&amp;b=2\">z</a>", ["/one", "/two", "/three?a=1&b=2"]),
        ("<A HREF='/up'>x</A><a name=n>none</a><link href='/no'><a href>empty</a>", ["/up", ""]),
        ("<!-- <a href='/comment'> --><script>'<a href=\"/script\">'</script><a\n href = '/spaced' >x</a>", ["/spaced"]),
        (None, []),
    ],
)
def test_links_of_any_quoting(spark, body, want):
    pages = spark.createDataFrame([(1, body)], "page_id int, html string")
    assert [r.href for r in html.page_links(pages).orderBy("pos").collect()] == want


def test_sites_are_checked_on_their_own_pages(spark):
    good, bad = "<article></article>" * 3 + "<img src=a>" * 3, "<article></article><img><img><img>"
    rows = [("Lidl GR", good), ("Lidl GR", bad), ("AB Βασιλόπουλος", good), ("AB Βασιλόπουλος", bad), ("elsewhere", good), ("My Market", None)]
    got = {(r.site, r.check): (r.passed, r.failed) for r in html.site_contracts(spark.createDataFrame(rows, "site string, html string")).collect()}
    cards_ok, images = "Product cards present", "Images loading"
    assert got == {
        ("Lidl GR", cards_ok): (1, 1), ("Lidl GR", images): (2, 0), ("AB Βασιλόπουλος", cards_ok): (1, 1), ("AB Βασιλόπουλος", images): (1, 1),
        ("Σκλαβενίτης", cards_ok): (0, 0), ("Σκλαβενίτης", images): (0, 0), ("My Market", cards_ok): (0, 1),
    }
