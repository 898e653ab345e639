"""Operators against brute force on small data with hot keys, and their plans."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from larder.functions.search import expand_query
from larder.functions.text import norm_text
from larder.operators import catalog, graph, nutrition, scaling, search, social, translate, windows
from larder.operators.ordering import batches, reassemble
from larder.sources import dom, files, html
from larder.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- skew-safe building blocks ---------------------------------------------------

def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = scaling.top_k(df, ["k"], ["id"], 2)
    text = plan(top)
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")
    assert rows(top) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]


def test_add_kept_evaluates_once(spark):
    df = spark.createDataFrame([("<a>b",), ("<c>",)], "x string")
    kept = scaling.add_kept(df, "y", F.regexp_replace("x", "<[^>]*>", ""), lambda y: y != "")
    assert plan(kept).count("regexp_replace") == 1
    assert [r["y"] for r in kept.collect()] == ["b"]


# --- search ------------------------------------------------------------------------

WORDS = ["γάλα", "φρέσκο", "τυρί", "φέτα", "ξίδι", "ξύδι", "μήλο", "ab", "rice", "cat food", "με γεύση μήλο"]


@pytest.fixture(scope="module")
def shop(spark):
    rng = random.Random(5)
    names = [" ".join(rng.sample(WORDS, rng.randint(1, 3))) for _ in range(60)]
    items = [(i, names[0] if i % 3 == 0 else rng.choice(names), rng.choice("XYZ"), round(rng.uniform(0, 9), 2)) for i in range(600)]
    products = spark.createDataFrame(items, "id long, name string, supermarket string, price double").withColumn(
        "normalized_name", norm_text("name"))
    return items, products


def test_gram_join_equals_brute_force(spark, shop):
    items, products = shop
    sets = [["γαλα"], ["φρέσκο", "γάλα"], ["ab"], ["a"], ["ice", "rice"], ["νερό"], ["μήλο"]]
    table = spark.createDataFrame([(s,) for s in [*sets, [], [""]]], "terms array<string>")  # the last two match nothing
    names = products.select("name").distinct()
    want = sorted((tuple(s), n) for s in sets for n in {i[1] for i in items} if all(t in n for t in s))
    got = search.match_names(names, table).select("terms", "name")
    assert sorted((tuple(t), n) for t, n in got.collect()) == want


def test_cheapest_matches_is_exact_for_a_hot_name(spark, shop):
    items, products = shop
    sets = [["φρέσκο"], ["μήλο"], ["rice"]]
    table = spark.createDataFrame([(s,) for s in sets], "terms array<string>")
    keyed = products.withColumn("match_key", F.col("name"))
    got = search.cheapest_matches(keyed, table, 7).select("terms", "id")
    want = [(tuple(s), i[0]) for s in sets for i in sorted((i for i in items if all(t in i[1] for t in s)), key=lambda i: (i[3], i[0]))[:7]]
    assert sorted((tuple(t), i) for t, i in got.collect()) == sorted(want)


def brute_search(items, variants, score):
    """One query replayed step by step over Python rows."""
    seen, pool = set(), []
    for terms in variants:
        hits = sorted((i for i in items if all(canon(t) in canon(i[1]) for t in terms)), key=lambda i: (i[3], i[0]))[:100]
        pool += [(i, terms) for i in hits if i[0] not in seen]
        seen |= {i[0] for i in hits}
    if not pool and len(variants[-1]) > 1:
        hits = sorted((i for i in items if any(canon(t) in canon(i[1]) for t in variants[-1])), key=lambda i: (i[3], i[0]))[:100]
        pool = [(i, variants[-1]) for i in hits]
    scored = sorted(((score[i[1], tuple(t)], i) for i, t in pool if score[i[1], tuple(t)] > 10), key=lambda s: (-s[0], s[1][3], s[1][0]))
    best = {}
    for _, i in scored:
        key = (i[1], i[2])
        if key not in best or i[3] < best[key][3]:
            best[key] = i
    return [i[0] for i in list(best.values())[:40]]


def canon(x):
    return x.lower().translate(str.maketrans("ηυάέίήύό", "ιιαειιιο"))


def test_search_equals_replay(spark, shop):
    from larder.functions.search import multi_word_score

    items, products = shop
    asked = ["milk", "γάλα φρέσκο", "ξυδι", "rice zzz", "μήλο", "x", "gala", "milk", "milk"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, q string")
    variants = {r["qid"]: r["v"] for r in queries.select("qid", expand_query("q").alias("v")).collect()}
    sets = spark.createDataFrame([(t,) for v in variants.values() for t in v], "terms array<string>").distinct()
    pairs = products.select("name").distinct().crossJoin(sets)
    score = {(r["name"], tuple(r["terms"])): r["s"] for r in pairs.select("name", "terms", multi_word_score("name", F.col("terms")).alias("s")).collect()}
    got = defaultdict(list)
    for r in search.search(products, queries).orderBy("qid", "rank").collect():
        got[r["qid"]].append(r["id"])
    for qid, v in variants.items():
        assert got[qid] == (brute_search(items, v, score) if v else []), asked[qid]
    one_store = search.search(products, queries, store="X")
    assert {r["supermarket"] for r in one_store.collect()} == {"X"}


# --- admission windows -----------------------------------------------------------------

def replay(hits, limit, width):
    state, out = {}, {}
    for event_id, user, t in sorted(hits, key=lambda h: (h[1], h[2], h[0])):
        count, reset = state.get(user, (0, -1))
        if t > reset:
            count, reset = 0, t + width
        out[event_id] = count < limit
        state[user] = (count + out[event_id], reset)
    return sorted(out.items())


@pytest.fixture(scope="module")
def hits():
    rng = random.Random(3)
    hot = [(i, 1, rng.randrange(0, 20_000)) for i in range(400)]
    rest = [(400 + i, rng.randrange(2, 30), rng.randrange(0, 200_000)) for i in range(600)]
    return hot + rest + [(2000 + i, 77, 500) for i in range(9)]


@pytest.mark.parametrize("limit, width", [(1, 160), (3, 1000), (2, 7), (50, 100_000)])
def test_windows_by_doubling(spark, hits, limit, width):
    df = spark.createDataFrame(hits, "event_id long, user_id long, t long").withColumn("window", F.lit(width).cast("long")).withColumn("limit", F.lit(limit))
    got = windows.admit(df, ["user_id"]).select("event_id", "admitted")
    assert rows(got) == replay(hits, limit, width)


def test_windows_admit_more_than_a_thousand(spark):
    """A limit above a thousand is kept: 1,200 of 1,500 hits of one window."""
    df = spark.range(1500).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), F.col("id").alias("t"), F.lit(10_000).cast("long").alias("window"), F.lit(1200).alias("limit"))
    assert windows.admit(df, ["user_id"]).where("admitted").count() == 1200


def test_windows_by_stream_over_several_batches(spark, hits, tmp_path):
    ordered = sorted(hits, key=lambda h: (h[2], h[0]))
    for n, part in enumerate((ordered[:300], ordered[300:700], ordered[700:])):
        spark.createDataFrame(part, "event_id long, user_id long, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with jobs.state_store(spark):
        got = jobs.run_log_in_order(stream, "test-rate", lambda log: jobs.rate_limited(log, 3, 1))
    assert rows(got) == replay(hits, 3, 1_000_000)


# --- tables ------------------------------------------------------------------------------

def test_upsert_sets_supplied_nulls_and_keeps_absent_columns(spark):
    target = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, name string, n int")
    changes = spark.createDataFrame([(1, None, 7, 1), (1, "c", None, 2), (3, "d", 8, 1), (3, "e", 9, 0)], "k int, name string, n int, pos int")
    assert rows(catalog.upsert(target, changes, ["k"], ["pos"])) == [(1, "c", None), (2, "b", 6), (3, "d", 8)]
    part = catalog.upsert(target, changes.drop("name"), ["k"], ["pos"])
    assert rows(part) == [(1, "a", None), (2, "b", 6), (3, None, 8)]
    kept = catalog.upsert(target, changes, ["k"], ["pos"], keep=("name",))
    assert rows(kept.select("k", "name")) == [(1, "a"), (2, "b"), (3, "e")]


def test_upsert_stream_over_batches(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for part in ([(1, "c", 1), (3, "x", 2)], [(3, "y", 3), (3, "z", 4)]):
        spark.createDataFrame(part, "k int, v string, pos int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v string, pos int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = rows(jobs.upsert_stream(stream, ["k"], ["pos"], base))
    assert got[:2] == [(1, "c"), (2, "b")] and got[2][0] == 3


@pytest.mark.parametrize("files", [1, 2, 4])
def test_upsert_stream_does_not_depend_on_batches(spark, tmp_path, files):
    base = spark.createDataFrame([(1, 2, "base")], "k int, price int, note string")
    log = [(1, 3, "x", 1), (1, 4, None, 2), (2, 5, "y", 3), (2, None, "z", 4)]
    for n in range(files):
        part = log[n * 4 // files : (n + 1) * 4 // files]
        spark.createDataFrame(part, "k int, price int, note string, pos int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, price int, note string, pos int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in jobs.upsert_stream(stream, ["k"], ["pos"], base).collect()}
    assert got == {(1, 4, None), (2, None, "z")}


def test_insert_if_absent_hot_key(spark):
    target = spark.createDataFrame([("old",)], "k string")
    new = spark.createDataFrame([(i, "hot" if i % 2 else "old" if i % 4 else f"n{i}") for i in range(40)], "id int, k string")
    got = dict(rows(catalog.insert_if_absent(target, new, ["k"], ["id"]).select("id", "outcome")))
    assert [i for i, o in got.items() if o == "added"] == sorted([1] + [i for i in range(0, 40, 4)])


def test_reachable_stops_at_unexpanded_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.reachable(edges, roots, 2)) == [("a", 0), ("b", 1), ("c", 2), ("x", 1), ("y", 2)]
    assert rows(graph.reachable(edges, roots, 3, expand=F.col("node") != "x")) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("x", 1)]


def test_edges_refuse_self_unknown_and_stored(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    stored = spark.createDataFrame([(1, 2)], "a int, b int")
    asked = spark.createDataFrame([(1, 2), (2, 2), (1, 9), (3, 1)], "a int, b int")
    assert rows(social.add_edges(stored, asked, users)) == [(1, 3), (2, 1), (3, 1)]


def test_reassembly(spark):
    df = spark.createDataFrame([(["a", " ", "b", "", "c"],)], "t array<string>")
    got = df.select(reassemble(F.col("t"), F.array(F.lit("A"), F.lit(None), F.lit("C"))).alias("r"), batches(F.col("t"), 2).alias("b")).first()
    assert got["r"] == ["A", " ", "b", "", "C"]
    assert [(s["i"], s["batch"]) for s in got["b"]] == [(0, 0), (2, 0), (4, 1)]


def test_phrases_in_list_order_and_longest_first(spark):
    df = spark.createDataFrame([("Coconut MILK, milky",)], "x string")
    pairs = [("milk", "γάλα"), ("coconut milk", "γάλα καρύδας")]
    run = lambda **k: df.select(translate.phrase_replacer(pairs, **k)("x").alias("r")).first()["r"]
    assert run() == "Coconut γάλα, milky"
    assert run(longest_first=True) == "γάλα καρύδας, milky"


def test_merge_foods(spark):
    foods = spark.createDataFrame(
        [(1, 0, "Ρύζι", None, "0", "5", "10", "1", "x", None), (1, 1, "ΡΎΖΙ ", "1 φλ", "100", "1", "1", "1", "2", "3")],
        "scan_id int, pos int, name string, portion string, calories string, protein string, carbs string, fat string, sugar string, fiber string")
    r = nutrition.merge_foods(foods).first()
    assert (r["name"], r["portion"], r["calories"], r["protein"], r["sugar"]) == ("Ρύζι", "1 φλ", 169, 6, 2)


# --- pages ------------------------------------------------------------------------------------

def test_selectors():
    page = dom.parse('<div class="a b"><p data-x="one two">t<br>u</p><ul><li>1<li class="no-old">2</ul></div><span class="price old">3</span><span class="price">4</span>')
    texts = lambda sel: [n.text() for n in page.all(sel)]
    assert texts('div.a > p[data-x*="two"]') == ["t\nu"]
    assert texts('[class*="price"]:not([class*="old"])') == ["4"]
    assert texts("span > p, ul .no-old") == ["2"]


def cards(spark, body, store):
    return html.extract_cards(spark.createDataFrame([(1, body)], "page_id int, html string"), store).collect()


def test_cards_of_stores(spark):
    r, = cards(spark, '<div class="product"><b class="productTitle">Τυρί</b><i class="pDscntPrice">2,50€</i><i class="pStartPrice">3,00€</i></div>', "Μασούτης")
    assert (r["name"], r["price"], r["old_price"], r["is_on_sale"]) == ("Τυρί", 2.5, 3.0, True)
    r, = cards(spark, '<div class="product"><b class="productTitle">Τυρί</b><i class="pStartPrice">3,00€</i></div>', "Μασούτης")
    assert (r["price"], r["old_price"], r["is_on_sale"]) == (3.0, None, False)
    r, = cards(spark, """<article class="product--teaser"><a data-google-analytics-item-param='{"name":"Γάλα","price":"1.29"}'></a></article>""", "MyMarket")
    assert (r["name"], r["price"]) == ("Γάλα", 1.29)
    r, = cards(spark, '<div data-testid="product-block"><i data-testid="product-brand">ΝΟΥΝΟΥ</i><i data-testid="product-name">Γάλα</i><i data-testid="product-block-price">1 10</i></div>', "ΑΒ Βασιλόπουλος")
    assert (r["name"], r["normalized_name"], r["price"]) == ("ΝΟΥΝΟΥ Γάλα", "νουνου γαλα", 1.1)


def test_recipe_sites(spark):
    pages = spark.createDataFrame([
        (1, "panos", '<h1>Φακές</h1><div class="recipe-ingredient">200γρ\nφακές</div><div class="recipe-content">Βράζουμε τις φακές σε νερό.\nok</div><p class="nutri-fact">300 kcal</p>'),
        (2, "elsewhere", "<h1>x</h1>"),
    ], "page_id int, site string, html string")
    got = {r["page_id"]: r for r in html.parse_recipe_pages(pages).collect()}
    assert got[1]["ingredients"] == ["200γρ φακές"] and got[1]["instructions"] == ["Βράζουμε τις φακές σε νερό."]
    assert got[1]["known"] and not got[2]["known"]


def test_url_map_files(spark, tmp_path):
    (tmp_path / "links.json").write_text('{"A": ["u1", "u2"], "B": []}')
    assert rows(files.read_json_object(spark, str(tmp_path / "links.json"))) == [("A", "u1"), ("A", "u2")]


def test_recipe_pipeline(spark):
    from larder.operators import recipes

    ld = '{"@type":"Recipe","name":"Φακές","recipeYield":"6","totalTime":"PT20M","recipeIngredient":["200γρ φακές","200γρ φακές"],"recipeInstructions":[{"text":"Βράζουμε τις φακές."}],"nutrition":{"calories":"320 kcal","proteinContent":"30 g"}}'
    pages = spark.createDataFrame([
        (1, "akis", "u1", f'<h1>x</h1><script type="application/ld+json">{ld}</script>'),
        (2, "akis", "u2", f'<h1>x</h1><script type="application/ld+json">{ld}</script>'),
        (3, "gymbeam", "u3", "<h1>Συνταγή τούρτα</h1><div class='e-content'>Intro\nΥλικά:\n2 αυγά\nαλεύρι\nΕκτέλεση:\nΧτυπάμε τα αυγά καλά.\nΨήνουμε για μία ώρα.</div><table><tr>Λιπαρά 12 γρ</tr></table>"),
        (4, "panos", "u4", "<p>nothing</p>"),
        (5, "akis", "old", "<h1>x</h1>"),
    ], "page_id int, site string, url string, html string")
    raw = html.parse_recipe_pages(pages).join(pages.select("page_id", "url"), "page_id")
    built = recipes.build_recipes(raw)
    rows_by_id = {r["page_id"]: r for r in built.collect()}
    r = rows_by_id[1]
    assert (r["title"], r["servings"], r["minutes"], r["calories"], r["protein"]) == ("Φακές", 6, 20, 320.0, 30.0)
    assert r["ingredients"] == ["200γρ φακές"] and r["instructions"] == ["Βράζουμε τις φακές."]
    assert r["tags"] == ["high-protein", "healthy", "quick"] and r["difficulty"] == "Εύκολη" and r["is_healthy"]
    r = rows_by_id[3]
    assert r["ingredients"] == ["2 αυγά", "αλεύρι"] and r["instructions"] == ["Χτυπάμε τα αυγά καλά.", "Ψήνουμε για μία ώρα."]
    assert r["outcome"] == "ok"
    stored = spark.createDataFrame([("old", "z", "akis")], "url string, title string, site string")
    outcome = {r["page_id"]: r["outcome"] for r in recipes.store_new(built, stored, ["page_id"]).collect()}
    assert outcome == {1: "added", 2: "skipped", 3: "added", 4: "error", 5: "skipped"}
