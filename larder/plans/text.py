"""Text cleaning, lines, urls and dictionaries over whole text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import fixed_values as fv
from larder.functions import text as tx
from larder.operators import translate
from larder.operators.scaling import add_kept
from larder.plans.registry import query
from larder.sources import tables

WS = "' ' || chr(10) || chr(9) || chr(13)"


def clean_sql(x):
    out = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"')):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace(regexp_replace({out}, '&#[0-9]+;|&[a-z]+;', '', 'g'), '\\s{{2,}}', ' ', 'g'), {WS})"


def norm_sql(x):
    return f"trim(strip_accents(lower({clean_sql(x)})), {WS})"


def bullet_sql(x):
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '^[•·▪●]\\s*', ''), '^[-–—]\\s*', ''), '^[0-9]+[.)]\\s*', '')"


def noise_sql(x):
    letters = f"regexp_replace({clean_sql(x)}, '[^A-Za-zΑ-Ωα-ω]', '', 'g')"
    return (f"({norm_sql(x)} = '' OR regexp_matches({norm_sql(x)}, 'gymbeam|related products|bestseller') OR regexp_matches({x}, '€|\\$[0-9]') "
            f"OR (length({letters}) >= 6 AND {letters} = upper({letters})))")


docs = lambda spark, d: tables.table(spark, d, "documents")


@query("clean_html_text", f"SELECT page_id, {clean_sql('html')} AS text FROM pages")
def clean_html_text(spark, d):
    return tables.table(spark, d, "pages").select("page_id", tx.clean_html("html").alias("text"))


@query("clean_text_fallback", f"""SELECT doc_id, coalesce(nullif(regexp_replace(trim(CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE text END, {WS}), '\\s+', ' ', 'g'), ''), '—') AS text FROM documents""")
def clean_text_fallback(spark, d):
    t = F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", tx.clean_text(t, "—").alias("text"))


@query("recipe_noise_line", f"SELECT doc_id, pos, {noise_sql('line')} AS noise FROM v_lines", ("v_lines",))
def recipe_noise_line(spark, d):
    return tables.lines(spark, d).select("doc_id", F.col("pos").cast("bigint").alias("pos"), tx.is_noise_line("line").alias("noise"))


@query("recipe_section_line", """SELECT doc_id, pos, pos % 4 < 3 AS section FROM v_lines""", ("v_lines",))
def recipe_section_line(spark, d):
    """Headings put in front of some of the lines are recognised; the others are not."""
    k = F.col("pos") % 4
    line = F.when(k == 0, F.concat(F.lit("Για την "), "line")).when(k == 1, F.concat(F.lit("Υλικά: "), "line")).when(
        k == 2, F.concat("line", F.lit(" θα χρειαστούμε:"))).otherwise(F.concat(F.lit("Υλικάκια "), "line"))
    return tables.lines(spark, d).select("doc_id", F.col("pos").cast("bigint").alias("pos"), tx.is_section_line(line).alias("section"))


@query("dedupe_lines", f"""
    WITH k AS (SELECT doc_id, pos, line, {norm_sql('line')} AS key FROM v_lines), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS rn FROM k WHERE key <> '')
    SELECT doc_id, string_agg(line, '|' ORDER BY pos) AS lines FROM f WHERE rn = 1 GROUP BY doc_id""", ("v_lines",))
def dedupe_lines(spark, d):
    out = add_kept(docs(spark, d), "ls", tx.dedupe_lines(F.split("text", "\n", -1)), lambda ls: F.size(ls) > 0)
    return out.select("doc_id", tx.as_text("ls").alias("lines"))


@query("sanitize_lines", f"""
    WITH b AS (SELECT doc_id, pos, {bullet_sql(clean_sql('line'))} AS line FROM v_lines),
    k AS (SELECT doc_id, pos, line, {norm_sql('line')} AS key FROM b WHERE line <> '' AND length(line) BETWEEN 2 AND 140 AND NOT {noise_sql('line')}),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS rn FROM k WHERE key <> '')
    SELECT doc_id, string_agg(line, '|' ORDER BY pos) AS lines FROM f WHERE rn = 1 GROUP BY doc_id""", ("v_lines",))
def sanitize_lines(spark, d):
    out = add_kept(docs(spark, d), "ls", tx.sanitize_lines(F.split("text", "\n", -1)), lambda ls: F.size(ls) > 0)
    return out.select("doc_id", tx.as_text("ls").alias("lines"))


@query("split_instructions", f"""
    WITH p AS (SELECT doc_id, text, [x FOR x IN [{clean_sql('y')} FOR y IN string_split_regex(trim(text, {WS}), '\\r?\\n+')] IF x <> ''] AS ps FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ps) > 1 THEN ps ELSE [x FOR x IN string_split(regexp_replace({clean_sql('text')}, '([.!?])\\s+([A-ZΑ-Ω])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) IF x <> ''] END AS xs FROM p)
    SELECT doc_id, len(xs) AS n, array_to_string(xs, '|') AS steps FROM s""")
def split_instructions(spark, d):
    out = docs(spark, d).select("doc_id", tx.split_instructions("text").alias("xs"))
    return out.select("doc_id", F.size("xs").cast("bigint").alias("n"), tx.as_text("xs").alias("steps"))


def steps(ls):
    prefix = F.when(F.col("pos") % 3 == 0, F.concat((F.col("pos") + 1).cast("string"), F.lit(". "))).when(
        F.col("pos") % 3 == 1, "FITNESS ΣΥΝΤΑΓΗ: ").otherwise("")
    return ls.select("doc_id", F.col("pos").cast("bigint").alias("pos"), tx.strip_step_prefix(F.concat(prefix, "line")).alias("step"))


STEPS = f"""
    WITH p AS (SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN (pos + 1) || '. ' WHEN 1 THEN 'FITNESS ΣΥΝΤΑΓΗ: ' ELSE '' END || line AS line FROM v_lines)
    SELECT doc_id, pos, trim(regexp_replace(regexp_replace(line, '^[0-9]+[.)]\\s*', ''), '^(?i:(FITNESS\\s+)?ΣΥΝΤΑΓ[ΗΉ]\\s*(FITNESS\\s*)?:\\s*)', ''), {WS}) AS step FROM p"""


@query("strip_step_prefix", STEPS, ("v_lines",))
@query("strip_step_prefix_whole", STEPS, ("v_lines",))
def strip_step_prefix_whole(spark, d):
    """All lines, also those that begin with a number of their own."""
    return steps(tables.lines(spark, d))


def first_marker_sql(text, markers):
    """Offset and length of the first of ``markers``, in their order, that ``text`` holds."""
    return f"CASE {' '.join(f"WHEN contains({text}, '{m}') THEN instr({text}, '{m}') + {len(m)}" for m in markers)} END"


NEAREST = f"list_sort([x FOR x IN [{', '.join(f"{{'at': instr(rest, '{m}'), 'n': {-len(m)}}}" for m in fv.INSTRUCTION_MARKERS)}] IF x.at > 0])[1]"


SECTIONS = f"""
    WITH h AS (SELECT doc_id, text, CAST(length(text) // 2 AS BIGINT) AS n FROM documents),
    p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'intro Υλικά: ' || substring(text, 1, n) || 'Εκτέλεση:' || substring(text, n + 1)
      ELSE 'Συστατικά:x Υλικά: ' || substring(text, 1, n) || ' Παρασκευή rest Εκτέλεση:' || substring(text, n + 1) END AS page FROM h),
    r AS (SELECT doc_id, substring(page, {first_marker_sql('page', fv.INGREDIENT_MARKERS)}) AS rest FROM p),
    e AS (SELECT doc_id, rest, {NEAREST} AS e FROM r)
    SELECT doc_id, coalesce(CASE WHEN e IS NULL THEN rest ELSE substring(rest, 1, e.at - 1) END, '') AS ingredients,
      coalesce(trim(substring(rest, e.at - e.n), {WS}), '') AS instructions FROM e"""


@query("section_split", SECTIONS)
@query("section_split_whole", SECTIONS)
def section_split_whole(spark, d):
    """The markers stand around the first and the second half of each text, so the whole text is split."""
    text, k = F.col("text"), F.col("doc_id") % 3
    n = F.floor(F.length(text) / 2).cast("int")
    a, b = F.substring(text, F.lit(1), n), F.substring(text, n + 1, F.length(text))
    page = F.when(k == 0, text).when(k == 1, F.concat(F.lit("intro Υλικά: "), a, F.lit("Εκτέλεση:"), b)).otherwise(
        F.concat(F.lit("Συστατικά:x Υλικά: "), a, F.lit(" Παρασκευή rest Εκτέλεση:"), b))
    return docs(spark, d).select("doc_id", tx.section_split(page).alias("s")).select("doc_id", "s.ingredients", "s.instructions")


PHRASES = [("small", "μικρό"), ("ring", "δαχτυλίδι"), ("hot", "καυτό"), ("gear", "γρανάζι"), ("red", "κόκκινο"), ("red ring", "δεν ταιριάζει"), ("widget", "γουίτζετ"), ("old", "παλιό")]


def phrase_sql(x):
    for en, gr in PHRASES:
        x = f"regexp_replace({x}, '\\b{en}\\b', '{gr}', 'gi')"
    return x


@query("dictionary_phrase_replace", f"SELECT p_partkey, {phrase_sql('text')} AS text FROM (SELECT p_partkey, 'Hot ' || p_name || ', ringlet (' || p_type || ')' AS text FROM part) t")
def dictionary_phrase_replace(spark, d):
    text = F.concat(F.lit("Hot "), "p_name", F.lit(", ringlet ("), "p_type", F.lit(")"))
    return tables.table(spark, d, "part").select("p_partkey", translate.phrase_replacer(PHRASES)(text).alias("text"))


TITLES = [(0, "red widget", "κόκκινο γουίτζετ"), (1, "Gear", "γρανάζι"), (2, "old", "παλιό"), (3, "ring", "δαχτυλίδι")]
TITLE_SQL = """CASE WHEN {0} = 'red widget' THEN 'κόκκινο γουίτζετ' WHEN contains({0}, 'red widget') THEN replace({0}, 'red widget', 'κόκκινο γουίτζετ')
    WHEN contains({0}, 'gear') THEN replace({0}, 'gear', 'γρανάζι') WHEN contains({0}, 'old') THEN regexp_replace({0}, 'old', 'παλιό') WHEN contains({0}, 'ring') THEN replace({0}, 'ring', 'δαχτυλίδι') ELSE {0} END"""


def title_table(spark):
    rows = ", ".join(f"({p}, '{en}', '{gr}')" for p, en, gr in TITLES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(pos, en, gr)")


@query("title_translate", f"SELECT DISTINCT p_name AS title, {TITLE_SQL.format('p_name')} AS translated FROM part")
def title_translate(spark, d):
    return translate.translate_titles(tables.table(spark, d, "part").select(F.col("p_name").alias("title")), title_table(spark))


@query("translate_record", f"""SELECT p_partkey, {TITLE_SQL.format('p_name')} AS title, p_name AS title_original, CASE WHEN p_size % 2 = 0 THEN 'Μοσχάρι' ELSE p_type END AS category,
    'Ελληνική' AS area, {phrase_sql('p_name')} || '|' || {phrase_sql("'old ' || p_brand")} AS ingredients FROM part""")
def translate_record(spark, d):
    records = tables.table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, "Beef").otherwise(F.col("p_type")).alias("category"),
        F.lit("Greek").alias("area"), F.array("p_name", F.concat(F.lit("old "), "p_brand")).alias("ingredients"))
    return translate.translate_records(records, title_table(spark), PHRASES).withColumn("ingredients", tx.as_text("ingredients"))


@query("sentence_chunks", f"""
    WITH RECURSIVE m AS (SELECT doc_id, text, regexp_extract_all(text, '[^.!?\\n]+[.!?\\n]+') AS ms FROM documents),
    ss AS (SELECT doc_id, CASE WHEN len(ms) > 0 THEN ms ELSE [text] END AS l FROM m),
    s AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM ss),
    r AS (SELECT doc_id, i, 0 AS c, length(t) AS n FROM s WHERE i = 1
      UNION ALL SELECT s.doc_id, s.i, CASE WHEN r.n + length(s.t) > 450 THEN r.c + 1 ELSE r.c END, CASE WHEN r.n + length(s.t) > 450 THEN length(s.t) ELSE r.n + length(s.t) END
      FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1),
    c AS (SELECT r.doc_id, r.c, trim(string_agg(s.t, '' ORDER BY s.i), {WS}) AS chunk FROM r JOIN s ON r.doc_id = s.doc_id AND r.i = s.i GROUP BY 1, 2)
    SELECT doc_id, count(*) AS n, string_agg(chunk, '|' ORDER BY c) AS chunks FROM c WHERE chunk <> '' GROUP BY doc_id""")
def sentence_chunks(spark, d):
    out = add_kept(docs(spark, d), "cs", tx.sentence_chunks("text"), lambda cs: F.size(cs) > 0)
    return out.select("doc_id", F.size("cs").cast("bigint").alias("n"), tx.as_text("cs").alias("chunks"))


@query("strip_packaging_words", "SELECT p_partkey, p_name AS name FROM part")
def strip_packaging_words(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", tx.strip_packaging_words(F.concat("p_name", F.lit(" Το Τεμάχιο ΣΥΣΚΕΥΑΣΊΑ"))).alias("name"))


@query("url_canonical", "SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS url FROM pages")
def url_canonical(spark, d):
    return tables.table(spark, d, "pages").select("page_id", tx.url_canonical("url").alias("url"))


@query("url_to_store", """SELECT page_id, CASE WHEN contains(url, '.com') THEN 'ab' WHEN contains(url, '.net') THEN 'net' ELSE 'org' END AS id FROM pages
    WHERE contains(url, '.com') OR contains(url, '.net') OR contains(url, '.org')""")
def url_to_store(spark, d):
    from larder.plans.filters import store_pages

    return store_pages(spark, d).select("page_id", "id")


@query("strip_leading_zeros", "SELECT p_partkey, ltrim(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), '0') AS code FROM part")
def strip_leading_zeros(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", tx.strip_leading_zeros(F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("code"))


@query("truncate_text", "SELECT doc_id, substring(text, 1, 300) AS short, length(substring(text, 1, 2500)) AS n FROM documents")
def truncate_text(spark, d):
    return docs(spark, d).select("doc_id", F.substring("text", 1, 300).alias("short"), F.length(F.substring("text", 1, 2500)).alias("n"))


@query("split_keywords", f"SELECT doc_id, array_to_string([x FOR x IN [trim(y, {WS}) FOR y IN string_split(text, ',')] IF x <> ''], '|') AS words FROM documents")
def split_keywords(spark, d):
    return docs(spark, d).select("doc_id", tx.as_text(tx.split_keywords("text")).alias("words"))


@query("parse_key_list", "SELECT a, upper('k' || a) || '|' || upper('k' || b) AS keys FROM v_edges", ("v_edges",))
def parse_key_list(spark, d):
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string"))
    listed = F.concat(F.lit(" "), key("a"), F.lit(" ,, "), key("b"), F.lit(","))
    return tables.edges(spark, d).select("a", tx.as_text(tx.parse_key_list(listed)).alias("keys"))


@query("title_from_page", """SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '\\s*[–—|-].*$', '')) AS title FROM pages""")
def title_from_page(spark, d):
    return tables.table(spark, d, "pages").select("page_id", tx.title_from_page(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))
