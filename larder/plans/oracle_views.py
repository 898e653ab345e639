"""SQL text of the fixture views, used only by the checking SQL."""

VIEWS: dict[str, str] = {
    "v_products": """SELECT p_partkey AS id, p_name AS name, lower(p_name) AS normalized_name,
        p_brand AS supermarket, p_type AS category, p_retailprice AS price FROM part""",
    "v_offers": """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
        l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS pos, l_orderkey AS order_key,
        l_partkey AS product_id, l_suppkey AS store_id, l_extendedprice AS price,
        l_discount > 0 AS is_on_sale,
        '-' || CAST(CAST(floor(l_discount * 100 + 0.5) AS INT) AS VARCHAR) || '%' AS discount_percent,
        l_shipdate AS date_scraped FROM lineitem""",
    "v_queries": """SELECT * FROM (VALUES (1, 'red'), (2, 'widget'), (3, 'red widget'), (4, 'ring'),
        (5, 'zzz bolt'), (6, 'gi')) AS t(qid, q)""",
    "v_recipes": """SELECT d.doc_id AS id, substring(d.text, 1, 40) AS title,
        substring(d.text, 1, 300) AS description, d.text AS body, d.lang AS category,
        d.source AS source_api, d.n_chars % 90 AS minutes, d.n_chars % 40 AS protein,
        CASE WHEN l.quality IS NULL THEN NULL ELSE d.n_chars % 900 END AS calories,
        d.n_chars % 60 AS carbs, d.n_chars % 25 AS fat, d.doc_id % 6 + 1 AS servings,
        TIMESTAMP '2024-01-01 00:00:00' + CAST(d.doc_id AS INT) * INTERVAL '1' MINUTE AS created_at,
        [x FOR x IN string_split(d.text, chr(10)) IF length(x) < 80] AS ingredients,
        [x FOR x IN string_split(d.text, chr(10)) IF length(x) >= 80] AS instructions,
        [d.lang, d.source] AS tags
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_users": """SELECT c_custkey AS id, c_name AS name,
        lower(replace(c_name, '#', '')) || '@example.com' AS email,
        'K' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS share_key,
        c_mktsegment = 'BUILDING' AS is_premium,
        TIMESTAMP '2024-01-16 12:00:00' + CAST(c_custkey % 30 AS INT) * INTERVAL '1' DAY AS trial_ends_at
        FROM customer""",
    "v_edges": """SELECT c_custkey AS a, (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS b
        FROM customer WHERE c_custkey <> (c_custkey * 7 + 3) % (SELECT count(*) FROM customer)""",
    "v_messages": """SELECT conv_id * 1000 + turn AS id, conv_id % 40 AS share_key, role AS sender,
        CASE WHEN turn % 3 = 2 THEN (conv_id + 1) % 40 END AS target_key, text,
        TIMESTAMP '2024-01-01 00:00:00' + CAST(conv_id * 1000 + turn AS INT) * INTERVAL '1' SECOND
        AS created_at FROM conversations""",
    "v_lists": """SELECT o_orderkey AS list_id, o_custkey AS user_id, o_orderpriority AS title,
        o_totalprice AS total, o_orderdate AS created_at FROM orders""",
    "v_meals": """SELECT l_orderkey AS day, CASE l_linenumber WHEN 1 THEN 'breakfast' WHEN 2 THEN 'lunch'
        WHEN 3 THEN 'dinner' WHEN 4 THEN 'breakfast_alt' WHEN 5 THEN 'lunch_alt' WHEN 6 THEN 'dinner_alt'
        ELSE 'supper' END AS slot, l_quantity AS protein, CAST(l_partkey % 60 AS DOUBLE) AS carbs,
        CAST(l_suppkey % 30 AS DOUBLE) AS fat, l_partkey AS part_key FROM lineitem""",
    "v_ingredients": """SELECT l.l_orderkey % 50 AS plan_id,
        CAST(CAST(l.l_quantity AS INT) * 10 AS VARCHAR) || 'g ' || p.p_name || ' (' || p.p_type || ')' AS raw,
        l.l_orderkey AS order_key, l.l_linenumber AS line_number
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_nutrients": """SELECT l_orderkey AS food_id, l_suppkey % 3 AS source_rank,
        CASE l_linenumber WHEN 1 THEN 1008 WHEN 2 THEN 1003 WHEN 3 THEN 1004 WHEN 4 THEN 1005
        WHEN 5 THEN 2000 WHEN 6 THEN 1079 ELSE 1093 END AS nutrient_id, l_quantity AS value,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
        l_quantity, l_extendedprice, l_discount, l_tax) AS pos FROM lineitem""",
    "v_api_json": """SELECT event_id, '{"fullTitle":"' || event_type || '","price":{"price":' ||
        CAST(value AS VARCHAR) || '},"ribbons":[{"text":"-' || CAST(event_id % 50 AS VARCHAR) ||
        '%"}],"stockAvailability":{"available":' || CASE WHEN event_id % 7 = 0 THEN 'false' ELSE 'true' END ||
        '},"totalTime":"PT1H' || CAST(event_id % 60 AS VARCHAR) || 'M"}' AS payload FROM events""",
    "v_price_text": """SELECT event_id, CASE event_id % 5
        WHEN 0 THEN CAST(CAST((cents - cents % 100) / 100 AS BIGINT) AS VARCHAR) || ',' ||
          lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ' €'
        WHEN 1 THEN CAST(CAST((cents - cents % 100) / 100 AS BIGINT) AS VARCHAR) || ' ' ||
          lpad(CAST(cents % 100 AS VARCHAR), 2, '0')
        WHEN 2 THEN CAST(cents AS VARCHAR)
        WHEN 3 THEN CAST(CAST((cents - cents % 100) / 100 AS BIGINT) AS VARCHAR) || '.' ||
          lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ' € /kg'
        ELSE 'n/a' END AS price_text
        FROM (SELECT event_id, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events) e""",
    "v_graph": """SELECT DISTINCT 'c' || CAST(o.o_custkey AS VARCHAR) AS src,
        'p' || CAST(l.l_partkey AS VARCHAR) AS dst FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
        UNION ALL SELECT DISTINCT 'p' || CAST(l.l_partkey AS VARCHAR) AS src,
        'c' || CAST(o.o_custkey AS VARCHAR) AS dst FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey""",
    "v_subs": """SELECT event_id, 'e' || CAST(event_id % 700 AS VARCHAR) AS endpoint, user_id,
        event_type = 'error' AS failed, ts FROM events""",
    "v_choices": """SELECT event_id, user_id, event_id % 7 AS day, CASE event_id % 3 WHEN 0 THEN 'breakfast'
        WHEN 1 THEN 'lunch' ELSE 'dinner' END AS meal_type, CASE WHEN value < 245 THEN 'a' ELSE 'b' END
        AS chosen, ts FROM events""",
    "v_links": """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""",
    "v_lines": """SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) t""",
}
