"""The same stand-in views as SQL common table expressions, for the oracle only."""

SEP = r"[ -/:-@\[-`{-~\t\n\r]"

_CTES = {
    "order_products": """order_products AS (
  SELECT l_orderkey, string_agg('{"product_name":"' || product_name || '","category":"' || p_type
           || '","taxful_price":' || CAST(price AS VARCHAR) || '}', ',' ORDER BY place) AS entries,
         string_agg('"' || p_type || '"', ',' ORDER BY p_type) AS types,
         count(*) AS n_types, sum(price) AS price, sum(qty) AS qty
  FROM (SELECT l_orderkey, p_type, min((l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS place,
               arg_min(p_name, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS product_name,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS price,
               CAST(sum(l_quantity) AS INTEGER) AS qty
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1)""",
    "order_brands": """order_brands AS (
  SELECT l_orderkey AS b_orderkey, '[' || string_agg('"' || p_brand || '"', ',' ORDER BY p_brand) || ']' AS manufacturer
  FROM (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1)""",
    "order_headers": """order_headers AS (
  SELECT o_orderkey AS order_id, CAST(44 + o_custkey % 3 AS INTEGER) AS partner_id,
         o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS order_date, o_custkey AS customer_id,
         CAST(o_totalprice AS DECIMAL(12,2)) AS taxful_total_price,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'pending' ELSE 'processing' END AS order_status,
         o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS created_at,
         o_orderdate + to_seconds(o_orderkey * 7919 % 86400) + to_hours(o_orderkey % 3) AS updated_at
  FROM orders)""",
    "ecommerce": """ecommerce AS (
  SELECT h.order_id, h.partner_id, h.order_date, h.customer_id,
         split_part(c_name, '#', 1) AS customer_first_name, split_part(c_name, '#', 2) AS customer_last_name,
         c_name AS customer_full_name,
         CASE c_custkey % 3 WHEN 1 THEN 'F' WHEN 2 THEN 'M' END AS customer_gender,
         lower(c_name) || '@example.com' AS email,
         CASE WHEN c_nationkey % 2 = 0 THEN 'EUR' END AS currency,
         h.taxful_total_price, p.price AS taxless_total_price, CAST(p.qty AS INTEGER) AS total_quantity,
         CAST(p.n_types AS INTEGER) AS total_unique_products, h.order_status,
         '[' || p.types || ']' AS category, b.manufacturer, '[' || p.entries || ']' AS products,
         '{"country_iso_code":"N' || c_nationkey || '"' || CASE WHEN c_acctbal < 0 THEN '' ELSE '}' END AS geoip,
         h.created_at, h.updated_at
  FROM order_headers h JOIN customer ON h.customer_id = c_custkey
  LEFT JOIN order_products p ON p.l_orderkey = h.order_id LEFT JOIN order_brands b ON b.b_orderkey = h.order_id)""",
    "clickstream": """clickstream AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS event_time, CAST(44 + user_id % 3 AS INTEGER) AS partner_id,
         user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, user_id,
         CASE event_type WHEN 'click' THEN 'cart' ELSE event_type END AS event_type,
         '/p/' || (user_id % 20) AS page_url,
         CASE WHEN event_type <> 'error' THEN 'product-' || (user_id % 50) END AS product_name,
         CASE WHEN event_type <> 'signup' THEN 'cat-' || (user_id % 7) END AS product_category,
         CASE WHEN event_type <> 'view' THEN CAST(value AS DECIMAL(10,2)) END AS product_price
  FROM events)""",
    "clickstream_json": """clickstream_json AS (
  SELECT CASE WHEN event_id % 97 = 0 THEN substring(m, 1, 60) ELSE m END AS value FROM (
    SELECT event_id, '{"event_id":"' || event_id || '","session_id":"' || user_id || '","partner_id":' || (44 + user_id % 3)
      || ',"user_id":' || user_id || ',"event_type":"' || event_type || '","event_timestamp":"'
      || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","page_url":"/p/' || (user_id % 20) || '","device_info":{"type":"'
      || CASE WHEN user_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END
      || CASE WHEN user_id % 5 = 0 THEN '"}' ELSE '","os":"os-a"}' END
      || ',"event_properties":{"product_name":"product-' || (user_id % 50) || '","category":"cat-' || (user_id % 7)
      || '","price":' || CASE WHEN event_type = 'signup' THEN '"' || CAST(value AS DECIMAL(10,2)) || '"'
                              ELSE CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) END
      || '},"utm_params":{"source":"mail"}}' AS m FROM events))""",
    "spans": """spans AS (
  SELECT CAST(event_id // 8 AS VARCHAR) AS trace_id, CAST(event_id AS VARCHAR) AS span_id,
         CASE WHEN event_id % 8 <> 0 THEN CAST((event_id // 8) * 8 + ((event_id % 8) - 1) // 2 AS VARCHAR) END AS parent_span_id,
         event_type AS span_name, 'svc-' || (user_id % 5) AS service_name, 'host-' || (user_id % 4) AS host,
         ts AS timestamp, CAST(trunc(value * 1000) AS BIGINT) AS duration,
         ts + to_microseconds(CAST(trunc(value * 1000) AS BIGINT)) AS end_time,
         json_extract_string(props, '$.k') AS k,
         CASE WHEN event_id % 8 = 0 THEN 'SPAN_KIND_SERVER' ELSE 'SPAN_KIND_CLIENT' END AS span_kind,
         CASE event_type WHEN 'error' THEN 'STATUS_CODE_ERROR' WHEN 'purchase' THEN 'STATUS_CODE_OK'
                         ELSE 'STATUS_CODE_UNSET' END AS status_code
  FROM events)""",
    "logs": """logs AS (
  SELECT event_id AS log_id, ts AS timestamp, 'svc-' || (user_id % 5) AS service_name,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS severity_text,
         CAST(event_id // 8 AS VARCHAR) AS trace_id, props AS attributes, value AS duration, text AS body
  FROM events JOIN documents ON event_id % (SELECT count(*) FROM documents) = doc_id)""",
    "tokened_logs": f"""tokened_logs AS (
  SELECT *, list_filter(string_split_regex(lower(body), '{SEP}+'), lambda x: x <> '') AS toks FROM logs)""",
    "chunks": """chunks AS (
  SELECT tenant_id, corpus_id, doc_key || '-' || chunk_index AS row_id, content_type, content,
         CAST(doc_key AS VARCHAR) AS doc_id, chunk_index, CAST(chunk_index // 4 + 1 AS INTEGER) AS page_number, doc_key,
         list_transform(w, lambda x: regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')) AS entity_names
  FROM (SELECT *, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS w FROM (
    SELECT *, list_filter(string_split_regex(content, '\\s+'), lambda x: length(x) > 4 AND regexp_matches(x, '^[A-Z]')) AS ws
    FROM (SELECT source AS tenant_id, lang AS corpus_id, doc_id AS doc_key,
          CASE doc_id % 10 WHEN 8 THEN 'image' WHEN 9 THEN 'table' ELSE 'text' END AS content_type,
          CAST(i AS INTEGER) AS chunk_index, substring(text, i * 400 + 1, 400) AS content
          FROM documents, UNNEST(range(0, greatest(1, (length(text) + 399) // 400))) AS t(i)))))""",
    "triples": """triples AS (
  SELECT tenant_id, corpus_id, row_id AS chunk_id, entity_names[i] AS source_entity, 'NEXT' AS relation_type,
         entity_names[i + 1] AS target_entity
  FROM chunks, UNNEST(range(1, len(entity_names))) AS t(i))""",
    "embedded": """embedded AS (
  SELECT c.*, CAST(e.embedding AS DOUBLE[]) AS v
  FROM chunks c JOIN embeddings e ON c.doc_key % (SELECT count(*) FROM embeddings) = e.vec_id)""",
    "query_vectors": """query_vectors AS (
  SELECT CAST(label AS VARCHAR) AS query_id, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS q FROM embeddings GROUP BY 1)""",
    "answers": """answers AS (
  SELECT conv_id, turn, text || ' [' || turn || '] ![fig][IMG-' || conv_id || '] [TABLE-' || turn || '] [EQ-x]' AS text
  FROM conversations)""",
    "bench_events": """bench_events AS (
  SELECT event_id, CAST(44 + user_id % 3 AS INTEGER) AS partner_id, event_type,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS event_timestamp,
         date_trunc('millisecond', ts + to_milliseconds(event_id % 1000 + 200)) AS ingest_time,
         length(props) AS payload_bytes FROM events)""",
}

_NEEDS = {
    "ecommerce": ["order_headers", "order_products", "order_brands"],
    "tokened_logs": ["logs"],
    "triples": ["chunks"],
    "embedded": ["chunks"],
}


def sql(views: str, body: str) -> str:
    """``WITH <views and what they need> <body>``; ``body`` may add further CTEs with ', x AS'."""
    wanted: list[str] = []
    for view in views.split():
        for name in _NEEDS.get(view, []) + [view]:
            if name not in wanted:
                wanted.append(name)
    return "WITH " + ",\n".join(_CTES[n] for n in wanted) + "\n" + body.strip()
