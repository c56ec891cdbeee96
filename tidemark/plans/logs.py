"""Registered log searches. The oracle splits bodies into token lists; Spark matches patterns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import logs as L
from tidemark.operators.search import Search
from tidemark.plans.register import Registry
from tidemark.plans.views_sql import SEP, sql
from tidemark.sources import testmodel as m

register = Registry()

ANY, ALL, PHRASE, PREFIX = "token error", "the and that", "de la", "the thr"
_PADDED = "' ' || array_to_string(toks, ' ') || ' '"
IS_ANY = "list_has_any(toks, ['token', 'error'])"
IS_ALL = "list_has_all(toks, ['the', 'and', 'that'])"
IS_PHRASE = f"contains({_PADDED}, ' de la ')"
IS_PREFIX = f"contains({_PADDED}, ' the thr')"


@register("l1_log_histogram", sql("tokened_logs", f"""
SELECT date_trunc('hour', timestamp) AS time, count(*) AS count FROM tokened_logs
WHERE severity_text = 'ERROR' AND {IS_ALL} GROUP BY 1"""))
def l1(spark, sf):
    return L.log_histogram(m.logs(spark, sf), 1, "hour", level="ERROR", match=ALL, how="match_all")


@register("l2_log_search", sql("tokened_logs", f"""
SELECT log_id, timestamp, service_name, severity_text, trace_id, body FROM tokened_logs
WHERE severity_text = 'WARN' AND {IS_ANY} ORDER BY timestamp DESC, log_id DESC LIMIT 100"""))
def l2(spark, sf):
    return L.log_search(m.logs(spark, sf), level="WARN", match=ANY)


@register("l3_distinct_values", sql("spans", """
SELECT DISTINCT service_name FROM spans WHERE timestamp BETWEEN '2024-01-10' AND '2024-01-20' ORDER BY 1"""))
def l3(spark, sf):
    return L.distinct_values(m.spans(spark, sf), "service_name", "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@register("l4_discover_page", sql("logs", """
SELECT log_id, timestamp, service_name, duration FROM logs
WHERE timestamp BETWEEN '2024-01-05' AND '2024-01-25' AND severity_text IN ('ERROR', 'WARN') AND NOT duration BETWEEN 100 AND 200
ORDER BY timestamp DESC, log_id DESC LIMIT 50 OFFSET 100"""))
def l4(spark, sf):
    return L.discover_page(
        m.logs(spark, sf), ["log_id", "timestamp", "service_name", "duration"],
        [("severity_text", "in", ["ERROR", "WARN"]), ("duration", "not between", [100, 200])],
        "2024-01-05 00:00:00", "2024-01-25 00:00:00", page=3, size=50)


@register("l5_histogram", sql("logs", """
SELECT time_bucket(INTERVAL 12 HOUR, t) AS bucket, CAST(sum(n) AS BIGINT) AS count
FROM (SELECT date_trunc('hour', timestamp) AS t, count(*) AS n FROM logs GROUP BY 1) GROUP BY 1"""))
def l5(spark, sf):
    n, unit = L.auto_interval(datetime(2024, 1, 1), datetime(2024, 1, 30))
    return L.histogram(m.logs(spark, sf), n, unit)


@register("l7_fill_gaps", sql("logs", """
SELECT b AS bucket, n AS count FROM (
  SELECT unnest(range(date_trunc('hour', lo), hi, INTERVAL 1 HOUR)) AS b FROM (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM logs))
LEFT JOIN (SELECT date_trunc('hour', timestamp) AS t, count(*) AS n FROM logs WHERE severity_text = 'ERROR' GROUP BY 1) ON b = t"""))
def l7(spark, sf):
    logs = m.logs(spark, sf)
    hist = L.histogram(logs.filter("severity_text = 'ERROR'"), 1, "hour")
    return L.fill_gaps(hist, logs.agg(F.min("timestamp")).scalar(), logs.agg(F.max("timestamp")).scalar(), 1, "hour")


@register("l8_total_hits", sql("tokened_logs", f"SELECT count(*) AS total_count FROM tokened_logs WHERE {IS_PHRASE}"))
def l8(spark, sf):
    hits = m.logs(spark, sf).filter(text.match_phrase("body", PHRASE))
    return L.total_hits(L.histogram(hits, 1, "day"))


@register("l9_surrounding", sql("logs", """
, a AS (SELECT max(timestamp) AS t FROM logs WHERE severity_text = 'ERROR')
SELECT log_id, timestamp, 'before' AS place FROM (SELECT * FROM logs, a WHERE timestamp < t ORDER BY timestamp DESC, log_id DESC LIMIT 5)
UNION ALL SELECT log_id, timestamp, 'anchor' FROM (SELECT * FROM logs, a WHERE timestamp = t ORDER BY log_id LIMIT 1)
UNION ALL SELECT log_id, timestamp, 'after' FROM (SELECT * FROM logs, a WHERE timestamp > t ORDER BY timestamp, log_id LIMIT 5)"""))
def l9(spark, sf):
    logs = m.logs(spark, sf)
    anchor = logs.filter("severity_text = 'ERROR'").agg(F.max("timestamp")).scalar()
    return L.surrounding(logs, anchor).select("log_id", "timestamp", "place")


_CONDITIONS = [
    ("eq", "severity_text", "=", ["ERROR"], "severity_text = 'ERROR'"),
    ("ne", "severity_text", "!=", ["ERROR"], "severity_text <> 'ERROR'"),
    ("in", "service_name", "in", ["svc-1", "svc-2"], "service_name IN ('svc-1', 'svc-2')"),
    ("not_in", "service_name", "not in", ["svc-1", "svc-2"], "service_name NOT IN ('svc-1', 'svc-2')"),
    ("null", "attributes.zz", "is null", [], "json_extract(attributes, '$.zz') IS NULL"),
    ("not_null", "attributes.k", "is not null", [], "json_extract(attributes, '$.k') IS NOT NULL"),
    ("like", "body", "like", ["The%"], "body LIKE 'The%'"),
    ("not_like", "body", "not like", ["%the%"], "body NOT LIKE '%the%'"),
    ("between", "duration", "between", [100, 200], "duration BETWEEN 100 AND 200"),
    ("not_between", "duration", "not between", [100, 200], "NOT duration BETWEEN 100 AND 200"),
    ("match_any", "body", "match_any", [ANY], IS_ANY),
    ("match_all", "body", "match_all", [ALL], IS_ALL),
    ("match_phrase", "body", "match_phrase", [PHRASE], IS_PHRASE),
    ("match_phrase_prefix", "body", "match_phrase_prefix", [PREFIX], IS_PREFIX),
    ("match_regexp", "body", "match_regexp", ["tion[.]$"], "regexp_matches(body, 'tion[.]$')"),
]


@register("l10_filter_operators", sql("tokened_logs", "SELECT " + ",\n  ".join(
    f"count(*) FILTER ({q}) AS n_{name}" for name, _, _, _, q in _CONDITIONS) + " FROM tokened_logs"))
def l10(spark, sf):
    return m.logs(spark, sf).agg(*[
        F.count_if(L.condition(c, op, v)).alias(f"n_{name}") for name, c, op, v, _ in _CONDITIONS])


@register("l11_nested_path", sql("logs", """
SELECT CAST(json_extract_string(attributes, '$.k') AS INTEGER) AS k, count(*) AS count FROM logs GROUP BY 1"""))
def l11(spark, sf):
    return m.logs(spark, sf).groupBy(L.path("attributes.k").cast("int").alias("k")).agg(F.count("*").alias("count"))


@register("l12_search_any", sql("tokened_logs", f"""
SELECT count(*) FILTER ({IS_ANY} OR list_has_any(list_filter(string_split_regex(lower(service_name), '{SEP}+'), lambda x: x <> ''), ['token', 'error'])) AS words,
  count(*) FILTER ({IS_PHRASE}) AS phrase, count(*) FILTER (log_id = 42 OR list_has_any(toks, ['42'])) AS number FROM tokened_logs"""))
def l12(spark, sf):
    logs = m.logs(spark, sf)
    s = Search(logs)
    return logs.agg(F.count_if(s.keywords(ANY, ["body", "service_name", "log_id"])).alias("words"),
                    F.count_if(s.keywords(f'"{PHRASE}"', ["body", "service_name"])).alias("phrase"),
                    F.count_if(s.keywords("42", ["log_id", "body"])).alias("number"))


def _match_rows(spark, sf, predicate):
    return m.logs(spark, sf).filter(predicate).select("log_id", "trace_id")


def _match_sql(predicate):
    return sql("tokened_logs", f"SELECT log_id, trace_id FROM tokened_logs WHERE {predicate}")


@register("l13_match_any", _match_sql(IS_ANY))
def l13(spark, sf):
    return _match_rows(spark, sf, text.match_any("body", ANY))


@register("l14_match_all", _match_sql(IS_ALL))
def l14(spark, sf):
    return _match_rows(spark, sf, text.match_all("body", ALL))


@register("l15_match_phrase", _match_sql(IS_PHRASE))
def l15(spark, sf):
    return _match_rows(spark, sf, text.match_phrase("body", PHRASE))


@register("l16_match_phrase_prefix", _match_sql(IS_PREFIX))
def l16(spark, sf):
    return _match_rows(spark, sf, text.match_phrase_prefix("body", PREFIX))


@register("l17_match_regexp", sql("logs", "SELECT log_id, trace_id FROM logs WHERE regexp_matches(body, '[0-9]{3}[.][0-9]+')"))
def l17(spark, sf):
    return _match_rows(spark, sf, text.match_regexp("body", "[0-9]{3}[.][0-9]+"))


_CLAUSES = [
    ("and_not", f"{IS_ALL} AND severity_text <> 'ERROR'",
     lambda s: s.term("body", "the") & s.term("body", "and") & s.term("body", "that") & ~s.phrase("severity_text", "ERROR")),
    ("grouped", f"({IS_PHRASE} OR {IS_PREFIX}) AND service_name = 'svc-3'",
     lambda s: (s.phrase("body", PHRASE) | s.term("body", PREFIX, suffix=True)) & s.phrase("service_name", "svc-3")),
    ("exists", "trace_id IS NOT NULL AND trace_id <> ''", lambda s: s.exists("trace_id")),
    ("missing_field", "false", lambda s: s.term("nowhere", "x") | s.exists("nowhere")),
    ("at_least", "duration >= 250", lambda s: s.compare("duration", ">=", "250")),
    ("negated_at_least", "duration < 250", lambda s: s.compare("duration", ">=", "250", negate=True)),
    ("range", "duration BETWEEN 100 AND 200", lambda s: s.between("duration", "100", "200")),
    ("not_range", "NOT duration BETWEEN 100 AND 200", lambda s: s.between("duration", "100", "200", negate=True)),
    ("date_range", "timestamp BETWEEN '2024-01-05' AND '2024-01-07'", lambda s: s.between("timestamp", "2024-01-05", "2024-01-07")),
    ("number", "log_id = 77", lambda s: s.term("log_id", "77")),
    ("boolean", "severity_text = 'ERROR'", lambda s: s.term("is_error", "true")),
]


@register("l18_search_clauses", sql("tokened_logs", "SELECT " + ",\n  ".join(
    f"count(*) FILTER ({q}) AS n_{name}" for name, q, _ in _CLAUSES) + " FROM tokened_logs"))
def l18(spark, sf):
    logs = m.logs(spark, sf).withColumn("is_error", F.col("severity_text") == "ERROR")
    s = Search(logs)
    return logs.agg(*[F.count_if(build(s)).alias(f"n_{name}") for name, _, build in _CLAUSES])


@register("l19_search_implicit", sql("tokened_logs", """
SELECT count(*) FILTER (h) AS hits, count(*) FILTER (NOT h) AS others FROM (
  SELECT list_has_any(toks, ['error', 'token']) OR lower(severity_text) = 'error' AS h FROM tokened_logs)"""))
def l19(spark, sf):
    logs = m.logs(spark, sf)
    s = Search(logs)
    return logs.agg(F.count_if(s.anywhere(ANY)).alias("hits"), F.count_if(s.anywhere(ANY, negate=True)).alias("others"))


@register("l20_text_contains", sql("tokened_logs", """
SELECT count(*) FILTER (lower(body) LIKE '%tion') AS suffix, count(*) FILTER (list_contains(toks, 'token')) AS one_token,
  count(*) FILTER (list_has_all(toks, ['de', 'la']) AND contains(lower(body), 'de la')) AS several FROM tokened_logs"""))
def l20(spark, sf):
    return m.logs(spark, sf).agg(
        F.count_if(text.contains_text("body", "tion", prefix=True)).alias("suffix"),
        F.count_if(text.contains_text("body", "token")).alias("one_token"),
        F.count_if(text.contains_text("body", "de la")).alias("several"))


@register("l21_top_values", sql("logs", """
SELECT value, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM logs), 1) AS pct FROM (
  SELECT coalesce(json_extract_string(attributes, '$.k'), '') AS value FROM logs)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))
def l21_all(spark, sf):
    return L.top_values(m.logs(spark, sf), "attributes.k")


@register("l21_top_values_newest", sql("logs", """
SELECT value, count(*) AS count, round(count(*) * 100.0::DOUBLE / 500, 1) AS pct FROM (
  SELECT coalesce(json_extract_string(attributes, '$.k'), '') AS value FROM logs ORDER BY timestamp DESC, log_id DESC LIMIT 500)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))
def l21(spark, sf):
    return L.top_values(m.logs(spark, sf), "attributes.k", sample=500)


@register("l22_highlight", f"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{SEP}+|[^{SEP[1:]}+'),
  lambda x: CASE WHEN lower(x) IN ('the', 'token', 'de') THEN '<mark>' || x || '</mark>' ELSE x END), '') AS text_marked,
  replace(text, 'de la', '<mark>de la</mark>') AS phrase_marked FROM documents""")
def l22(spark, sf):
    docs = m.table(spark, sf, "documents").select("doc_id", "text", F.col("text").alias("phrase"))
    marked = L.highlight_hits(L.highlight_hits(docs, ["text"], "the token de"), ["phrase"], '"de la"')
    return marked.select("doc_id", "text_marked", "phrase_marked")
