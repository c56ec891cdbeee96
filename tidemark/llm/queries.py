"""The registered queries of this subpackage, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (bit_sliced_search, common, conversation_repair, language_id, masked_ranking, near_duplicates, packing,
                          permutation_index, pieces, pseudonyms, repeat_groups, substring_dedup, toxicity, vector_links)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op10_language_id")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~common.held_out("doc_id")))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", common.held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op8_pseudonyms")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key="documents")


@query("op3_packing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_pieces")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


WORDS = r"[^\x20\x09-\x0D]+"


@query("op7_near_duplicates", sql=rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.v = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
""")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf, "documents"), width=3, percent=85)


@query("op1_substring_dedup", sql=rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
e AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w WHERE len(w) >= 20)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM e) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS k FROM r),
kept AS (SELECT x.doc_id, x.k, x.word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w) x ANTI JOIN gone USING (doc_id, k))
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, len(w.w)::BIGINT - count(k.k) AS n_removed, sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.k), '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id GROUP BY w.doc_id, w.w
""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, window=20, kept_text=False).drop("text")


@query("op5_repeat_groups", sql="""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, s, md5(b[s:s + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS s FROM d WHERE octet_length(b) >= 400)),
r AS (SELECT doc_id, s FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
n AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, min(s) AS a, max(s) + 399 AS e FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM n) GROUP BY doc_id, g),
p AS (SELECT doc_id, a, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM i
  UNION ALL SELECT d.doc_id, octet_length(b) + 1, coalesce(max(e), 0) + 1, octet_length(b) FROM d LEFT JOIN i ON i.doc_id = d.doc_id GROUP BY d.doc_id, b),
k AS (SELECT p.doc_id, string_agg(CASE WHEN t >= f THEN hex(b[f:t]) ELSE '' END, '' ORDER BY a) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(sum(e - a + 1), 0)::BIGINT AS n_removed, count(a) AS n_spans,
  sha256(unhex(any_value(kept))) AS kept_sha256
FROM d LEFT JOIN i ON i.doc_id = d.doc_id JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id, b
""")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return repeat_groups.remove_repeats(docs, window=400, kept=False).drop("text")


@query("op4_bit_sliced_search", sql="""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS d, len(x) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM e q JOIN e c ON q.d = c.d AND q.n = c.n AND q.vec_id <> c.vec_id
      WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return bit_sliced_search.top_k(table(spark, sf, "embeddings"), k=20, every=20)


@query("op9_vector_links", sql="""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.v = l.a),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT e.vec_id, count(l.b) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN m ON m.v = e.vec_id LEFT JOIN l ON l.a = e.vec_id GROUP BY e.vec_id, m.c
""")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return vector_links.vector_links(table(spark, sf, "embeddings"), threshold=0.93)


@query("op2_toxicity")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    network = toxicity.fit(docs, labels.filter(~common.held_out("doc_id")))
    scored = toxicity.score(docs, network)
    return scored.select("doc_id", common.held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op11_conversation_repair", sql=r"""
WITH RECURSIVE
keys AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key,
  coalesce(role, ' ') AS r, coalesce(text, ' ') AS t FROM conversations),
harm AS (SELECT *, xor(4294967295, list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT),
  lambda c, b: list_reduce(range(8), lambda x, j: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295)) % 20 AS h FROM keys),
rows AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE r END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text
  FROM harm, (VALUES (1), (2)) AS c(copy) WHERE h <> 0 AND (copy = 1 OR h = 3)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM ordered),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
n AS (SELECT c.conv_id, count(f.k) AS rows, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0) AS gaps,
  count(*) FILTER (f.fault = 'blank') AS blank, count(*) FILTER (f.fault = 'duplicate') AS duplicate,
  count(*) FILTER (f.fault = 'truncated') AS truncated,
  count(*) FILTER (f.before IS NOT NULL AND f.before || f.role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
-- Survivors before row k + 1: start, after system, user, assistant. c is the cost, a the audit, o the repaired lines.
v AS (SELECT conv_id, 0::BIGINT AS k, {'c': 0, 'a': '', 'o': []::VARCHAR[]} AS p, {'c': 999999999, 'a': '', 'o': []::VARCHAR[]} AS s,
    {'c': 999999999, 'a': '', 'o': []::VARCHAR[]} AS u, {'c': 999999999, 'a': '', 'o': []::VARCHAR[]} AS e FROM n
  UNION ALL
  SELECT conv_id, k + 1, {'c': p.c + 4, 'a': p.a || 'D', 'o': p.o},
    least({'c': s.c + 4, 'a': s.a || 'D', 'o': s.o}, {'c': p.c + CASE WHEN role[1] = 's' THEN keep ELSE 999999999 END, 'a': p.a || 'K', 'o': list_append(p.o, line)}),
    least({'c': u2.c + 4, 'a': u2.a || 'D', 'o': u2.o}, {'c': x.c + keep + CASE WHEN role[1] = 'u' THEN 0 ELSE 3 END,
      'a': x.a || CASE WHEN role[1] = 'u' THEN 'K' ELSE 'R' END, 'o': list_append(x.o, CASE WHEN role[1] = 'u' THEN line ELSE 'user:' || text END)}),
    least({'c': e2.c + 4, 'a': e2.a || 'D', 'o': e2.o}, {'c': u2.c + keep + CASE WHEN role[1] = 'a' THEN 0 ELSE 3 END,
      'a': u2.a || CASE WHEN role[1] = 'a' THEN 'K' ELSE 'R' END, 'o': list_append(u2.o, CASE WHEN role[1] = 'a' THEN line ELSE 'assistant:' || text END)})
  FROM (SELECT *, least(p, s, e2) AS x FROM (SELECT *, least(e, {'c': u2.c + 3, 'a': u2.a || 'I', 'o': list_append(u2.o, 'assistant:')}) AS e2
    FROM (SELECT v.*, f.role, f.text, f.role || ':' || f.text AS line,
      CASE f.fault WHEN '' THEN 0 WHEN 'truncated' THEN 3 ELSE 999999999 END AS keep,
      least(v.u, {'c': y.c + 3, 'a': y.a || 'I', 'o': list_append(y.o, 'user:')}) AS u2
      FROM (SELECT *, least(p, s, e) AS y FROM v) v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.k = v.k + 1)))),
last AS (SELECT v.conv_id, least(v.p, v.e, {'c': u2.c + 3, 'a': u2.a || 'I', 'o': list_append(u2.o, 'assistant:')}) AS best
  FROM (SELECT *, least(u, {'c': least(p, s, e).c + 3, 'a': least(p, s, e).a || 'I', 'o': list_append(least(p, s, e).o, 'user:')}) AS u2 FROM v) v
  JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id AND n.rows = v.k)
SELECT n.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, best.c::BIGINT AS cost, best.a AS audit,
  sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM n JOIN last ON n.conv_id IS NOT DISTINCT FROM last.conv_id
""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damage(table(spark, sf, "conversations")))


@query("op12_masked_ranking", sql=r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY 1),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, g GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN w USING (term) JOIN d USING (doc_id), g GROUP BY 1, 2)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return masked_ranking.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=50)


@query("op13_permutation_index")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf, "embeddings"), k=20, every=20)
