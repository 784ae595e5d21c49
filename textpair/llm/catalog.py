"""One query per training-data operator over the shared tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpair.llm import (
    collocations, conversation_repair, hamming_search, language_id, license_scan, minhash, mixing, packing, quality, secret_scan, spotsigs, url_rules, warc,
)
from textpair.llm.common import read_table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(read_table(spark, sf_dir, "documents")))


@query
def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(read_table(spark, sf_dir, "documents"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.shares(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read_table(spark, sf_dir, "pages"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), special_tokens=True)


@query
def op7_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return hamming_search.nearest(vectors, F.col("vec_id") % hamming_search.QUERY_EVERY == 0)


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(read_table(spark, sf_dir, "conversations"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read_table(spark, sf_dir, "documents")))


LLM_ORACLES["op4_url_rules"] = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), base(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), names(name) AS (VALUES ('casino-win'), ('cheap-pills'), ('spam-farm')
), tops(top) AS (VALUES ('com'), ('net'), ('org')
), listed AS (SELECT name || '.example.' || top AS rhost FROM names, tops
), hit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM split JOIN base ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
), list_hit AS (
  SELECT page_id, max(rhost || '/') AS list_rule
  FROM split JOIN listed ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, '/') GROUP BY page_id
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN list_rule IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, list_rule
FROM split LEFT JOIN hit USING (page_id) LEFT JOIN list_hit USING (page_id)
"""

LLM_ORACLES["op5_warc"] = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages
), based AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    ((CAST('0x' || substr(hex, 1 + (i // 4) * 5, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INTEGER), 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex) AS first_id
  FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM based
"""

LLM_ORACLES["op7_hamming_search"] = """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(v > 0 AS INTEGER)) AS bits FROM embeddings WHERE embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda p: CAST(p[1] <> p[2] AS INTEGER))) AS INTEGER) AS distance
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), placed AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
  FROM pairs
)
SELECT * FROM placed WHERE rank <= 10
"""

LLM_ORACLES["op9_minhash"] = """
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda w: w <> '') AS ws
  FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle
  FROM worded
), sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS hits
  FROM shingled x JOIN shingled y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * hits >= 85 * (x.n + y.n - hits)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM edges UNION SELECT reached.doc_id, edges.b FROM reached JOIN edges ON edges.a = reached.other
), components AS (SELECT doc_id, min(other) AS root FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN components USING (doc_id)
"""

LLM_ORACLES["op11_conversation_repair"] = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS damage
  FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE damage <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM hurt
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \\t-\\r]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
    WHEN regexp_extract(text, '([^ \\t-\\r])[ \\t-\\r]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) || substr(role, 1, 1) AS pair
  FROM placed
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
  FROM faulty GROUP BY conv_id
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, {'cost': 0, 'audit': ''} AS q0, CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR)) AS q1,
    {'cost': 2, 'audit': 'I'} AS q2, {'cost': 4, 'audit': 'II'} AS q3
  FROM told
  UNION ALL
  SELECT conv_id, place, q0, q1, q2, list_min([q3, {'cost': q2.cost + 2, 'audit': q2.audit || 'I'}]) AS q3
  FROM (
    SELECT conv_id, place, q0, q1, q3, list_min([q2, {'cost': q0.cost + 2, 'audit': q0.audit || 'I'},
      CASE WHEN q1 IS NOT NULL THEN {'cost': q1.cost + 2, 'audit': q1.audit || 'I'} END, {'cost': q3.cost + 2, 'audit': q3.audit || 'I'}]) AS q2
    FROM (
      SELECT f.conv_id, f.place, {'cost': q0.cost + 3, 'audit': q0.audit || 'D'} AS q0,
        list_min([CASE WHEN q1 IS NOT NULL THEN {'cost': q1.cost + 3, 'audit': q1.audit || 'D'} END,
          CASE WHEN keep AND i = 's' THEN {'cost': q0.cost + x, 'audit': q0.audit || 'K'} END]) AS q1,
        list_min([{'cost': q2.cost + 3, 'audit': q2.audit || 'D'},
          CASE WHEN keep THEN {'cost': q0.cost + x + 2, 'audit': q0.audit || 'R'} END,
          CASE WHEN keep AND q1 IS NOT NULL THEN {'cost': q1.cost + x + 2, 'audit': q1.audit || 'R'} END,
          CASE WHEN keep THEN {'cost': q3.cost + x + 2, 'audit': q3.audit || 'R'} END,
          CASE WHEN keep AND i = 'u' THEN {'cost': q0.cost + x, 'audit': q0.audit || 'K'} END,
          CASE WHEN keep AND i = 'u' AND q1 IS NOT NULL THEN {'cost': q1.cost + x, 'audit': q1.audit || 'K'} END,
          CASE WHEN keep AND i = 'u' THEN {'cost': q3.cost + x, 'audit': q3.audit || 'K'} END]) AS q2,
        list_min([{'cost': q3.cost + 3, 'audit': q3.audit || 'D'},
          CASE WHEN keep THEN {'cost': q2.cost + x + 2, 'audit': q2.audit || 'R'} END,
          CASE WHEN keep AND i = 'a' THEN {'cost': q2.cost + x, 'audit': q2.audit || 'K'} END]) AS q3
      FROM walk JOIN (
        SELECT conv_id, place, substr(role, 1, 1) AS i, fault NOT IN ('b', 'd') AS keep, CAST(fault = 't' AS INTEGER) AS x FROM faulty
      ) f ON f.conv_id = walk.conv_id AND f.place = walk.place + 1
    )
  )
), solved AS (
  SELECT conv_id, list_min([q0, q3]) AS best FROM walk JOIN told USING (conv_id) WHERE place = n
), letters AS (
  SELECT conv_id, i AS pos, substr(best.audit, i, 1) AS letter,
    i - length(replace(substr(best.audit, 1, i), 'I', '')) AS inserts, length(replace(substr(best.audit, 1, i), 'D', '')) AS kept
  FROM (SELECT conv_id, best, unnest(range(1, length(best.audit) + 1)) AS i FROM solved)
), turns AS (
  SELECT letters.conv_id, pos, letter, kept - max(CASE WHEN kept = 1 AND letter = 'K' AND starts_with(role, 's') THEN 1 ELSE 0 END) OVER (PARTITION BY letters.conv_id) AS nth,
    role, text
  FROM letters LEFT JOIN faulty ON letter <> 'I' AND faulty.conv_id = letters.conv_id AND faulty.place = pos - inserts
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS body
  FROM turns WHERE letter <> 'D' GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(best.cost AS BIGINT), 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told USING (conv_id) LEFT JOIN solved USING (conv_id) LEFT JOIN repaired USING (conv_id)
"""

LLM_ORACLES["op12_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded
), phrases AS (
  SELECT lang, phrase, k, count(*) AS f
  FROM (SELECT lang, k, CASE WHEN i + k - 1 <= len(ws) THEN array_to_string(ws[i:i + k - 1], ' ') END AS phrase FROM grams, range(1, 5) t(k))
  WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
), totals AS (SELECT lang, sum(len(ws)) AS n FROM worded GROUP BY lang
), cuts AS (
  SELECT lang, phrase, k, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM phrases WHERE k >= 2
), scored AS (
  SELECT c.lang, c.phrase, c.k, a, cut, x.f AS l, y.f AS r, (2000000 * CAST(a AS HUGEINT)) // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
    JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')
), weakest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored
), inner_phrases AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, f, k, string_split(phrase, ' ') AS ws, m, unnest(range(1, k - m + 2)) AS i FROM phrases, range(2, 4) t(m) WHERE k > m) GROUP BY ALL
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest w LEFT JOIN inner_phrases USING (lang, phrase) WHERE place = 1 AND (longer IS NULL OR 100 * longer < 80 * a)
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
