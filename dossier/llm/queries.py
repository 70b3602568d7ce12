"""Registered queries of the operators, over whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, hmm, langid, licenses, negatives, pieces, repair, rtree, shards, simhash, spots, suffixes
from .common import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    found = pieces.encode(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_pieces", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "exact"
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by hyperdimensional profiles."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat earlier ones, and what is left."""
    return suffixes.report(table(spark, sf_dir, "documents"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return spots.fingerprints(table(spark, sf_dir, "documents"))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden Markov score of every document."""
    return hmm.score(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    placed = shards.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"), runs=True)
    return found.drop("blocks")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every positive of every anchor; every seventh row changes its label first."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of five-word shingles, and the component of its links at 0.8."""
    return rtree.near_duplicates(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the damage its keys ask for."""
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_suffix_array": op4_suffix_array,
    "op5_spotsigs": op5_spotsigs,
    "op6_hmm": op6_hmm,
    "op7_simhash": op7_simhash,
    "op8_extraction": op8_extraction,
    "op9_sharding": op9_sharding,
    "op10_licenses": op10_licenses,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ngram_jaccard": op12_ngram_jaccard,
    "op13_conversation_repair": op13_conversation_repair,
}

_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op3_decontamination": f"""
WITH items AS (SELECT item_id, {_W} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS m FROM items WHERE len(w) > 0),
spots AS (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized),
grams AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM spots),
docs AS (SELECT doc_id, {_W} AS w FROM documents),
lengths AS (SELECT DISTINCT m FROM grams),
places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs CROSS JOIN lengths),
windows AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM places),
hits AS (SELECT doc_id, i, m, item_id FROM windows JOIN grams USING (m, g)),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)),
n_hits AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n, 0) AS BIGINT) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN n_hits h ON h.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
""",
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                  CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
           FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS p FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.p AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 50 * p.p <= 100 * s.score AND 100 * s.score <= 95 * p.p
QUALIFY rank <= 3
""",
    "op12_ngram_jaccard": r"""
WITH RECURSIVE
worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded),
kinds AS (SELECT min(doc_id) AS kind, s, len(s) AS n, list(doc_id) AS ids FROM (SELECT doc_id, list_sort(s) AS s FROM sets) GROUP BY s),
flat AS (SELECT kind, n, hash(x) AS x FROM (SELECT kind, n, unnest(s) AS x FROM kinds WHERE n > 0)),
often AS (SELECT x, count(*) AS f FROM flat GROUP BY x),
placed AS (SELECT kind, n, x, row_number() OVER (PARTITION BY kind ORDER BY f, x) AS k FROM flat JOIN often USING (x)),
pairs AS (SELECT DISTINCT a.kind AS a, b.kind AS b
          FROM placed a JOIN placed b ON a.x = b.x AND a.kind < b.kind AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
               AND a.k <= a.n - (4 * a.n + 4) // 5 + 1 AND b.k <= b.n - (4 * b.n + 4) // 5 + 1),
measured AS (SELECT a, b, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS common
             FROM pairs JOIN kinds x ON x.kind = a JOIN kinds y ON y.kind = b),
links AS (SELECT a, b FROM measured WHERE 100 * common >= 80 * (total - common)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, CAST(k.n AS BIGINT) AS n_shingles, CASE WHEN k.n = 0 THEN s.doc_id ELSE coalesce(m, k.kind) END AS component_id
FROM (SELECT kind, n, unnest(ids) AS doc_id FROM kinds) k JOIN sets s USING (doc_id) LEFT JOIN least ON a = k.kind
""",
    "op13_conversation_repair": r"""
WITH RECURSIVE
crc_table AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                                      CAST(i AS BIGINT)) ORDER BY i) AS t FROM range(0, 256) r(i)),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
          FROM conversations),
keyed AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)),
                                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)),
                        4294967295) % 20 AS kind
          FROM given, crc_table),
kept AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
         FROM keyed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM kept),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
                lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) AS before,
                trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM placed),
judged AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate'
                          WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
inserts AS (FROM (VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
                         (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']),
                         (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']),
                         (1, 3, 10, 'II', ['user:', 'assistant:'])) x(s0, s1, more, letters, lines)),
steps AS (FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) x(s1, initial, s2)),
moves AS (
  SELECT j.conv_id, j.k, s AS s1, s AS s2, 2 AS more, 'D' AS letter, CAST([] AS VARCHAR[]) AS lines FROM judged j, range(0, 4) r(s)
  UNION ALL
  SELECT j.conv_id, j.k, s1, s2, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K', [role || ':' || text]
  FROM judged j JOIN steps ON role[1] = initial WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT j.conv_id, j.k, s1, s2, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R',
         [CASE initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
  FROM judged j JOIN steps ON initial <> 's' WHERE fault IN ('', 'truncated')),
ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS s, lpad('0', 9, '0') AS best, CAST([] AS VARCHAR[]) AS lines
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, k, s, min(best) AS best, arg_min(lines, best) AS lines FROM (
    SELECT w.conv_id, m.k, m.s2 AS s,
           lpad(CAST(CAST(w.best[1:9] AS INTEGER) + i.more + m.more AS VARCHAR), 9, '0') || w.best[10:] || i.letters || m.letter AS best,
           list_concat(list_concat(w.lines, i.lines), m.lines) AS lines
    FROM ways w JOIN inserts i ON i.s0 = w.s
         JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.k = w.k + 1 AND m.s1 = i.s1)
  GROUP BY conv_id, k, s),
sizes AS (SELECT c.conv_id, count(j.k) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
                 coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
          FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id
          GROUP BY c.conv_id),
ends AS (SELECT z.conv_id, min(best) AS best, arg_min(lines, best) AS lines FROM (
           SELECT z.conv_id, lpad(CAST(CAST(w.best[1:9] AS INTEGER) + i.more AS VARCHAR), 9, '0') || w.best[10:] || i.letters AS best,
                  list_concat(w.lines, i.lines) AS lines
           FROM sizes z JOIN ways w ON w.conv_id IS NOT DISTINCT FROM z.conv_id AND w.k = z.n
                JOIN inserts i ON i.s0 = w.s AND i.s1 IN (0, 3)) z GROUP BY z.conv_id)
SELECT z.conv_id, z.gaps, z.blank, z.duplicate, z.truncated, z.illegal, CAST(e.best[1:9] AS BIGINT) AS cost, e.best[10:] AS audit,
       sha256(array_to_string(e.lines, chr(10))) AS repaired_sha256
FROM sizes z JOIN ends e ON e.conv_id IS NOT DISTINCT FROM z.conv_id
""",
}
