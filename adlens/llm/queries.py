"""One registered query per operator of this subpackage, with its production parameters."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from adlens.llm import (blockjoin, curriculum, filteraudit, histogram, licenses, multiset, nra, packing, rans, simhash,
                        superminhash, toxicity, warc)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    return (warc.round_trip(_table(spark, sf, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op2_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return (simhash.near_duplicates(_table(spark, sf, "documents"), shingle=3, max_bits=2)
            .select("doc_id", "fingerprint", "component_id"))


def op3_rans_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return rans.round_trip(_table(spark, sf, "documents"), tokenizer_path(), end_id=2)


def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf, "documents")))


def op5_toxicity_crf(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model = toxicity.train(docs, _table(spark, sf, "labels"))
    return toxicity.tag(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                                            "predicted", F.size("spans").alias("n_spans"))


def op6_multiset_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return multiset.document_fingerprints(_table(spark, sf, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), tokenizer_path(), end_id=0, capacity=2048)


def op8_block_matrix_join(spark: SparkSession, sf: str) -> DataFrame:
    return blockjoin.nearest(_table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.context_limits(histogram.length_histogram(_table(spark, sf, "documents"), tokenizer_path()))


def op10_curriculum_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return curriculum.assigned(_table(spark, sf, "documents"))


def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op12_nra_search(spark: SparkSession, sf: str) -> DataFrame:
    return nra.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), k=20)


def op13_superminhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return (superminhash.near_duplicates(_table(spark, sf, "documents"), shingle=4, percent=80)
            .select("doc_id", "n_shingles", "component_id", "kept"))


def llm_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_warc_reassembly, op2_simhash_near_dedup, op3_rans_token_files, op4_license_scan,
                                    op5_toxicity_crf, op6_multiset_fingerprints, op7_best_fit_packing,
                                    op8_block_matrix_join, op9_length_histogram, op10_curriculum_mixing,
                                    op11_filter_audit, op12_nra_search, op13_superminhash_near_dedup)}


_NEAREST = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20"""


_PAGES = """
WITH p AS (
  SELECT page_id, sha1(encode(coalesce(html, ''))) AS payload_digest,
         octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
r AS (SELECT payload_digest, max(page_id) AS last_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last_id <> page_id THEN last_id END AS refers_to
FROM p LEFT JOIN r USING (payload_digest)"""


_MIX = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')) AS place,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, CAST(sum(size) * 3 AS DOUBLE) AS cap,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, CAST(number % 3 + 1 AS DOUBLE) AS weight FROM s),
o AS (
  SELECT *, row_number() OVER r AS turn,
         (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW r AS (ORDER BY cap / weight, number)),
t AS (
  SELECT source, source_size, number, least(cap, weight * (
    SELECT arg_min(level, turn) FROM o WHERE level * weight <= cap)) AS target FROM o),
l AS (
  SELECT d.*, t.number, t.source_size, t.target, coalesce(sum(size) OVER (
    PARTITION BY t.number ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, greatest(0, ceil((target - (start + size / 2.0)) / source_size)))
                 ELSE 1 END AS copies FROM l),
m AS (SELECT *, target - sum(copies * size) OVER (PARTITION BY number) AS miss FROM k),
g AS (
  SELECT *, abs(abs(miss) - size) AS gain, row_number() OVER (
    PARTITION BY number ORDER BY CASE WHEN abs(abs(miss) - size) < abs(miss)
      AND CASE WHEN miss > 0 THEN copies < 3 ELSE copies > 0 END THEN 0 ELSE 1 END,
      abs(abs(miss) - size), place, doc_id, start) AS nth FROM m),
n AS (
  SELECT doc_id, size, source_size, target, number, place, start, CAST(copies + CASE
    WHEN nth = 1 AND size > 0 AND gain < abs(miss) AND CASE WHEN miss > 0 THEN copies < 3 ELSE copies > 0 END THEN sign(miss) ELSE 0 END
    AS BIGINT) AS copies FROM g),
c AS (SELECT *, unnest(range(copies)) AS pass_no FROM n),
q AS (
  SELECT *, [0.0::DOUBLE, -0.5, 0.5][number % 3 + 1] AS s, CASE WHEN target > 0 THEN
    least(1.0, greatest(0.0, (start + size / 2.0::DOUBLE + pass_no * source_size) / target)) ELSE 0.0 END AS q FROM c),
p AS (
  SELECT *, row_number() OVER (ORDER BY position, place, pass_no, doc_id) AS turn FROM (
    SELECT *, least(1.0, 2 * q / ((1 - s) + sqrt(greatest((1 - s) * (1 - s) + 4 * s * q, 0.0)))) AS position FROM q)),
f AS (SELECT doc_id, place, start, sum(size) AS taken, min(position) AS first_position, min(turn) AS first_turn FROM p GROUP BY doc_id, place, start)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_position, first_turn
FROM n LEFT JOIN f USING (doc_id, place, start)"""


_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT part, quality, toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN labels USING (doc_id)),
m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad
  FROM f GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
         list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
p AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
    coalesce(sum(bad) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM m, (SELECT filter_order, step, bit, CAST(before AS INTEGER) AS before FROM s) GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM p"""


_SEARCH = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
c AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM d),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
p AS (
  SELECT doc_id, d.n AS n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) d
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, d.n, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * c.all_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, c.all_docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * c.all_docs) // c.all_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 20"""


_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS own FROM w),
n AS (SELECT doc_id, own, len(own) AS n_shingles FROM s),
e AS (SELECT doc_id, n_shingles, unnest(own) AS shingle FROM n),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n_shingles, b.n_shingles
  HAVING 100 * count(*) >= 80 * (a.n_shingles + b.n_shingles - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m ON m.a = n.doc_id"""


def llm_oracles() -> dict[str, str]:
    return {"op10_curriculum_mixing": _MIX, "op11_filter_audit": _AUDIT, "op12_nra_search": _SEARCH,
            "op13_superminhash_near_dedup": _NEAR, "op1_warc_reassembly": _PAGES, "op8_block_matrix_join": _NEAREST}
