"""One query for each operator: whole tables in, whole results out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlens.llm import (ball_tree, cnn, decontaminate, html_text, line_dedup, mixing, ngram_join, quality,
                          sanitise, spotsigs, tokens, warc, whitening)
from viewlens.llm.common import documents
from viewlens.llm.registry import register
from viewlens.session import scratch_path


OP7_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i+4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
         WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS r FROM documents
          UNION SELECT link.a, reach.r FROM reach JOIN link ON link.b = reach.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT node, min(r) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id
"""


@register("op7_ngram_jaccard_join", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_links(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@register("op2_spaced_seed_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.flag(documents(spark, sf_dir), tests)


@register("op6_information_theoretic_sanitisation")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.find(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(of(i).alias(f"n_{k}") for i, k in enumerate(sanitise.KINDS[:4])),
                        F.sha2(sanitise.joined(F.col("base")), 256).alias("base_sha256"),
                        sanitise.joined(F.col("spans")).alias("spans"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (SELECT source, n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
r AS (
  SELECT *, (SELECT sum(n) * 1.5 FROM w)::DOUBLE AS goal,
    coalesce(sum(2 * n) OVER before, 0)::DOUBLE AS held, (SELECT sum(w) FROM w) - coalesce(sum(w) OVER before, 0) AS left_w
  FROM w WINDOW before AS (ORDER BY n::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 2.0::DOUBLE * n * left_w <= w * (goal - held) AS fully FROM r),
t AS (
  SELECT source, n, CASE WHEN fully THEN n::DOUBLE * 2 ELSE w::DOUBLE * ((SELECT any_value(goal) FROM c)
    - (SELECT coalesce(sum(2 * n), 0)::DOUBLE FROM c WHERE fully)) / (SELECT sum(w)::DOUBLE FROM c WHERE NOT fully) END AS target
  FROM c),
m AS (
  SELECT d.doc_id, d.source, d.size, t.n AS source_size, t.target, CASE WHEN t.n > 0 THEN t.target / t.n ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT
      / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT m.doc_id, m.size, m.source_size, m.target,
  m.size * CAST(floor(m.rate) + CASE WHEN (m.u + b.k / 32.0::DOUBLE) - floor(m.u + b.k / 32.0::DOUBLE)
    < m.rate - floor(m.rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM m JOIN (
  SELECT source, k FROM (
    SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(taken - target), k) AS nth FROM (
      SELECT source, target, k, sum(size * CAST(floor(rate) + CASE WHEN (u + k / 32.0::DOUBLE)
        - floor(u + k / 32.0::DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT))::DOUBLE AS taken
      FROM m, (SELECT unnest(range(0, 32)) AS k) GROUP BY source, target, k))
  WHERE nth = 1) b ON m.source IS NOT DISTINCT FROM b.source
"""


@register("op9_source_mixture", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS f FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((('0x' || substr(p.h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = f.f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f.f THEN f.f END AS refers_to
FROM p JOIN f ON p.h = f.h
"""


@register("op1_warc_chunked_records", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op5_token_id_packs")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read(spark, path)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@register("op3_convolutional_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return cnn.score(docs, labels(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")


@register("op4_tree_scoring_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@register("op8_random_indexing_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.score(docs, labels(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")


@register("op10_spotsigs_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.with_next(documents(spark, sf_dir))


@register("op11_spectrum_slicing_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
df AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
       FROM tf, s GROUP BY w, docs),
m AS (SELECT doc_id, 100 - 90 + (90 * len(t) * docs) // words AS m FROM d, s WHERE len(t) > 0),
r AS (SELECT q.item_id, tf.doc_id, CAST(sum(weight * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
      FROM q JOIN tf ON tf.w = q.w JOIN df ON df.w = q.w JOIN m ON m.doc_id = tf.doc_id GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
WHERE rank <= 10
"""


@register("op12_ball_tree_lexical_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.search(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = """
WITH l AS (
  SELECT doc_id, pos, ln[pos] AS line, translate(trim(ln[pos], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ln, unnest(range(1, len(ln) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ln FROM documents))),
f AS (SELECT k, min(doc_id) AS f FROM l WHERE length(k) >= 10 GROUP BY k),
m AS (SELECT l.*, coalesce(l.doc_id <> f.f, false) AS gone FROM l LEFT JOIN f ON f.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@register("op13_line_keep_bitmaps", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
