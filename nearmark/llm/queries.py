"""The registered queries of the operators, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_wrapper, line_crf, line_dedup, minhash, mixing, quality_rules, secret_scan, substring_dedup, token_counts
from .common import read_table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item of which it holds a near copy."""
    return decontaminate.find_leaks(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return line_crf.score(docs, line_crf.train(spark, docs, read_table(spark, sf_dir, "labels")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line of each document."""
    return token_counts.count_sections(spark, read_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spark, read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, read_table(spark, sf_dir, "documents"), k=4)


def op7_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(spark, read_table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(read_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that loses sentences: their numbers, and the text that stays."""
    out = substring_dedup.remove_repeats(spark, read_table(spark, sf_dir, "documents"))
    return out.where("n_removed > 0").select("doc_id", "n_sentences", "n_removed", "removed", "kept_text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules.judge(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_mixing, op3_line_crf, op4_token_counts, op5_line_dedup, op6_minhash,
        op7_html_wrapper, op8_secret_scan, op9_substring_dedup, op10_quality_rules,
    )
}

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size, t,
         greatest(0.1::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) / greatest(length(t), 1)) AS q,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), t)), 1, 13) AS BIGINT) AS digits
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM s),
p AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS words, sum(w) OVER () AS all_w,
         row_number() OVER o AS pos,
         CAST(sum(cap) OVER o AS BIGINT) AS cap_sum, CAST(sum(w) OVER o AS BIGINT) AS w_sum
  FROM w WINDOW o AS (ORDER BY cap / CAST(w AS DOUBLE), source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, cap * (all_w - (w_sum - w)) <= w * (1.5::DOUBLE * words - (cap_sum - cap)) AS stops FROM p),
l AS (SELECT coalesce(max(pos) FILTER (WHERE stops), 0) AS pos, coalesce(max(cap_sum) FILTER (WHERE stops), 0) AS cap_sum, coalesce(max(w_sum) FILTER (WHERE stops), 0) AS w_sum FROM f),
g AS (
  SELECT f.source, f.source_size,
         CASE WHEN f.pos <= l.pos THEN CAST(f.cap AS DOUBLE)
              ELSE f.w * (1.5::DOUBLE * f.words - l.cap_sum) / (f.all_w - l.w_sum) END AS target
  FROM f, l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY -ln((CAST(k.digits AS DOUBLE) + 0.5) / 4503599627370496.0) / k.q, k.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN rest > 0 AND (upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < c.keeper, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

#: Links through shared shingles, components by following links; for small tables.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + least(3, len(w) - 1)) AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * p.both >= 80 * (x.n + y.n - p.both)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLE_SQL = {"op2_mixing": OP2_SQL, "op5_line_dedup": OP5_SQL, "op6_minhash": OP6_SQL}
