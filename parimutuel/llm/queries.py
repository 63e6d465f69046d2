"""Queries of the training-data operators, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, ctw, decontaminate, kernels, licenses, lines, media, paragraphs, prefix_trie, secrets, simhash, toxicity
from .common import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.trained(docs, read(spark, sf_dir, "labels")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.substring_dedup(read(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.language_scores(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_runs(read(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.languages(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"), prefix_trie.by_block(F.col("conv_id")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(read(spark, sf_dir, "embeddings"))


def trie_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op12_prefix_trie that SQL can say too; -1 where there is no parent."""
    nodes = op12_prefix_trie(spark, sf_dir).drop("fingerprint")
    return nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(-1)))


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_license_scan that SQL can say too; -1 where there is no place."""
    places = (F.coalesce(c, F.lit(-1)).alias(c) for c in ("first_word", "last_word"))
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", *places, "base_labels")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_secret_scan that SQL can say too."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_toxicity,
        op3_license_scan,
        op4_secret_scan,
        op5_media_columns,
        op6_substring_dedup,
        op7_simhash_near_dedup,
        op8_bpe,
        op9_lm_scoring,
        op10_line_dedup,
        op11_language_id,
        op12_prefix_trie,
        op13_vector_codes,
        trie_nodes,
        base_licenses,
        base_secrets,
    )
}

#: Runs of three trimmed, non-blank lines that occurred earlier, as maximal stretches.
LINE_DEDUP_SQL = """
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), numbered AS (
  SELECT doc_id, unnest(range(len(parts))) AS line, trim(unnest(parts), concat(' ', chr(9), chr(11), chr(12), chr(13))) AS content FROM split
), windows AS (
  SELECT doc_id, line, lead(line, 2) OVER w AS last, content AS a, lead(content, 1) OVER w AS b, lead(content, 2) OVER w AS c
  FROM numbered WHERE content <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line)
), placed AS (
  SELECT *, row_number() OVER k AS nth, first_value(doc_id) OVER k AS kept_doc_id, first_value(line) OVER k AS kept_line
  FROM windows WHERE last IS NOT NULL WINDOW k AS (PARTITION BY a, b, c ORDER BY doc_id, line)
), again AS (
  SELECT doc_id, line, last, kept_doc_id, kept_line, kept_line - line AS shift FROM placed WHERE nth > 1
), marked AS (
  SELECT *, CASE WHEN line <= max(last) OVER (PARTITION BY doc_id, kept_doc_id, shift ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM again
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, kept_doc_id, shift ORDER BY line ROWS UNBOUNDED PRECEDING) AS run FROM marked
)
SELECT doc_id, min(line) AS line, max(last) AS last, kept_doc_id, min(kept_line) AS kept_line
FROM runs GROUP BY doc_id, kept_doc_id, shift, run
"""

LICENSE_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, len(w) AS n_words, list_filter(range(len(w)), lambda i: w[i+1:i+4] = ['gnu', 'general', 'public', 'license']) AS gpl, list_filter(range(len(w)), lambda i: w[i+1:i+2] = ['apache', 'license']) AS apache,
    list_filter(range(len(w)), lambda i: w[i+1:i+2] = ['cc', 'by']) AS cc, list_filter(range(len(w)), lambda i: w[i+1:i+2] = ['mit', 'license']) AS mit FROM w
), f AS (
  SELECT *, gpl || apache || cc || mit AS places FROM p
)
SELECT doc_id, n_words, len(places) AS n_base, coalesce(list_min(places), -1) AS first_word, coalesce(list_max(places), -1) AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels FROM f
"""

SECRET_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: len(x) >= 24)) AS n_hex FROM t
"""

#: The checksum of a decimal text, byte by byte and bit by bit; conversations rebuilt; nodes as lists of turns.
TRIE_SQL = r"""
WITH convs AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM conversations WHERE conv_id IS NOT NULL
), sums AS (
  SELECT conv_id, list_reduce([4294967295::UBIGINT] || list_transform(range(1, len(name) + 1), lambda i: ascii(name[i])::UBIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS crc FROM convs
), takes AS (
  SELECT conv_id, CAST(xor(crc, 4294967295::UBIGINT) % 4 AS BIGINT) AS h FROM sums
), own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT own.conv_id, list_concat(coalesce(first.turns, [])[1:h], own.turns[h + 1:]) AS turns FROM own JOIN takes USING (conv_id) LEFT JOIN own first ON first.conv_id = own.conv_id - own.conv_id % 20
), members AS (
  SELECT conv_id, depth, turns[1:depth] AS prefix, len(turns) AS n FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT min(conv_id) AS conv_id, depth, prefix, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM members GROUP BY depth, prefix
), kids AS (
  SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), valued AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(prefix[-1].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS value FROM nodes LEFT JOIN kids USING (depth, prefix)
), of AS (
  SELECT members.conv_id AS member, depth, valued.conv_id, n_children, value FROM members JOIN valued USING (depth, prefix)
), below AS (
  SELECT DISTINCT a.conv_id, a.depth, b.conv_id AS sub, b.depth AS sub_depth, b.n_children, b.value FROM of a JOIN of b ON a.member = b.member AND a.depth <= b.depth
), summed AS (
  SELECT conv_id, depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(value) AS BIGINT) AS saved_tokens FROM below GROUP BY conv_id, depth
)
SELECT v.conv_id, v.depth, coalesce(p.conv_id, -1) AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN summed USING (conv_id, depth) LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.prefix = v.prefix[1:v.depth - 1]
"""


def codes_sql(rounds: int = 2) -> str:
    """Product codes with ``rounds`` rounds of refinement, each a few named tables."""
    nearest = "SELECT r, p, min(d) AS d, arg_min(e, d * 64 + e) AS e FROM (SELECT r, parts.p, e, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM parts JOIN {0} AS b ON b.p = parts.p) GROUP BY r, p"
    steps = ""
    for k in range(rounds):
        steps += f"""), a{k} AS MATERIALIZED ({nearest.format(f"b{k}")}
), m{k} AS MATERIALIZED (
  SELECT p, e, list(x ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(v[i])::DOUBLE / count(*)) AS BIGINT) AS x FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM a{k} JOIN parts USING (r, p)) GROUP BY p, e, i) GROUP BY p, e
), b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e
"""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, v
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), parts AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM (SELECT r, v, unnest(range(16)) AS p FROM kept)
), b0 AS MATERIALIZED (
  SELECT p, r - 1 AS e, v AS c FROM parts WHERE r <= 64
{steps}), coded AS MATERIALIZED ({nearest.format(f"b{rounds}")}
), rows AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM coded GROUP BY r
), book AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN rows USING (r), book
"""


ORACLE: dict[str, str] = {"op10_line_dedup": LINE_DEDUP_SQL, "op13_vector_codes": codes_sql(), "trie_nodes": TRIE_SQL, "base_licenses": LICENSE_SQL, "base_secrets": SECRET_SQL}
