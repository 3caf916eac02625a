"""The corpus operators as queries, each over its whole table, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescope.llm.byte_repeats import byte_repeats
from rolescope.llm.common import digest, table
from rolescope.llm.decontaminate import decontaminate, digests
from rolescope.llm.dual_tree import ranked
from rolescope.llm.fourier_quality import quality_scores
from rolescope.llm.html_content import ContentModel, extract_main
from rolescope.llm.infill import infill, restored
from rolescope.llm.jaccard_join import jaccard_components
from rolescope.llm.labelled_pages import PAGES
from rolescope.llm.line_quality import line_quality
from rolescope.llm.log_templates import line_templates
from rolescope.llm.mixing import mix
from rolescope.llm.secrets import secret_spans
from rolescope.llm.token_counts import token_counts
from rolescope.llm.url_graph import url_verdicts, verdict_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function
    return register


@query("op1_line_quality", r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l
  FROM documents),
grams AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n
  FROM (SELECT r, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g
        FROM words WHERE len(w) > 2)),
repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS p FROM grams WHERE n > 1) GROUP BY r),
lines AS (
  SELECT DISTINCT source, text, trim(regexp_replace(lower(line), '[0-9]+', '0', 'g'), ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT source, text, unnest(l) AS line FROM words)),
sized AS (SELECT source, text, line, len(string_split(line, ' ')) AS n,
  ('0x' || substr(md5(text), 1, 15))::BIGINT AS body, count(*) OVER (PARTITION BY source, line) AS bodies FROM lines),
owned AS (SELECT *, min(body) OVER (PARTITION BY source, line) AS owner FROM sized),
spent AS (SELECT source, text, sum(n) AS line_words, sum(n) FILTER (bodies > 20 AND body <> owner) AS common
  FROM owned GROUP BY ALL)
SELECT doc_id, len(w) AS n_words, length(regexp_replace(w_text, '[ \t\n\x0B\f\r]', '', 'g')) AS word_chars,
  length(regexp_replace(w_text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(repeats.n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(repeats.n, 0) > 50 * len(w) AS base_failed,
  coalesce(line_words, 0)::BIGINT AS line_words, coalesce(common, 0)::BIGINT AS common_words,
  NOT (len(w) < 50 OR 100 * coalesce(repeats.n, 0) > 50 * len(w))
    AND coalesce(line_words, 0) - coalesce(common, 0) >= 0.2 * coalesce(line_words, 0) AS kept
FROM (SELECT *, text AS w_text FROM words) d LEFT JOIN repeats USING (r)
LEFT JOIN spent ON spent.source IS NOT DISTINCT FROM d.source AND spent.text = d.text
""")
def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"))


@query("op2_secret_ownership", r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT r, doc_id, source, 0 AS no, 'assign' AS kind, 6 AS least, string_split_regex(text, p) AS gaps,
    regexp_extract_all(text, p, 0) AS hits, regexp_extract_all(text, p, 2) AS vals
  FROM docs, (SELECT '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p)
  UNION ALL SELECT r, doc_id, source, 1, 'access', 20, string_split_regex(text, p), regexp_extract_all(text, p), regexp_extract_all(text, p)
  FROM docs, (SELECT 'AKIA[A-Z0-9]+' AS p)
  UNION ALL SELECT r, doc_id, source, 2, 'hex', 24, string_split_regex(text, p), regexp_extract_all(text, p), regexp_extract_all(text, p)
  FROM docs, (SELECT '[0-9a-f]+' AS p)
  UNION ALL SELECT r, doc_id, source, 3, 'loose', 32, string_split_regex(text, p), regexp_extract_all(text, p), regexp_extract_all(text, p)
  FROM docs, (SELECT '[A-Za-z0-9+/_-]+' AS p)),
each AS (
  SELECT r, doc_id, source, no, kind, least, unnest(range(len(hits))) AS i, unnest(gaps[:len(hits)]) AS gap,
    unnest(hits) AS hit, unnest(vals) AS val FROM parts),
placed AS (
  SELECT *, (sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY i))::BIGINT AS stop FROM each),
good AS (
  SELECT *, stop - length(hit) AS start FROM placed WHERE length(val) >= least AND (no < 3 OR (
    regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[0-9].*[0-9].*[0-9]')))),
owned AS (SELECT val, count(DISTINCT coalesce(source, chr(0))) > 1 OR count(DISTINCT (doc_id, source)) > 10 AS copied
  FROM good GROUP BY val),
told AS (
  SELECT r, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) FILTER (no < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) FILTER (no < 3 OR NOT copied) AS spans,
    count(*) FILTER (no < 3 AND NOT copied) AS n_live, count(*) FILTER (no < 3 AND copied) AS n_example
  FROM good JOIN owned USING (val) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN told USING (r)
""")
def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


@query("op3_quota_mix")
def op3_quota_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


@query("op5_benchmark_windows", r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM items WHERE len(w) > 0)),
grams AS (
  SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs, (SELECT DISTINCT k FROM windows))),
hits AS (SELECT r, grams.k, p, item FROM grams JOIN windows ON grams.k = windows.k AND grams.g = windows.g),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n, array_to_string(list_sort(list_distinct(list(item))), ',') AS names FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
""")
def op5_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op6_link_trust", verdict_sql())
def op6_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


@query("op9_line_templates")
def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines, and the hash of what is left of each document."""
    return line_templates(table(spark, sf_dir, "documents")).select(
        "doc_id", *[F.col(f"__{name}").alias(name) for name in ("n_lines", "n_dropped", "n_words_dropped")], digest(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


@query("op8_main_text")
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"), ContentModel(PAGES))


@query("op10_byte_repeats")
def op10_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_jaccard_components")
def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("component_key")


@query("op13_infill", r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM docs),
formed AS (
  SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
    THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM drawn),
cut AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
""")
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill(table(spark, sf_dir, "documents")).withColumns({
        "output_sha256": digest(F.col("output")), "restored_sha256": digest(restored(F.col("output"), F.col("form"))),
    }).drop("output")


@query("op11_fourier_quality")
def op11_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_dual_tree", r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark WHERE text IS NOT NULL),
totals AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs WHERE len(w) > 0),
counts AS (
  SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM docs),
held AS (SELECT r, doc_id, n, term, count(*) AS tf FROM counts WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term, n_docs),
scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM held JOIN weights USING (term) JOIN items USING (term), totals GROUP BY ALL),
ranks AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 50
""")
def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
