"""Queries of the training-data operators (``opN_<name>``) and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadence.llm import (decontaminate, divergence, langid, line_dedup, mixing, near_dedup, packing, quality, repeats, token_counts, toxicity,
                         variants, warc)
from cadence.llm.common import scratch_path, table

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TOKENS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL["op2_decontaminate"] = rf"""
WITH b AS (SELECT item_id, {_TOKENS} AS tok FROM benchmark),
     bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, k, array_to_string(tok[i:i + k - 1], ' ') AS gram
            FROM (SELECT item_id, tok, least(len(tok), 10) AS k, unnest(range(1, len(tok) - least(len(tok), 10) + 2)) AS i
                  FROM b WHERE len(tok) > 0)),
     d AS (SELECT doc_id, {_TOKENS} AS tok FROM documents),
     dw AS (SELECT doc_id, k, i, array_to_string(tok[i:i + k - 1], ' ') AS gram
            FROM (SELECT doc_id, tok, k, unnest(range(1, len(tok) - k + 2)) AS i
                  FROM d, (SELECT DISTINCT k FROM bw) WHERE len(tok) >= k)),
     h AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.gram = bw.gram AND dw.k = bw.k),
     n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
     t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h WHERE item IS NOT NULL GROUP BY 1)
SELECT doc_id, CAST(len(tok) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_cascade(table(spark, sf_dir, "documents"), report=FEATURES)
    base = (F.col("verdict.n_words") < quality.MIN_WORDS) | (
        100 * F.col("verdict.n_repeat_words") > quality.MAX_REPEAT_PERCENT * F.col("verdict.n_words"))
    return judged.select("row.doc_id", *[F.col(f"verdict.{f}") for f in FEATURES],
                         base.alias("base_failed"), (F.col("verdict.kept") & ~base).alias("kept"))


_WS = r"[\x20\x09-\x0D]"
_QUALITY_CTE = rf"""
w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM g JOIN r USING (doc_id, g)) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '{_WS}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
      FROM w JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
"""
_KEPT = """NOT base_failed AND 100 * n_symbols <= 10 * n_words AND word_chars BETWEEN 2 * n_words AND 10 * n_words
       AND 100 * n_dup_lines <= 50 * n_lines"""
ORACLE_SQL["op8_quality_rules"] = rf"""
WITH {_QUALITY_CTE}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {_KEPT} AS kept FROM q
"""


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def mix_sql(docs: str) -> str:
    """CTEs from ``docs(doc_id, text, source)`` up to ``mixed``."""
    return rf"""
sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                 md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM {docs}),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
wts AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
               source_size * 2.0::DOUBLE AS cap FROM src),
lev AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
               coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
               sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM wts),
ful AS (SELECT *, cap * w_left <= (total - used) * w AS is_full FROM lev),
tgt AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
               (total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) * w / sum(CASE WHEN NOT is_full THEN w END) OVER () END AS target FROM ful),
bud AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM tgt),
cuts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) - epochs * source_size ELSE 0 END AS rest FROM bud),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS start FROM sized),
mixed AS (SELECT doc_id, run.size, c.source_size, c.target, run.source,
                 CAST(c.epochs * run.size + least(greatest(c.rest - start, 0), run.size) AS BIGINT) AS taken
          FROM run JOIN cuts c ON run.source IS NOT DISTINCT FROM c.source)
"""


ORACLE_SQL["op9_mix_sources"] = f"WITH {mix_sql('documents')} SELECT doc_id, size, source_size, target, taken FROM mixed"


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs, learned)
    return out.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "pred.lang_pred", "pred.score")


@query
def op5_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    read = warc.read_archives(spark, path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


ORACLE_SQL["op5_warc_roundtrip"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     r AS (SELECT h, max(page_id) AS response_id FROM p GROUP BY 1),
     d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> (35 - 5 * i)) & 31 AS INT) + 1, 1), '' ORDER BY g, i) AS digest
           FROM (SELECT h, g, CAST('0x' || substr(h, 1 + 10 * g, 10) AS BIGINT) AS v
                 FROM (SELECT DISTINCT h FROM p), (SELECT unnest(range(4)) AS g)), (SELECT CAST(unnest(range(8)) AS INT) AS i) GROUP BY 1)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response_id THEN response_id END AS refers_to, 'ok' AS status
FROM p JOIN r USING (h) JOIN d USING (h)
"""


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(token_counts.length_histogram(table(spark, sf_dir, "documents")))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # headings and the like stay; (0, 0) removes every repeated unit (README gives both figures)
    out = line_dedup.dedup_units(table(spark, sf_dir, "documents"), short=line_dedup.SHORT_UNITS)
    return out.select("row.doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), "removed", "kept_text")


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
     o AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
     k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(*) >= {divergence.MIN_DOCS}),
     v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
     c AS (SELECT lang, source, term, sum(n) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
     g AS (SELECT DISTINCT lang, source FROM d),
     f AS (SELECT g.lang, g.source, k.term, CAST(coalesce(n, 0) AS HUGEINT) AS n
           FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     p AS (SELECT lang, source, term, n, 1 + ({divergence.SCALE} * (n + {divergence.SMOOTH})) // (sum(n) OVER (PARTITION BY lang, source) + {divergence.SMOOTH} * v) AS p
           FROM f JOIN v USING (lang)),
     l AS (SELECT lang, term, 1 + ({divergence.SCALE} * (n + {divergence.SMOOTH})) // (sum(n) OVER (PARTITION BY lang) + {divergence.SMOOTH} * v) AS q
           FROM (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL) JOIN v USING (lang)),
     s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
     term AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
     x AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
           UNION ALL
           SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM x WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_sample(docs, table(spark, sf_dir, "labels")))
    out = toxicity.score(docs, model)
    return out.select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
