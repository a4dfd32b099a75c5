"""The operators' queries over the tables of a folder, and the same in DuckDB's SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import quality, toxicity
from quarry.llm.divergence import divergence
from quarry.llm.fingerprint import with_next
from quarry.llm.html_text import extract
from quarry.llm.line_dedup import apply_bitmaps, keep_bitmaps
from quarry.llm.mixing import mix
from quarry.llm.negatives import hard_negatives
from quarry.llm.neighbours import nearest
from quarry.llm.packing import pack, pieces
from quarry.llm.rules import judged
from quarry.llm.sample import remainder
from quarry.llm.simhash import hex_of, near_duplicates
from quarry.llm.suffix_dedup import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document and of its edit by half the next document, and how alike they are."""
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix at target weights 5, 2, 1 takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left of each document when those found in ten documents or more go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document for toxicity, from a model that never saw the labels of the rows held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = toxicity.scores(docs, toxicity.train(docs, labels, max_rows=10_000))
    held = remainder(F.col("doc_id"), 3) == 1
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the bytes that strings of 100 bytes seen before cover."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of each document and its component of near duplicates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def tokenizer_path(name: str) -> str:
    """The path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, and the sequence of 2048 and the place in it that each one gets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(pieces(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048), capacity=2048)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document for quality, from a model that never saw the labels of the rows held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = quality.scores(docs, quality.train(docs, labels, max_rows=10_000))
    held = remainder(F.col("doc_id"), 5) == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of each whose id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), is_query=F.col("vec_id") % 100 == 0, k=10)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each language's sources are apart in their words, and the words that tell each source."""
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"), least=30, top=50)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the positives of each vector whose id is divisible by 50; every seventh label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(rows, is_anchor=F.col("vec_id") % 50 == 0, positives=5, negatives=3)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for quality rules of each document, and whether it passes the base rule and the certified cutoffs."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = judged(docs, labels, limit=LIMIT, error=ERROR, gain=GAIN)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SPACES_SQL = r"chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"

OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR || 'mix') AS key
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
  FROM docs GROUP BY source
), w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sizes
), r AS (
  SELECT *, (3 * source_size)::DOUBLE AS most, (3 * source_size)::DOUBLE / weight AS ratio FROM w
), l AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER before, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
  FROM r WINDOW before AS (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
  SELECT level AS water FROM l WHERE ratio >= level ORDER BY ratio, i LIMIT 1
), goals AS (
  SELECT source, source_size, least(most, coalesce(weight * (SELECT water FROM final), most)) AS target FROM l
), served AS (
  SELECT d.*, g.source_size, g.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS served
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
), copies AS (
  SELECT *, (copy * source_size + served)::DOUBLE / target AS finish
  FROM served CROSS JOIN (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0
), runs AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, copy ROWS UNBOUNDED PRECEDING) AS run FROM copies
), taken AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM runs WHERE run <= (SELECT sum(size) FROM docs) GROUP BY doc_id
)
SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(t.taken, 0) AS taken
FROM served s LEFT JOIN taken t ON s.doc_id = t.doc_id
"""

OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, lines[pos] AS line,
         translate(trim(lines[pos], {SPACES_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), gone AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN gone g ON lines.key = g.key
GROUP BY doc_id
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (
  SELECT d, lang, source, unnest(w) AS term FROM docs
), n AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT d) AS docs FROM words GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS l_n FROM n GROUP BY ALL HAVING sum(docs) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(l_n)::HUGEINT AS l_all FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, l_all, coalesce((SELECT sum(n) FROM n SEMI JOIN kept k ON n.lang = k.lang AND n.term = k.term WHERE n.lang = g.lang AND n.source = g.source), 0)::HUGEINT AS g_all
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + 1000000000 * (coalesce(n.n, 0) + 5) // (g_all + 5 * v) AS p, 1 + 1000000000 * (l_n + 5) // (l_all + 5 * v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM every QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""

OP12_SQL = """
WITH r AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""

#: Cutoffs of op13: the share of good documents that all rules may reject in a stratum, the chance that one does more, and the worth of a good document.
LIMIT, ERROR, GAIN = 0.01, 0.05, 10

OP13_SQL = rf"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT d, i, count(*) OVER (PARTITION BY d, k) AS times FROM (SELECT d, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT d, w, unnest(range(1, len(w) - 1)) AS i FROM words))
), repeats AS (
  SELECT d, count(DISTINCT place) AS n_repeat_words FROM (SELECT d, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE times > 1) GROUP BY d
), lines AS (
  SELECT d, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT d, unnest(string_split(text, chr(10))) AS line FROM words) WHERE trim(line, {SPACES_SQL}) <> '' GROUP BY d
), f AS (
  SELECT d, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN repeats USING (d) LEFT JOIN lines USING (d)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), e AS (
  SELECT d, doc_id, lang, base_failed, unnest(['symbols', 'long_words', 'short_words', 'repeated_lines', 'repeated_words']) AS rule,
         unnest([least(5000, 1000 * n_symbols // greatest(n_words, 1)), least(5000, 100 * word_chars // greatest(n_words, 1)), 5000 - least(5000, 100 * word_chars // greatest(n_words, 1)),
                 least(5000, 1000 * n_dup_lines // greatest(n_lines, 1)), least(5000, 1000 * n_repeat_words // greatest(n_words, 1))]) AS severity
  FROM b
), known AS (
  SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id
), l AS (
  SELECT lang, rule, severity, good, (md5(doc_id::VARCHAR) >= '8')::INT AS held FROM e JOIN known USING (doc_id) WHERE NOT base_failed
), levels AS (
  SELECT lang, rule, severity, count(*) FILTER (WHERE good = 1 AND held = 1) AS k, count(*) FILTER (WHERE good = 1 AND held = 0) AS g, count(*) FILTER (WHERE good = 0 AND held = 0) AS b FROM l GROUP BY ALL
), beyond AS (
  SELECT lang, rule, severity, sum(k) OVER s AS k, sum(g) OVER s AS g, sum(b) OVER s AS b, sum(g) OVER (PARTITION BY lang, rule) AS g_all, sum(b) OVER (PARTITION BY lang, rule) AS b_all
  FROM levels WINDOW s AS (PARTITION BY lang, rule ORDER BY severity DESC ROWS UNBOUNDED PRECEDING)
), strata AS (
  SELECT lang, count(*) FILTER (WHERE good = 1 AND held = 1) AS n FROM l WHERE rule = 'symbols' GROUP BY lang
), terms AS (
  SELECT lang, i, n * ln(1 - {LIMIT / 5}::DOUBLE) + sum(CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE ln((n - i + 1) / i::DOUBLE) + ln({(LIMIT / 5) / (1 - LIMIT / 5)!r}::DOUBLE) END) OVER (PARTITION BY lang ORDER BY i ROWS UNBOUNDED PRECEDING) AS logp
  FROM (SELECT lang, n, unnest(range(0, floor(n * {LIMIT / 5}::DOUBLE)::BIGINT + 1)) AS i FROM strata)
), allowed AS (
  SELECT lang, coalesce(max(i) FILTER (WHERE c <= {ERROR}::DOUBLE / ((SELECT count(*) FROM strata) * 5)), -1) AS k_most FROM (SELECT lang, i, sum(exp(logp)) OVER (PARTITION BY lang ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM terms) GROUP BY lang
), cuts AS (
  SELECT lang, rule, first(severity ORDER BY b * g_all - {GAIN} * g * b_all DESC, severity DESC) AS cut
  FROM beyond JOIN allowed USING (lang) WHERE k <= k_most AND b * g_all - {GAIN} * g * b_all > 0 GROUP BY ALL
), hit AS (
  SELECT DISTINCT d FROM e JOIN cuts USING (lang, rule) WHERE severity >= cut
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND hit.d IS NULL AS kept FROM b LEFT JOIN hit USING (d)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_mix_sources": op2_mix_sources,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_html_extract": op6_html_extract,
    "op7_simhash": op7_simhash,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality": op9_quality,
    "op10_permutation_ann": op10_permutation_ann,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_rules": op13_quality_rules,
}

ORACLES: dict[str, str] = {"op2_mix_sources": OP2_SQL, "op3_line_dedup": OP3_SQL, "op11_source_divergence": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_quality_rules": OP13_SQL}
