"""The corpus operators over the driver's tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, divergence, langid, lm, negatives, neardup, quality_rules, secrets, sentences,
               suffixes, url_rules, warc)
from .common import prepare, spread, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of a document that is a benchmark item, but for edits."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(spread(docs), table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles are 85 % alike."""
    prepare(spark)
    return neardup.groups(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of the documents, judged by the forest."""
    prepare(spark)
    trees = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), trees)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the allow and block rules."""
    prepare(spark)
    return url_rules.judge(table(spark, sf_dir, "pages"),
                           url_rules.rule_frame(spark, url_rules.RULES))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.predict(spread(docs.select("doc_id", "text")), model)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document (learned decision list)."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(spread(docs.select("doc_id", "text")), rules)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with a public BPE vocabulary."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(spread(docs), tokenizer_path(), keep_ids=False)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under an interpolated bigram model."""
    prepare(spark)
    return lm.scores(table(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 200-byte strings that start twice."""
    prepare(spark)
    return suffixes.repeated(table(spark, sf_dir, "documents")).drop("spans")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, from the index of the archives."""
    prepare(spark)
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives that score 30 to 90 % of an anchor's positives."""
    prepare(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")),
                                    F.col("vec_id") % 100 == 0, label=label)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with a public SentencePiece model."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentences.encode(spread(docs), tokenizer_path("piece_bpe_32k.model"), keep_ids=False)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's terms are from other sources and its language."""
    prepare(spark)
    return divergence.audit(spread(table(spark, sf_dir, "documents").select("lang", "source", "text")))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_near_duplicates, op3_secrets, op4_url_rules, op5_language,
    op6_quality_rules, op7_bpe, op8_language_model, op9_suffix_array, op10_warc,
    op11_hard_negatives, op12_sentencepiece, op13_source_divergence)}

#: DuckDB SQL by query, where SQL can express it.
SQL: dict[str, str] = {}

SQL["op4_url_rules"] = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1) AS h,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)', 1) AS path FROM parts),
hosts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split),
ruled AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM hosts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""

SQL["op10_warc"] = """
WITH payloads AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
  FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM firsts"""

SQL["op11_hard_negatives"] = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""

SQL["op13_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source),
grps AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000 * (coalesce(c.n, 0) + 1) AS HUGEINT) // (coalesce(s.n, 0) + l.v) AS p,
         1 + CAST(1000000000 * (k.n + 1) AS HUGEINT) // (l.n + l.v) AS lang_p
  FROM grps g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
prices AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN prices p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - lang_p) * (p - lang_p)) // lang_p FROM shares WHERE n > 0 AND p > lang_p)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200"""
