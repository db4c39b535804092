"""Registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_template, katz, lang_id, ngram_join, packing, periodic_runs, pii, ranked_search, secrets, toxicity, warc
from .shared import remainder, table

#: Public vocabularies; other files may be given to the operators.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder("doc_id", 3) == 1
    found = toxicity.score(docs, toxicity.fit(docs, labels.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts by base kind, digest of the base spans and all spans as text."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[_count(k) for k in kinds],
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(pii.personal_data(table(spark, sf_dir, "documents")), pii.BASE_KINDS)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, lambda: packing.Encoder(WORDS))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return katz.score(docs, katz.fit(docs.where(remainder("doc_id", 7) != 2)))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(secrets.secrets(table(spark, sf_dir, "documents")), secrets.BASE_KINDS)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_template.main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = lang_id.fit(docs.where(~held), lang_id.public_pieces(PIECES))
    return lang_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.captures(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), periodic_runs.Repeat())
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.expr("1000 * best.length div -best.col3").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_personal_data, op4_exact_dedup, op5_ngram_join, op6_packing, op7_katz, op8_secrets, op9_main_text, op10_language, op11_warc, op12_periodic_runs, op13_ranked_search)}

NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLES = {
    "op4_exact_dedup": f"""
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
             sha256(norm) AS text_sha256
      FROM (SELECT doc_id, {NORMAL} AS norm FROM documents))""",
    # base32 of SHA-1: each ten hexadecimal digits are eight digits of five bits
    "op11_warc": """
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           1 + ((('0x' || substr(sha1(html), 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)]), '') AS payload_digest,
       CASE WHEN page_id = least_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least_id THEN least_id END AS refers_to
FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS least_id
      FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))""",
    "op13_ranked_search": rf"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all({NORMAL}, '{TERMS}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM lengths),
item_terms AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all({NORMAL}, '{TERMS}')) AS term FROM benchmark) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
factors AS (SELECT doc_id, 75 + (25 * n * docs) // tokens AS m FROM lengths, totals),
scores AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM item_terms JOIN tf USING (term) JOIN weights USING (term) JOIN factors USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20""",
}
