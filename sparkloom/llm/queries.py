"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import brown, decontam, html, jaccard, oracles, packing, quality, rules, substrings, suffix, urls
from sparkloom.llm.common import fold


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_encoder():
    """The public byte-level BPE vocabulary that the packing query names."""
    import public_tokenizers

    return packing.bpe_encoder(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_encoder, capacity=1024, end_id=2, with_ids=False)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "quality")
    out = quality.score(docs, quality.fit(docs, labels))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


#: Fixed rules of the URL query: host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    table = spark.sql(f"SELECT * FROM VALUES {listed} AS t(host, path, verdict)")
    return urls.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), table)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "quality")
    out = rules.score(docs, rules.fit(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_components(docs, n=4, percent=85)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.deduplicate(docs, window=20, with_text=False)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    out = decontam.scan(docs, bench, window=10)
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages").select("page_id", "html"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = brown.score(docs, fold("doc_id", 7) != 2)
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.deduplicate(docs, depth=200, keep="none", with_text=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def _url_sql() -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""WITH r(rh, rp, rv) AS (VALUES {listed}),
p AS (SELECT row_number() OVER () AS rid, page_id,
 translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
 coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS best
 FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rh || rp AS rule, coalesce(rv, 'allow') AS verdict FROM m WHERE best = 1"""


def oracle_sql() -> dict[str, str]:
    """What SQL can state; of learned, packed and rendered results the tests hold what README names."""
    return {
        "op3_url_filters": _url_sql(),
        "op5_ngram_jaccard_join": oracles.jaccard_components(4, 85),
        "op6_substring_dedup": oracles.substring_windows(20),
        "op7_decontamination": oracles.contamination(10),
        "op10_suffix_array_dedup": oracles.repeated_bytes(200),
    }
