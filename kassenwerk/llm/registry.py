"""The queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kassenwerk.llm import (
    decontam,
    fim,
    fingerprints,
    langid,
    lm,
    merkle,
    mixing,
    neardup,
    packing,
    pii,
    quality,
    toxicity,
    warc,
)
from kassenwerk.llm.sql import ORACLE
from kassenwerk.llm.texts import documents, in_fold
from kassenwerk.session import scratch_path, ship_package

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = warc.read_pages(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [k.name for k in pii.BASE_KINDS]
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    of = lambda name: F.size(F.filter("pii_spans", lambda s: s["kind"] == name)).cast("long")
    return found.select(
        "doc_id",
        *[of(name).alias(f"n_{name}") for name in base],
        F.sha2(pii.span_text(F.filter("pii_spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        pii.span_text(F.col("pii_spans")).alias("spans"),
        F.array_join(F.transform("pii_spans", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = in_fold("doc_id", 3, 1)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "witness")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir).select("doc_id", "text"), in_fold("doc_id", 10, 0))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), size=2)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.train(docs, ~in_fold("doc_id", 4, 2))
    return langid.predict(docs, model).withColumn("held_out", in_fold("doc_id", 4, 2))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return mixed.select("doc_id", "source", "lang", "mix_topic", "mix_tokens", "mix_weight", "p_keep", "kept")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(documents(spark, sf_dir))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    named = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", named.alias("items_sha256"), "contaminated")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(documents(spark, sf_dir))
    shown = F.when(in_fold("doc_id", 5, 0), F.col("tampered_leaf")).otherwise(F.col("leaf"))
    proved = found.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(merkle.proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        merkle.fold(shown, F.col("path")).alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = {
        "op1_warc": op1_warc,
        "op2_pii": op2_pii,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_lm": op5_lm,
        "op6_neardup": op6_neardup,
        "op7_packing": op7_packing,
        "op8_fingerprints": op8_fingerprints,
        "op9_langid": op9_langid,
        "op10_mixing": op10_mixing,
        "op11_fim": op11_fim,
        "op12_decontamination": op12_decontamination,
        "op13_merkle": op13_merkle,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
