"""The training-corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes and returns the columns of ``documents``, whatever further columns a table
has; the last returns packed pieces. ``run`` writes each stage's rows to the shared scratch
folder and hands the next one what it reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kassenwerk.llm import mixing, neardup, packing, pii, quality
from kassenwerk.operators.numbering import number_within
from kassenwerk.session import ship_package, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TYPES = dict(doc_id="long", text="string", lang="string", source="string", n_chars="long")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c).cast(TYPES[c]).alias(c) for c in COLUMNS])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule of the threshold table."""
    return quality.keep_good(_documents(docs))


def _first_rows(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the first by its columns. Rows of one key have one text."""
    others = [c for c in COLUMNS if c not in (key, "text")]
    first = F.min(F.struct(*others, "text")).alias("_first")
    return df.groupBy(key).agg(first).select(*({key} - set(others)), "_first.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Five-word shingles, similarity 0.8. Documents without words or without id stay. Of rows
    that repeat id and text the first by the other columns stays. Rows that share an id with
    another text are documents of their own; where some do, documents are numbered by id and text.
    """
    ship_package(spark)
    table = _documents(docs)
    named, nameless = table.filter("doc_id IS NOT NULL"), table.filter("doc_id IS NULL")
    own = F.struct("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text"))
    seen = named.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(own["text"]).alias("a"), F.max(own["text"]).alias("b"))
    if seen.filter("a != b").isEmpty():
        gone = neardup.near_duplicates(table).filter("NOT kept").select("doc_id").distinct()
        return _first_rows(named.join(gone, "doc_id", "left_anti"), "doc_id").unionByName(nameless).select(*COLUMNS)
    keyed = named.withColumn("_own", own)
    ids = number_within(keyed.select("_own").distinct().withColumn("_all", F.lit(0)), ["_all"], ["_own"], "_nr")
    numbered = written(keyed.join(ids.select("_own", "_nr"), "_own"), "numbered")
    texts = numbered.select(F.col("_nr").alias("doc_id"), "text")
    gone = neardup.near_duplicates(texts).filter("NOT kept").select(F.col("doc_id").alias("_nr")).distinct()
    return _first_rows(numbered.join(gone, "_nr", "left_anti"), "_nr").select(*COLUMNS).unionByName(nameless.select(*COLUMNS))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = pii.redact(_documents(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities raked to source, language and topic shares."""
    return mixing.mix(_documents(docs)).filter("kept").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    ship_package(spark)
    return packing.pack(_documents(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii_redaction", pii_redaction),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

# Signatures, raked draws and tokenizer ids are beyond SQL. The tests compare the operators with
# plain versions; of the stages they check columns, the ids that pass the quality rules and
# the rows that the near duplicates leave.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
