"""Terminal lists, run logs and JSON records derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kassenwerk.functions.text import space_label


def _blank_if(condition: Column, value: Column) -> Column:
    return F.when(condition, F.lit("")).otherwise(value)


def stored_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One terminal per customer, some without label, space tag or space id."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("C-"), key).alias("id"),
        _blank_if(key % 4 == 0, F.col("c_name")).alias("label"),
        (key % 2 == 0).alias("selected"),
        _blank_if(key % 3 == 0, space_label(nation, F.concat(F.lit("Filiale "), nation))).alias(
            "space"
        ),
        F.when(key % 3 == 1, nation).alias("space_id"),
    )


def delivered_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery per order: known and new terminals, repeats, blank fields."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    prefix = F.when(key % 3 == 0, "N-").otherwise("C-")
    space = (customer % 25).cast("string")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        key.alias("seq"),
        _blank_if(key % 11 == 0, F.concat(prefix, customer)).alias("identifier"),
        _blank_if(key % 4 == 0, F.concat(F.lit("Kasse "), key)).alias("name"),
        _blank_if(key % 5 == 0, space_label(space, F.lit("Filiale"))).alias("space"),
        _blank_if(key % 2 == 0, space).alias("space_id"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report run per event; a user's runs share a token."""
    key, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")

    def picked(ident: Column, selected: Column) -> Column:
        return F.struct(ident.cast("string").alias("id"), selected.alias("selected"))

    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        key.alias("seq"),
        F.concat(F.lit("Q-"), user).alias("token"),
        F.when(kind == "view", "brand")
        .when(kind == "click", "terminal")
        .when(kind == "error", "export")
        .when(kind == "purchase", "card")
        .otherwise("settlement")
        .alias("mode"),
        F.col("ts").alias("submitted_at"),
        F.when(key % 5 == 0, "FAILED").when(key % 5 == 1, "SUCCESS").alias("status"),
        F.date_format("ts", "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.col("ts") + F.make_dt_interval(F.lit(7)), "yyyy-MM-dd").alias("end_date"),
        F.lpad((user % 10000).cast("string"), 4, "0").alias("card_last4"),
        F.array(
            picked(user % 7, F.lit(True)), picked(user % 5, key % 2 == 0)
        ).alias("spaces"),
        F.array(
            picked(user % 3, key % 2 == 1), picked(user % 4, key % 3 == 0)
        ).alias("terminals"),
        (key % 3 == 0).alias("super_user"),
        _blank_if(key % 4 == 0, (user % 5).cast("string")).alias("account_id"),
    )


def run_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers about runs, the status flat or nested, the token under varying names."""
    key = F.col("event_id")
    status = F.when(key % 4 == 0, "success").when(key % 4 == 1, "Processing").otherwise("failed")
    token = F.concat(F.lit("tok-"), key)
    nested = F.to_json(F.struct(token.alias("portalQueryToken"), F.struct(status.alias("status")).alias("status")))
    flat = F.to_json(F.struct(token.alias("queryToken"), status.alias("status")))
    bare = F.to_json(F.struct(token.alias("token")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.when(key % 3 == 0, nested).when(key % 3 == 1, flat).otherwise(bare).alias("value")
    )


def terminal_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON terminal records; fields go missing and ids are not always numbers."""
    key = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.to_json(
            F.struct(
                F.when(key % 5 != 0, F.concat(F.lit("T-"), key)).alias("identifier"),
                F.when(key % 4 != 0, F.col("c_name")).alias("name"),
                F.when(key % 3 == 0, F.lit("x")).otherwise(key.cast("string")).alias("id"),
                F.when(key % 2 == 0, "ACTIVE").alias("state"),
            )
        ).alias("value")
    )
