from pyspark.sql import Window
from pyspark.sql import functions as F

from kassenwerk.operators.numbering import number_within


def test_numbers_equal_row_number_even_if_one_group_dominates(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 != 0, F.lit(None)).otherwise(F.col("id") % 20).alias("g"),
        (F.hash("id").cast("bigint") * 10_000 + F.col("id")).alias("k"),
    )
    window = Window.partitionBy("g").orderBy("k")
    expected = df.withColumn("nr", F.row_number().over(window).cast("bigint"))
    found = number_within(df, ["g"], ["k"])
    assert found.columns == ["g", "k", "nr"]
    assert found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0


def test_the_dominant_group_is_spread_over_tasks(spark, monkeypatch):
    kept = {}
    from kassenwerk.operators import numbering

    real = numbering.written

    def spy(df, label):
        kept["df"] = real(df, label)
        return kept["df"]

    monkeypatch.setattr(numbering, "written", spy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shuffled = (F.col("id") * 7919) % 3001
        df = spark.range(3001).select(F.lit("only").alias("g"), shuffled.alias("k"))
        assert number_within(df, ["g"], ["k"]).filter("nr <> k + 1").count() == 0
        parts = kept["df"].select(F.shiftright("_seq", 33)).distinct().count()
        assert parts == 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, k int")
    assert number_within(df, ["g"], ["k"]).count() == 0
