"""Session settings, shuffle sizing and the shared scratch folder."""

from __future__ import annotations

import io
import math
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MIB = 1024 * 1024
# One shuffle partition should hold about this much; AQE merges what turns out smaller.
SHUFFLE_PARTITION_BYTES = 128 * MIB


def shuffle_partitions_for(input_bytes: int, minimum: int = 8) -> int:
    """Initial shuffle partition count for a job that shuffles about ``input_bytes``.

    AQE can merge small partitions but never adds any, so the count has to come from
    the input: 200 partitions over 100 TB would mean half a terabyte per task.
    """
    return max(minimum, math.ceil(input_bytes / SHUFFLE_PARTITION_BYTES))


# A report's ids are sketched with this many bits each (a false hit in some 40), and never with more in all: 64 MiB.
SKETCH_BITS, MOST_SKETCH_BITS = 8, 512 * MIB


def membership_settings(report_ids: int, fact_bytes: int = 1024 * MIB) -> dict[str, str]:
    """Settings under which Spark filters scans by a Bloom sketch of a report's ids.

    Line items, charges and records of all history are semi-joined to a report's transactions. Where the
    ids are too many to be broadcast, both sides would be shuffled in full; with these
    settings a sketch of the ids goes to every scan of at least ``fact_bytes`` first, so that
    little more than the report's rows is shuffled. ``report_ids`` is how many ids a report has; with far
    more than that the sketch lets too much pass, though never too little.
    """
    bits = min(MOST_SKETCH_BITS, report_ids * SKETCH_BITS)
    prefix = "spark.sql.optimizer.runtime.bloomFilter"
    return {
        f"{prefix}.enabled": "true",
        f"{prefix}.applicationSideScanSizeThreshold": str(fact_bytes),
        # The ids come from a scan of the transactions, of whose size only a part are ids.
        f"{prefix}.creationSideThreshold": str(1024 * 1024 * MIB),
        f"{prefix}.expectedNumItems": str(report_ids),
        f"{prefix}.maxNumItems": str(max(report_ids, MOST_SKETCH_BITS // SKETCH_BITS)),
        f"{prefix}.maxNumBits": str(bits),
        f"{prefix}.numBits": str(bits),
    }


def build_session(
    app: str = "kassenwerk",
    master: str | None = None,
    input_bytes: int | None = None,
    ui: bool = True,
    report_ids: int = 10_000_000,
) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SHUFFLE_PARTITION_BYTES))
        # Joins whose measured partitions are small hash them instead of sorting both sides.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(64 * MIB))
    )
    for name, value in membership_settings(report_ids).items():
        builder = builder.config(name, value)
    if not ui:
        builder = builder.config("spark.ui.enabled", "false")
    if master is not None:
        builder = builder.master(master)
    if input_bytes is not None:
        builder = builder.config(
            "spark.sql.shuffle.partitions", str(shuffle_partitions_for(input_bytes))
        )
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` as the cluster names it.

    A local-mode session without that setting uses a folder in its warehouse; on a
    cluster the setting is required, because every executor has to reach the folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the scratch folder; what is written there goes with the session."""
    path = f"{scratch_root(spark)}/kassenwerk/{label}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs run in here leave no shuffle files behind.

    Otherwise those stay until the driver happens to collect its garbage, and a job of many steps needs the
    disk for the shuffles of all of them. For writes, whose rows are read from what they wrote.
    """
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: fixed rows, short lineage, no shuffle files left.

    Parquet rather than an RDD checkpoint, so later passes read only their columns.
    """
    path = scratch_path(df.sparkSession, label)
    with dropping_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package also where it is not installed.

    The archive lies in the shared scratch folder; each session gets it once.
    """
    context = spark.sparkContext
    if getattr(context, "_kassenwerk_shipped", False):
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    path = scratch_path(spark, "package") + "/kassenwerk.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(path)
    context._kassenwerk_shipped = True
