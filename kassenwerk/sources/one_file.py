"""One report file out of ordered pieces, written by as many tasks as there are pieces.

The pieces' sizes, summed up in their order, say where each begins in the file. A manifest holds these
places; then every task copies its piece to its place, a buffer at a time. No task and no
driver sees more than one buffer, and a task that is run again writes the same bytes to the
same place. The file gets its name when all pieces are in it.

Writing at a place needs a file system that all executors have mounted (paths of the scheme
``file``). For others the pieces stay a folder, whose manifest lets readers treat it as one file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUFFER = 4 << 20
PLACES = "piece string, start long, bytes long"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Path, first byte and size of every piece of a folder, in the order of their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    named = sorted((f.getPath().toString(), f.getLen()) for f in files if f.getPath().getName().startswith("part-"))
    rows, start = [], 0
    for name, size in named:
        rows.append((name, start, size))
        start += size
    return spark.createDataFrame(rows, PLACES)


def _local(path: str) -> str:
    told = urlparse(path)
    if told.scheme not in ("", "file"):
        raise ValueError(f"{told.scheme} files cannot be written at a place: {path}")
    return unquote(told.path)


def _copy(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = os.open(target, os.O_WRONLY)
                with open(_local(row["piece"]), "rb") as piece:
                    at = row["start"]
                    while chunk := piece.read(BUFFER):
                        at += os.pwrite(out, chunk, at)
                os.fsync(out)
                os.close(out)
            yield batch

    return run


def assemble(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Put the pieces of ``folder`` into the one file ``target``; its manifest is returned."""
    places = manifest(spark, folder)
    final = _local(target)
    draft = f"{final}.incomplete"
    with open(draft, "wb"):
        pass
    pieces = max(1, places.count())
    done = places.repartition(pieces, "piece").mapInArrow(_copy(draft), PLACES)
    copied = done.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    if os.path.getsize(draft) != copied:
        raise OSError(f"{draft} has {os.path.getsize(draft)} bytes, its pieces have {copied}")
    os.replace(draft, final)
    return places
