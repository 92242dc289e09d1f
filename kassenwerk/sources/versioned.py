"""A stored table that is replaced as a whole, one version after the other.

Rows are written aside first; a version exists once its manifest does, a small file that names the folder of its
rows. Manifests are numbered, and the file system creates one only if there is none of that
number yet, so of two writers that read the same version one is refused. A write that is ended before its
manifest leaves the version before it as it was, with a folder that nothing names.

Each write carries the name of the operation it does. A job that is run again after a failure
finds that its operation is done and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class VersionConflict(RuntimeError):
    """Another writer has replaced the version that this one read."""


@dataclass(frozen=True)
class Version:
    """``number`` 0 is the table before its first write."""

    number: int
    folder: str | None
    operations: tuple[str, ...]


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, remembered: int = 1000):
        """``remembered`` operations back a repeated one is known."""
        self.spark, self.root, self.schema, self.remembered = spark, root.rstrip("/"), schema, remembered

    def _path(self, name: str = "manifests"):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, number: int) -> str:
        return f"manifests/{number:012d}.json"

    def current(self) -> Version:
        """The version with the highest number."""
        path, fs = self._path()
        if not fs.exists(path):
            return Version(0, None, ())
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()]
        if not numbers:
            return Version(0, None, ())
        told = json.loads(self.spark.read.text(f"{self.root}/{self._manifest(max(numbers))}", wholetext=True).first().value)
        return Version(max(numbers), told["folder"], tuple(told["operations"]))

    def rows(self, version: Version | None = None) -> DataFrame:
        """The rows of a version, the current one unless another is named."""
        version = version or self.current()
        if version.folder is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{version.folder}")

    def replace(self, rows: DataFrame, read: Version, operation: str) -> Version:
        """``rows`` as the version after ``read``, which they were derived from."""
        if operation in read.operations:
            return read
        folder = f"rows/{read.number + 1:012d}-{uuid.uuid4().hex}"
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.root}/{folder}")
        done = (*read.operations, operation)[-self.remembered :]
        text = json.dumps({"folder": folder, "operations": done})
        # Complete under another name, then made visible in one step that fails if the number is taken.
        draft, fs = self._path(f"manifests/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        final, _ = self._path(self._manifest(read.number + 1))
        if fs.exists(final) or not fs.rename(draft, final):
            raise VersionConflict(f"version {read.number + 1} of {self.root} was written by another job")
        return Version(read.number + 1, folder, done)
