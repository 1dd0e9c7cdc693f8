"""The manifest handle: three tables, attributes and provenance. Immutable."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema


@dataclass(frozen=True)
class Manifest:
    files: DataFrame
    arrays: DataFrame
    chunks: DataFrame
    attrs: dict = field(default_factory=dict)
    provenance: dict = field(default_factory=dict)
    held: tuple = ()  # cached rows that the tables are made of
    below: str = ""  # the group of a larger manifest that this is a view of

    @property
    def spark(self) -> SparkSession:
        return self.chunks.sparkSession

    def with_(self, **changes) -> Manifest:
        return replace(self, **changes)

    def group(self, path: str) -> Manifest:
        """What lies below a group, as a view; it cannot be saved, concatenated or merged."""
        path = path.strip("/")
        if not path:
            return self
        head = path + "/"
        cut = lambda df: df.filter(df["array_path"].startswith(head)).withColumn("array_path", F.substring("array_path", len(head) + 1, 1 << 30))
        if self.arrays.filter(self.arrays["array_path"].startswith(head)).isEmpty():
            raise KeyError(f"no group {path!r}")
        return replace(self, arrays=cut(self.arrays), chunks=cut(self.chunks), attrs={}, below=f"{self.below}/{path}".strip("/"))

    def root(self, what: str) -> Manifest:
        """This manifest, if it is no view of a group."""
        if self.below:
            raise ValueError(f"{what} needs a whole manifest, not the group {self.below!r} of one")
        return self

    def release(self) -> None:
        """Give up the cached rows of its scan; the manifest still works, by scanning again."""
        for df in self.held:
            df.unpersist()

    def array(self, path: str):
        """The row of one array; its keys are named if there is no such array."""
        rows = self.arrays.filter(self.arrays["array_path"] == path).limit(2).collect()
        if len(rows) != 1:
            some = [r[0] for r in self.arrays.select("array_path").orderBy("array_path").limit(20).collect()]
            raise KeyError(f"no array {path!r}; there are {', '.join(some)}")
        return rows[0]

    def persist(self) -> Manifest:
        return self.with_(files=self.files.persist(), arrays=self.arrays.persist(), chunks=self.chunks.persist())


def from_rows(spark: SparkSession, files: list, arrays: list, chunks: list, attrs: dict | None = None, provenance: dict | None = None) -> Manifest:
    return Manifest(
        spark.createDataFrame(files, schema.FILES), spark.createDataFrame(arrays, schema.ARRAYS), spark.createDataFrame(chunks, schema.CHUNKS), attrs or {}, provenance or {}
    )
