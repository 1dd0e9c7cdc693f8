"""Session helpers shared by the operators: table access, the shared folder,
bounded labelled samples and Arrow batch plumbing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: Output batches of the Arrow stages hold about this many bytes.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, and a lost
    executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chunkloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    trim_native(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by `materialize` that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back(spark: SparkSession) -> None:
    """Have the driver's JVM collect, which returns heap to the system: a long series of small jobs
    grows it far beyond what is in use, and it shrinks at a full collection only."""
    spark._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> str | None:
    """Have the driver's JVM return what its C library holds unused: compilers and class loading
    leave some of it behind with each plan, in an arena of each thread. What the JVM says of it;
    None where it has no such command."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    lang = jvm.java.lang

    def array(kind, values: list):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    try:
        # By the interface: the server's own class is not open to calls from outside its module.
        kinds = [lang.Class.forName(k) for k in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, kinds))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call = array(lang.Object, [name, "systemTrimNativeHeap", array(lang.Object, []), array(lang.String, [])])
        return invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except (Py4JError, PySparkException):
        return None


def is_training(doc_id) -> F.Column:
    """Rows that labels may be learned from: crc32(doc_id as text) mod 5 is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def sampled_ids(labelled: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """About `per_class` distinct keys of each label value, picked by a hash of the key.

    The threshold comes from the class counts, so the pick is one filter over all
    rows, the same in every run, and its size is about the bound whatever the input's.
    """
    # Labelled rows are one a key; were they not, the sample would have no more keys for it.
    counts = labelled.groupBy(label).agg(F.count("*").alias("_n"))  # a row a label value
    spot = F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 30)) / float(1 << 30)
    return labelled.join(counts, label).filter(spot < per_class / F.col("_n")).groupBy(key).agg(F.max(label).alias(label))


def _trim() -> None:
    """Return what Arrow and the C library hold unused: Spark keeps a task's worker for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = 512, nbytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller slices of the incoming batches, of so many rows and bytes at most (a longer text
    is a slice of its own), so that per-batch state stays small."""
    _trim()
    for batch in batches:
        todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > nbytes:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def emit(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class Batcher:
    """Collects rows and hands out record batches of about BATCH_BYTES."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, nbytes: int = 64) -> bool:
        self.rows.append(row)
        self.bytes += nbytes
        return self.bytes >= BATCH_BYTES or len(self.rows) >= 10_000

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [[] for _ in self.schema]
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema)], schema=self.schema)
        self.rows, self.bytes = [], 0
        return out


class WordIndex(dict):
    """word -> row number; unseen words queue up until `learn` has values for them."""

    def __init__(self, learn: Callable[[list[str]], list], limit: int = 300_000):
        super().__init__()
        self.learn, self.limit, self.new = learn, limit, []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.new.append(word)
        return n
