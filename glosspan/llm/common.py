"""Plumbing shared by the corpus operators: tables, scratch storage, shipping code, map helpers."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch between the JVM and a Python worker, where the session keeps Spark's default of 64 MB.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, wherever the driver imported it from."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="glosspan-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "glosspan_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(_PACKAGE):
            for f in files:
                if f.endswith((".py", ".json", ".csv")):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode, where there is none, our own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="glosspan-scratch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir("file://" + own)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


#: Paths of the tables written and not yet released, by application.
_written: dict[str, set[str]] = {}


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing.

    The table stays until ``release`` or the application's end.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    own = spark.sparkContext.applicationId
    if own not in _written:
        _written[own] = set()
        atexit.register(_release_paths, spark, own)
    _written[own].add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.glosspan_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no plan still to run reads."""
    for t in tables:
        path = getattr(t, "glosspan_path", None)
        if path:
            _delete(t.sparkSession, path)
            _written.get(t.sparkSession.sparkContext.applicationId, set()).discard(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _release_paths(spark: SparkSession, application: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext.applicationId != application:
        return  # stopped already: the cluster clears its checkpoint folder
    for path in _written.pop(application, ()):
        _delete(spark, path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch | pa.Table]], schema, after: Callable[[], None] | None = None,
                gather: int = 0) -> DataFrame:
    """mapInArrow over record batches; ``fn`` yields batches or tables that fit ``schema``, ``after`` ends a task.

    ``gather`` joins batches up to that many bytes before ``fn`` sees them.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, gather):
            for out in fn(batch):
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out
            pa.default_memory_pool().release_unused()
        if after:
            after()
        _trim()

    return df.mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()
        yield joined[0] if joined else held[0]


def _trim() -> None:
    """Give freed memory back at a task's end: workers live on and share an executor with the JVM."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``max_bytes`` of ``column``, so peak memory is bounded."""
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        total += n or 0
        if total >= max_bytes:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows or batch.num_rows == 0:
        yield batch.slice(start)


def held_out(doc_id) -> bool:
    """The fold that labels are never learned from."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def held_out_column(c="doc_id"):
    """The same fold as a Column; a null id counts as its text 'None' would not, so it is never held out."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, also: str | None = None) -> list[tuple]:
    """Texts and 0/1 labels for fitting: at most ``per_class`` rows of each class and ``max_chars`` in all.

    With ``also``, each row ends with that column's value, or with None where there is no such column.

    The ids come from the label table alone, ordered by a hash, so the bounded id list is what reaches the
    scan of the documents; rows of the held-out fold, null labels and null ids never take part, and of repeated ids one
    row does.  First only hashes and lengths are collected; the texts are those whose lengths fit ``max_chars``.
    """
    ids = []
    base = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out_column()).select(
        F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
    for y in (0, 1):
        ids += base.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    if not ids:
        return []
    known = {r.doc_id: r.y for r in ids}
    spark = docs.sparkSession
    key = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    small = spark.createDataFrame([(k,) for k in known], T.StructType([key]))
    extra = F.col(also) if also in docs.columns else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), extra.alias("extra"), F.xxhash64("doc_id", text, extra.cast("string")).alias("h"))
    sizes = (rows.select("doc_id", "h", F.length("text").alias("n")).join(F.broadcast(small), "doc_id", "left_semi")
             .groupBy("doc_id").agg(F.min(F.struct("h", "n")).alias("x")).select("doc_id", "x.*").collect())
    chosen, chars = {}, 0
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if chars + r.n <= max_chars:
            chars += r.n
            chosen[r.doc_id] = r.h
    if not chosen:
        return []
    table = spark.createDataFrame(list(chosen.items()), T.StructType([key, T.StructField("h", T.LongType())]))
    found = rows.join(F.broadcast(table), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).collect()
    found.sort(key=lambda r: (r.h, r.doc_id))
    return [(r.text, known[r.doc_id], r.extra) if also else (r.text, known[r.doc_id]) for r in found]


def class_share(labels: DataFrame, label: str) -> float:
    """The share of class 1 among the labels that may teach, with one more of each."""
    counts = {r[label]: r.n for r in labels.where(~held_out_column()).groupBy(label).agg(F.count("*").alias("n")).collect() if r[label] in (0, 1)}
    return (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
