"""Helpers that the operators share: table reading, row keys, lineage cuts and Arrow stages in small slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BROADCAST_ROWS = 250_000  # narrow tables of more rows than this are joined by a shuffle
SLICE_ROWS, SLICE_BYTES = 500, 2 << 20  # what an Arrow stage handles at a time (one longer text goes alone)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; a file too small to be split gives each core a part (a large table has more already)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name.rpartition("/")[0])
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow table only if it is counted to be small."""
    return F.broadcast(df) if df.count() <= most else df


def row_key() -> Column:
    """Identity of a document row (doc_id, text): two rows share it only if both are equal."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def row_check() -> Column:
    """A second hash of a document row: with row_key 128 bits, so that no two of any number of rows are taken for one."""
    return F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")), "doc_id")


def row_digest() -> Column:
    """128 bits of a document row (doc_id, text) as bytes."""
    return F.unhex(F.md5(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))), "UTF-8")))


def row_id() -> Column:
    """Both hashes of a document row as one column."""
    return F.struct(row_key().alias("key"), row_check().alias("check"))


def scratch(df: DataFrame, name: str) -> str:
    """A column name that df does not use yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], by: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most `rows` rows and about `size` bytes of column `by`, so that a worker holds little at a time."""
    for batch in batches:
        width = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(by))), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(width.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(end, (end[at - 1] if at else 0) + size, side="right"))
            stop = max(at + 1, min(stop, at + rows))
            yield batch.slice(at, stop - at)
            at = stop


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, keep: list[str], by: str = "text") -> DataFrame:
    """Apply `work` to slices of df: the columns `keep` as they are (ids stay exact, null ones too), then those of `schema`.

    `work` gives a sequence per new column, and under `row_` the slice's row that each output row comes
    from if they are not one to one.
    """
    new = StructType.fromDDL(schema)
    out = StructType([*(df.schema[c] for c in keep), *new.fields])
    shape = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, by):
            found = work(part)
            rows = found.get("row_")
            held = [part.column(part.schema.get_field_index(c)) for c in keep]
            if rows is not None:
                held = [c.take(pa.array(rows, pa.int64())) for c in held]
            made = [pa.array(found[f.name], shape.field(f.name).type) for f in new.fields]
            yield pa.RecordBatch.from_arrays([c.cast(shape.field(i).type) for i, c in enumerate(held)] + made, names=shape.names)

    return df.mapInArrow(run, out)


def values(part: pa.RecordBatch, name: str) -> list:
    """A column of a slice as Python values."""
    return part.column(part.schema.get_field_index(name)).to_pylist()


@lru_cache(maxsize=2)
def powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2**64."""
    out = []
    for r in (multiplier, pow(multiplier, -1, 1 << 64)):
        p = np.ones(n, np.uint64)
        done = 1
        while done < n:
            more = min(done, n - done)
            p[done : done + more] = p[:more] * np.uint64(pow(r, done, 1 << 64))
            done += more
        out.append(p)
    return out[0], out[1]


def byte_symbols() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes (a rule of their format)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
