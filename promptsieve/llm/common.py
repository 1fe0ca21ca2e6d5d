"""What the corpus operators share: reading, the shared folder, Arrow helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Ready a session for the corpus operators: this package is sent to the executors' Python, as
    ``--py-files`` would, and Arrow batches, which hold whole texts, are limited to a few megabytes
    unless the session sets a limit of its own."""
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(batch).rstrip("b") == str(64 << 20):  # the default
        spark.conf.set(batch, str(8 << 20))
    context = spark.sparkContext
    if context.applicationId in SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="promptsieve-"), "promptsieve.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    SHIPPED.add(context.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    A ``local[...]`` session without that setting gets a temporary folder, since its only
    machine shares everything; on a cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="promptsieve-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/promptsieve-{spark.conf.get('spark.app.id', 'session')}"


SCOPE = ["work"]  # the folder below the application's that tables are written to just now


@contextlib.contextmanager
def scope(name: str):
    """Tables written inside go to a folder of their own, which ``discard`` deletes."""
    SCOPE.append(f"{name}-{uuid.uuid4().hex}")
    try:
        yield SCOPE[-1]
    finally:
        SCOPE.pop()


def discard(spark: SparkSession, name: str) -> None:
    """Delete the tables of one scope, once nothing reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{SCOPE[-1]}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def rereadable(docs: DataFrame) -> DataFrame:
    """``docs``, whose rows then have the same places in every pass: as it is if it only reads, selects and
    filters files, else as a table written to the shared folder."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = {line.lstrip(" :+-").split(" ")[0] for line in plan.splitlines() if line.strip()}
    return docs if nodes <= {"Project", "Filter", "Relation"} else written(docs, "input")


def release(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder, once their results are consumed."""
    discard(spark, "")


def extended(frame: DataFrame, **kinds: str) -> T.StructType:
    """The frame's schema, all nullable, and further columns."""
    added = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in kinds.items())) if kinds else []
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in frame.schema), *added])


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, with further underscores if the frame has such a column."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_text(column: str) -> Column:
    return F.col(column).cast("string")


def crc_of_id(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(id_text(column).cast("binary")) % modulus, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that no slice holds much more than ``most`` bytes of one text column."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
            yield batch.slice(a, b - a)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_binary())
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets


def folded(frame: DataFrame, blocks: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]],
           cells: int, block: int = 4096) -> np.ndarray:
    """Sum of one fixed-size array of counts per partition, up to 2**31 - 1.

    ``blocks`` turns a partition into (block number, counts) pairs.  The partial blocks are
    packed, shuffled by block number and added as they stream by, so a task holds a few blocks however
    many partitions there are; the driver receives ``cells`` 32-bit numbers.
    """
    def partial(batches):
        for number, counts in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([zlib.compress(counts.astype("<u4").tobytes(), 1)], pa.binary())],
                names=["block", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = np.frombuffer(zlib.decompress(counts), "<u4").astype("<i8")
                held[number] = held[number] + value if number in held else value
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()),
                 pa.array([np.minimum(v, (1 << 31) - 1).astype("<i4").tobytes() for v in held.values()], pa.binary())],
                names=["block", "counts"])

    schema = "block int, counts binary"
    sums = frame.mapInArrow(partial, schema).repartition("block").mapInArrow(add, schema)
    total = np.zeros(cells, dtype=np.int32)
    for batch in sums.toArrow().to_batches():  # read where they lie, one row per block
        for number, counts in zip(batch.column(0).to_numpy(), batch.column(1)):
            total[number * block:(number + 1) * block] = np.frombuffer(counts.as_buffer(), "<i4")
    return total


BITS = 1 << 23


def bit_of(row: Column) -> Column:
    return F.pmod(F.xxhash64(row, F.lit(11)), F.lit(BITS)).cast("int")


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """Which of ``BITS`` hash buckets hold one of the rows: at most ``BITS / 64`` numbers reach the driver.

    A pre-filter that passes every wanted row and few others, until the wanted rows are many millions;
    beyond, more rows pass it and are left to the exact join behind it.
    """
    return flags(rows.select(bit_of(F.col(column)).alias("bit")))


def flags(bits: DataFrame, size: int = BITS) -> np.ndarray:
    """The numbers in ``bit``, below ``size``, as a bitmap, whose 64-bit words are put together by the executors."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit") % 64)
    words = bits.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))
    found = np.zeros(size // 64, "<i8")
    for batch in words.toArrow().to_batches():
        found[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return found.view(np.uint8)


def passed(bits: np.ndarray, numbers: pa.Array) -> np.ndarray:
    at = np.asarray(numbers, dtype=np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
