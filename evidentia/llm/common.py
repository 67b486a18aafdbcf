"""What several operators share: the shared folder, column hygiene, Arrow text buffers."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every operator here: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of our own where all is one machine, as in tests."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later jobs read it again and don't depend on executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that no later job reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df._shared_path)
    path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, by which work is dealt out; it is set to suit the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names (in any case) the operator adds itself."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def guarded(*names: str):
    """A decorator of operators on a table: its columns with these names, which the operator uses itself, come back as they were."""

    def wrap(operator):
        @functools.wraps(operator)
        def run(df: DataFrame, *args, **kwargs) -> DataFrame:
            own = [c for c in df.columns if c.lower() in names]
            aside = dict(zip(own, fresh(df, *(f"user{c}" for c in own)), strict=True))
            back = {v: k for k, v in aside.items()}
            return operator(df.withColumnsRenamed(aside), *args, **kwargs).withColumnsRenamed(back)

        return run

    return wrap


def keyed(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``df`` with _doc, the id as a whole number, and _key, which tells rows of one id apart by their texts.

    Where no id has two texts, which one job over the ids finds out, _key is 0 and costs no shuffle bytes.
    """
    rows = df.withColumns({"_doc": F.col(f"`{doc_id}`").cast("long"), "_key": F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))})
    twice = rows.groupBy("_doc").agg(F.min("_key").alias("a"), F.max("_key").alias("b")).where("_doc is not null and a < b")
    return rows if twice.limit(1).count() else rows.withColumn("_key", F.lit(0).cast("long"))


def words(text) -> F.Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows, without a copy for each row. Null: no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows with at most ``most`` bytes; a longer row makes a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
