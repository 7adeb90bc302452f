"""Shared pieces of the training-data operators: scratch tables, tables by name, word counts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local run makes one of its
    own; a cluster raises, as its executors would each write to a disk that no other can read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage is cut, and a lost executor costs nothing that is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove what materialize wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on in this session, Arrow batches have at most ``rows`` rows. With Spark's 10,000 documents a batch, each
    task would hold some tens of megabytes several times over, in the executor and in its Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def with_rows(docs: DataFrame) -> DataFrame:
    """docs with a unique _row, written, so that it is the same whenever it is read."""
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()))


def n_words(text: Column) -> Column:
    """Words in a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_columns(docs: DataFrame, keep: tuple[str, ...], added: str) -> StructType:
    """The kept columns of docs, then those of a DDL string, for an operator that hands rows through."""
    return StructType([docs.schema[c] for c in keep] + StructType.fromDDL(added).fields)
