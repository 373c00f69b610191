"""What the operators share: words, shared storage, row batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule, U+0020 and U+0009 to U+000D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes of one Arrow batch that a Python worker holds; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset, a local session
    gets a temporary one; on a cluster that is an error, since each machine would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="corvid-")
        atexit.register(shutil.rmtree, found, True)
    return found


_own: dict[str, str] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` from files in the shared folder, so that no earlier stage has to run again when an executor goes."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver's process ends."""
    found = f"{shared_dir(spark).rstrip('/')}/corvid-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return found


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) of labels 0 and 1, one row an id; ids that have both, null ids and other labels are left out."""
    y = F.col(label_col).cast("int")
    each = labels.select(F.col(id_col).alias("id"), y.alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    return each.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")


def smallest(rows: DataFrame, place: Column, n: int) -> DataFrame:
    """At most ``n`` rows, those of smallest ``place`` (a hash): all below a bound that a histogram of ``BINS`` rows gives, so no
    task gets more than its share, where a sorted limit would bring n rows of each task to one."""
    part = F.shiftrightunsigned(place.bitwiseXOR(F.lit(-(2**63))), 64 - BINS.bit_length() + 1)
    bound = 0
    for k, size in sorted(map(tuple, rows.groupBy(part.alias("k")).agg(F.count(F.lit(1))).collect())):
        n -= size
        if n < 0:
            break
        bound = k + 1
    return rows.where(part < bound)


#: Parts of the range of a hash.
BINS = 1 << 12


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def words_of(text: Column) -> Column:
    """Native: the words of a text (null: none), in order."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), f"{SPACE_CLASS}+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of each text of an Arrow column; null stays None."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes. Both are settings of the session, which
    has no narrower place for them; they bound memory and change no result."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(f, schema)
