"""Shared-folder storage: checkpoints, written tables and stable row identities."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = ("__row", "__at")
TEXT_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a run on one machine (tests) gets a temporary one, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="platen-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI of the file system that Spark takes it for, in the form that pyarrow reads too."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/+", "file:///", uri)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: lineage ends here and lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder (for wide rows, where Parquet is smaller)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(the same columns as c0, c1, ..., what each name has become), so that no name clashes with an added one."""
    names = {n: f"c{i}" for i, n in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores as keep it apart from the frame's columns."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def with_row_id(df: DataFrame) -> DataFrame:
    """Adds ROW to a frame of plain_columns: a hash of the row's content and one of its place (file and row of the file).

    Rows of different content are told apart by the first, wherever they are stored, and repeated rows by the second, which
    any rereading gives again. What isn't a scan of Parquet files is written as a table first. Columns of maps don't count as content.
    """
    content = F.xxhash64(*[f.name for f in df.schema if "map<" not in f.dataType.simpleString()], F.lit(0))
    names = [content.alias(ROW[0]), F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(ROW[1])]
    try:
        return df.select("*", *names)
    except AnalysisException:
        return table(df).select("*", *names)


def to_python(df: DataFrame) -> DataFrame:
    """`df`, which goes on to Python workers: Arrow batches get TEXT_ROWS rows at most, so that a worker and its executor hold few
    whole texts at once. The setting is the session's; it is only ever lowered."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


def perhaps_in(df: DataFrame, ids: DataFrame, bits: int = 26) -> DataFrame:
    """The rows of `df` whose id hashes to a place that one of `ids` has (both: id): none that a join with these needs is lost, and few others stay.

    The places are a bitmap of 2 ** `bits` bits at most, however many ids there are, which is sent to every task. So wide rows that
    a join would drop are dropped before they are dealt out.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    bucket, bit = "bitmap_bucket_number(__p)", "bitmap_bit_position(__p)"
    maps = ids.where("id IS NOT NULL").select(place.alias("__p")).groupBy(F.expr(bucket).alias("__b")).agg(F.expr(f"bitmap_construct_agg({bit})").alias("__m"))
    held = f"shiftright(cast(conv(hex(substring(__m, cast({bit} div 8 as int) + 1, 1)), 16, 10) as int), cast({bit} % 8 as int)) & 1 = 1"
    at = df.where("id IS NOT NULL").withColumn("__p", place).withColumn("__b", F.expr(bucket))
    return at.join(F.broadcast(maps), "__b").where(held).select(*df.columns)


def fits_broadcast(df: DataFrame, rows: int = 500_000) -> bool:
    """Whether a narrow frame has few enough rows to be broadcast; callers need another way beyond it."""
    return df.limit(rows + 1).count() <= rows
