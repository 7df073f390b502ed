"""The corpus pipeline over `documents`: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, and columns of other names that documents may have pass through.
In every stage an empty table gives no rows, repeated rows are documents of their own unless said otherwise, a null source
is a source of its own, and texts are taken whole, however long. Reruns over the same rows keep the same documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm._store import free_name, shared_dir
from platen.llm.cube_mix import mix_documents
from platen.llm.line_dedup import dedup_lines
from platen.llm.minhash import one_of_each_group
from platen.llm.packing import pack
from platen.llm.quality_gbt import quality_filter
from platen.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trained trees keep. Null and empty texts have no words, so they go; a null id is judged like any other."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that the corpus has before them; one that loses all its words to that goes too. n_chars follows the text.

    Null and empty texts stay. Of equal lines the one of the smallest id stays (nulls last), within an id the first by content and place;
    of repeated rows the first keeps its lines and the others go.
    """
    lost = free_name(docs, "n_lost")
    out = dedup_lines(docs, lines=free_name(docs, "n_lines"), dropped=lost)
    left = (F.col(lost) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col(lost) == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long")
    return out.where(left).withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, and of several rows of it the first by content. Null ids and texts without words stay."""
    return one_of_each_group(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document stands there as often as it is taken. Texts without words weigh nothing in the totals of words, and are taken by their number."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, each copy of a document packed for itself; a null or empty text is its end id alone. Which sequence a piece lies in follows the files."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", packing)]
#: SQL can't express the trees, the cube method or the packing; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
