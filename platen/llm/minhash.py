"""Near-duplicate documents: one-permutation MinHash, banded buckets and star-shaped candidate edges.

One hash per shingle fills `bands * rows` bins by its high bits (the least hash of each bin counts). An empty bin
borrows from a full one that its own fixed random permutation of the bins reaches first, so bins stay independent
draws and a pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands (36 bands of 4: all but one
in a million at 0.75). Documents of one bucket get an edge to the bucket's centre only. Buckets whose members are still
in different components after the check take the member that shares most with the others as a second centre, and what even
then stays apart is compared by its rarest shingles, which leaves out no pair that can be alike. So star edges bound the
work but lose nothing. Edges are confirmed on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import ROW, cut, perhaps_in, plain_columns, table, to_python, with_row_id
from ._text import U, blocks, mix, shingles, words
from .graph import connected_components

BANDS, ROWS = 36, 4


class OnePermutation:
    """Signatures of `bins` values, and their band keys."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        draws = np.random.default_rng(seed)
        #: order[t, i]: the bin that bin i tries at its t-th attempt; rank: the attempt at which bin i reaches a bin.
        self.order = np.stack([draws.permutation(self.bins) for _ in range(self.bins)], axis=1)
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.arange(self.bins)[:, None], axis=0)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Of sorted distinct 64-bit hashes, at least one."""
        bins = ((hashes >> U(32)) * U(self.bins) >> U(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        out, full = np.zeros(self.bins, U), bins[first]
        out[full] = hashes[first]
        if len(full) < self.bins:
            empty = np.ones(self.bins, bool)
            empty[full] = False
            rest = np.flatnonzero(empty)
            lender = full[self.rank[np.ix_(full, rest)].argmin(axis=0)]
            out[rest] = mix(out[lender] + U(1))
        return out

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        keys = np.arange(1, self.bands + 1, dtype=U) * U(0xA24BAED4963EE407)
        for part in signature.reshape(self.bands, self.rows).T:
            keys = mix(keys + part)
        return keys.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """id, n (distinct shingles), k1 and k2 (128 bits that are equal for equal sets), keys (of the bands; none if n is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        method = OnePermutation(bands, rows)
        for batch in batches:
            n, k1, k2, keys, ends = [], [], [], [], [0]
            for block in blocks(batch.column(1)):
                for own in shingles(words(block, lower=True), size):
                    n.append(len(own))
                    k1.append(int(mix(own ^ U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64)))
                    k2.append(int(mix(own + U(0x14057B7EF767814F)).sum(dtype=U).view(np.int64)))
                    if len(own):
                        keys.append(method.band_keys(method.signature(own)))
                    ends.append(ends[-1] + bands * bool(len(own)))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["id", "n", "k1", "k2", "keys"])

    return to_python(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, "id long, n long, k1 long, k2 long, keys array<long>")


def confirmed(edges: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """The edges (u, v) whose whole shingle sets A, B have 100 |A and B| >= percent |A or B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            left = [s for b in blocks(batch.column(2)) for s in shingles(words(b, lower=True), size)]
            at = 0
            for b in blocks(batch.column(3)):
                for other in shingles(words(b, lower=True), size):
                    own = left[at]
                    both = len(np.intersect1d(own, other, assume_unique=True)) if min(len(own), len(other)) * 100 >= percent * max(len(own), len(other)) else 0
                    keep[at] = both > 0 and 100 * both >= percent * (len(own) + len(other) - both)
                    at += 1
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    needed = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    texts = perhaps_in(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), needed).join(needed, "id")
    both = edges.join(texts.toDF("u", "tu"), "u").join(texts.toDF("v", "tv"), "v").select("u", "v", "tu", "tv")
    return to_python(both).mapInArrow(run, "u long, v long")


def rare_shingles(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """For each text of `nodes` (id), its rarest shingles: id, n (shingles of the text), m (those that another node has), h, at (place in order of rarity).

    Alike sets share one of the first n - ceil(n percent / 100) + 1 of each in that order, so the others are left out, and
    so are shingles that no other node has. Written as a table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids = batch.column(0).slice(block.lo, len(block))
                sets = shingles(words(block, lower=True), size)
                n = np.array([len(s) for s in sets], np.int64)
                k = np.array([int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64)) for s in sets], np.int64)
                at = np.repeat(np.arange(len(sets)), n)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(k[at]), pa.array(n[at]), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "k", "n", "h"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(nodes.select("id"), "id", "left_semi")
    each = table(to_python(texts).mapInArrow(run, "id long, k long, n long, h long"))
    counted = each.join(each.groupBy("h").agg(F.count("*").alias("f")), "h")
    own = Window.partitionBy("id", "k")
    placed = counted.withColumns({"at": F.row_number().over(own.orderBy("f", "h")) - 1, "m": F.count_if(F.col("f") > 1).over(own)})
    front = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return table(placed.where((F.col("at") < front) & (F.col("f") > 1)).select("id", "n", "m", "h", "at"))


def prefix_pairs(rare: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(u, v) of nodes in different components (groups: id, c) that can be as much alike as `percent` asks.

    At the first shingle that two sets share in order of rarity, what is left of both bounds what they can have in common. For
    each shingle, only nodes outside its most frequent component look for partners, since a pair has one such node at least.
    """
    rows = rare.join(groups, "id").select("h", "id", "n", "at", "c")
    most = rows.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("c", "k").alias("most"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h", "most")
    left = rows.join(most, "h").where("c <> most").drop("most")
    right = rows.toDF("h", "v", "n2", "at2", "d")
    shared = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    good = (F.col("c") != F.col("d")) & ((100 + percent) * shared >= percent * (F.col("n") + F.col("n2"))) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    return left.join(right, "h").where(good).select(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each of `docs`: id_col, n_shingles, component_id (smallest id reachable), kept (id = component_id).

    Null and empty texts have no shingle and link with nothing. Rows of one id are one document with several texts,
    and of repeated rows each is returned. A null id links with nothing: its component_id is null and it is kept.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    prints = table(fingerprints(docs, id_col, text_col, size, bands, rows))
    known = prints.where("id IS NOT NULL AND n > 0")
    classes = known.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"))
    reps = known.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("id").alias("most")).where("rep <> most")
    copies = cut(known.join(reps, ["k1", "k2"]).where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct())

    spread = classes.select("rep", F.explode("keys").alias("key"))
    heads = spread.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key", "low")
    buckets = cut(spread.join(heads, "key").select("key", "rep", "low"))
    tried = cut(buckets.where("rep <> low").select(F.col("rep").alias("u"), F.col("low").alias("v")).distinct())
    links = cut(confirmed(tried, docs, id_col, text_col, size, percent))

    # one step toward the least neighbour is label enough to see which buckets are settled; a label too many costs a check, no link
    near = links.groupBy("u").agg(F.min("v").alias("c")).withColumnRenamed("u", "rep")
    placed = buckets.join(near, "rep", "left").select("key", "rep", F.coalesce("c", "rep").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("from"), F.max("c").alias("to")).where("from <> to").select("key")
    open_ = cut(placed.join(mixed, "key"))
    if not open_.isEmpty():
        nodes = open_.select(F.col("rep").alias("id")).distinct()
        rare = rare_shingles(nodes, docs, id_col, text_col, size, percent)
        # a second star: the member that shares most is the likeliest to be near all the others
        shared = rare.groupBy("id").agg(F.min("n").alias("n"), F.max("m").alias("m")).withColumnRenamed("id", "rep")
        left = open_.join(shared, "rep").select("key", "rep", "c", "n", "m")
        best = F.max_by(F.struct("rep", "c", "n", "m"), F.struct(F.col("m") / F.col("n"), F.xxhash64("rep")))
        right = left.groupBy("key").agg(best.alias("x")).select("key", F.col("x.rep").alias("v"), F.col("x.c").alias("d"), F.col("x.n").alias("n2"), F.col("x.m").alias("m2"))
        most = F.least("m", "m2")  # shared shingles at most; so much alike at best
        able = (F.col("c") != F.col("d")) & (100 * most >= percent * (F.col("n") + F.col("n2") - most))
        pairs = left.join(right, "key").where(able).select(F.greatest("rep", "v").alias("u"), F.least("rep", "v").alias("v"))
        fresh = cut(pairs.distinct().join(tried, ["u", "v"], "left_anti"))
        links, tried = cut(links.union(confirmed(fresh, docs, id_col, text_col, size, percent))), tried.union(fresh)
        # what stars leave apart is compared by its rare shingles
        groups = nodes.join(connected_components(links).toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("c"))
        fresh = cut(prefix_pairs(rare, groups, percent).distinct().join(tried, ["u", "v"], "left_anti"))
        links = links.union(cut(confirmed(fresh, docs, id_col, text_col, size, percent)))

    groups = connected_components(links.union(copies))
    named = groups.toDF("id", "component")
    out = prints.select("id", "n").join(named, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` with one row of each group of near duplicates: the first row of the smallest id, by content (all rows of a null id)."""
    plain, at = plain_columns(docs)
    numbered = with_row_id(plain)
    kept = near_duplicates(numbered, at[id_col], at[text_col], **how).where("kept").select(F.col(at[id_col]).alias("id")).distinct()
    first = numbered.select(F.col(at[id_col]).cast("long").alias("id"), *ROW).groupBy("id").agg(F.min(F.struct(*ROW)).alias("r")).join(kept, "id", "left_semi")
    lone = numbered.where(F.col(at[id_col]).isNull()).select(*ROW)
    return numbered.join(first.select("r.*").union(lone), list(ROW), "left_semi").select(*at.values()).toDF(*docs.columns)


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
