"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends from region to rack to shard. At each level every child draws -ln(u) / weight, u a hash of the row's key
and the child's name, and the least draw wins, so children take rows in proportion to their weights (a rack weighs
what its shards do, a region what its racks do). A draw depends on nothing but key, child and weight: a changed weight
moves rows only into or out of the subtree that holds it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import cut


@dataclass(frozen=True)
class Rack:
    name: str
    shards: dict[int, float]

    @property
    def weight(self) -> float:
        return sum(self.shards.values())


@dataclass(frozen=True)
class Region:
    name: str
    racks: tuple[Rack, ...]

    @property
    def weight(self) -> float:
        return sum(r.weight for r in self.racks)


def even_tree(shards: int, regions: int = 4, racks: int = 2) -> tuple[Region, ...]:
    """`shards` shards of weight 1, dealt evenly over regions and their racks."""
    deal = [[[] for _ in range(racks)] for _ in range(regions)]
    for s in range(shards):
        deal[s % regions][s // regions % racks].append(s)
    return tuple(Region(f"region{i}", own) for i, of in enumerate(deal) if (own := tuple(Rack(f"region{i}/rack{j}", dict.fromkeys(x, 1.0)) for j, x in enumerate(of) if x)))


def grown(tree: tuple[Region, ...], shard: int, weight: float = 1.0) -> tuple[Region, ...]:
    """One more shard, which opens a region of its own: no other subtree's weight changes, so rows move only into it."""
    return (*tree, Region(f"grown{shard}", (Rack(f"grown{shard}/rack0", {shard: weight}),)))


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def _least(key: Column, children: list[tuple[str, float, int]]) -> Column:
    """The place of the child with the least draw."""
    if len(children) == 1:
        return F.lit(children[0][2])
    return F.least(*[F.struct(_draw(key, name, weight).alias("d"), F.lit(i).alias("i")) for name, weight, i in children])["i"]


def _choose(place: Column, options: list[Column]) -> Column:
    out = None
    for i, option in enumerate(options):
        out = F.when(place == i, option) if out is None else out.when(place == i, option)
    return out


def descend(df: DataFrame, tree: tuple[Region, ...], key: str, out: str) -> DataFrame:
    """`df` with column `out`, the shard that `key` (null is a key too) reaches. Shards of weight 0 take nothing."""
    tree = tuple(r for r in tree if r.weight > 0)
    at = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    region, rack = f"__{out}_region", f"__{out}_rack"
    live = [[r for r in x.racks if r.weight > 0] for x in tree]
    df = df.withColumn(region, _least(at, [(r.name, r.weight, i) for i, r in enumerate(tree)]))
    df = df.withColumn(rack, _choose(F.col(region), [_least(at, [(r.name, r.weight, i) for i, r in enumerate(racks)]) for racks in live]))
    leaf = lambda r: _least(at, [(f"{r.name}/shard{s}", w, s) for s, w in r.shards.items() if w > 0])
    shard = _choose(F.col(region), [_choose(F.col(rack), [leaf(r) for r in racks]) for racks in live])
    return df.withColumn(out, shard.cast("int")).drop(region, rack)


def assign(docs: DataFrame, tree: tuple[Region, ...], id_col: str = "doc_id", text_col: str = "text", more: tuple[Region, ...] | None = None) -> DataFrame:
    """One row for each of `docs`: id_col, size, text_crc32, shard, slot and, if `more` is given, grown_shard (its shard in that tree).

    slot numbers a shard's rows from 0 without gaps. Rows are numbered within (input partition, shard), and partitions
    follow each other by their counts, so a hot key, or a shard that holds a third of all rows, is spread over as many
    tasks as the input has partitions. Null text has no bytes (crc of the empty string); a null id is a key like any other; rows of
    one id share a shard and have slots of their own; an empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = descend(rows, tree, "id", "shard")
    if more:
        rows = descend(rows, more, "id", "grown_shard")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33).cast("int")))
    from pyspark.sql import Window

    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("shard", "part", F.coalesce(upto, F.lit(0)).alias("base"))
    here = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    placed = rows.withColumn("here", here).join(bases, ["shard", "part"])
    names = [F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("here")).cast("long").alias("slot")]
    return placed.select(*names, *(["grown_shard"] if more else []))


def op3_weighted_hash_tree(spark, sf_dir: str) -> DataFrame:
    """All documents on shards 0 to 39, and where they stand with a shard 40."""
    tree = even_tree(40)
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), tree, more=grown(tree, 40))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
