"""8-connected components of masks, by runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.functions.groups import dealt, starts, whole_groups
from platen.operators.stencil import BAND
from platen.sources.store import cut


def spread_minimum(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of the nodes in `edges` (u, v): the least node that each reaches.

    Every round, each node's neighbours and the node itself move to the least of them, first among the larger, then
    among the smaller ones; edges turn into stars. A round ends in a checkpoint. Raises if they don't settle.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == found:
            break
        state = found
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        up = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = cut(up.join(low, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(now.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that each reaches by the edges u, v."""
    root = np.arange(n)
    while len(u):
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (root[root] != root).any():
            root = root[root]
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    return root


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (image_id, y, s, e, comp, strong) of pixels (image_id, b, y, x, strong) that come in whole bands, in order."""
    made = TaskContext.get().partitionId() << 40
    for table in whole_groups(batches, ("image_id", "b")):
        image, y, x, strong = (table.column(c).to_numpy() for c in ("image_id", "y", "x", "strong"))
        begin = np.zeros(len(x), bool)
        begin[starts(table, ("image_id", "b"))] = True
        # places of lines: consecutive within a band, and apart between bands
        line = np.cumsum(np.where(begin, 2, np.diff(y, prepend=y[:1])).astype(np.int64))
        first = np.flatnonzero(begin | (np.diff(line, prepend=-1) != 0) | (np.diff(x, prepend=x[:1]) != 1))
        last = np.append(first[1:], len(x)) - 1
        s, e, at, wide = x[first].astype(np.int64), x[last].astype(np.int64), line[first], int(x.max()) + 3
        lo = np.searchsorted(at * wide + e, (at + 1) * wide + s - 1, "left")
        count = np.maximum(np.searchsorted(at * wide + s, (at + 1) * wide + e + 1, "right") - lo, 0)
        u = np.repeat(np.arange(len(s)), count)
        v = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(len(u))
        root = _labels(len(s), u, v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
        columns = (image[first], y[first], s, e, root + made, np.maximum.reduceat(strong, first))
        made += len(s)
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], names=["image_id", "y", "s", "e", "comp", "strong"])


def labelled_runs(mask: DataFrame, band: int = BAND) -> DataFrame:
    """image_id, y, s, e of the runs of pixels of a mask (rows image_id, y, x: the pixels that are set; with strong, a boolean, also whether a run has such a pixel),
    with `comp`, which names a component within the whole table. Runs of neighbouring rows whose spans touch are one component.

    Pixels are dealt out once, by image and band of `band` rows, and a task labels a band at a time; only components that meet where two bands meet are joined afterwards.
    """
    flag = F.col("strong") if "strong" in mask.columns else F.lit(False)
    px = mask.select(F.col("image_id").cast("long").alias("image_id"), F.floor(F.col("y") / band).cast("int").alias("b"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), flag.alias("strong"))
    lines = cut(dealt(px, ("image_id", "b"), ("y", "x")).mapInArrow(_bands, "image_id long, y int, s int, e int, comp long, strong boolean"))
    if "strong" not in mask.columns:
        lines = lines.drop("strong")
    above = lines.where(F.pmod("y", F.lit(band)) == band - 1)
    below = lines.where((F.col("y") > 0) & (F.pmod("y", F.lit(band)) == 0)).select("image_id", (F.col("y") - 1).alias("y"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("comp").alias("v"))
    seams = cut(above.join(below.hint("merge"), ["image_id", "y"]).where("s2 <= e + 1 AND e2 >= s - 1").select(F.col("comp").alias("u"), "v").distinct())
    if seams.isEmpty():
        return lines
    roots = spread_minimum(seams)
    rest = [c for c in lines.columns if c != "comp"]
    return lines.join(roots, lines["comp"] == roots["node"], "left").select(*rest, F.coalesce("root", "comp").alias("comp"))


def components(mask: DataFrame) -> DataFrame:
    """image_id, comp, area, min_y, max_y, min_x, max_x."""
    size = F.sum(F.col("e") - F.col("s") + 1).cast("long")
    return labelled_runs(mask).groupBy("image_id", "comp").agg(size.alias("area"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.min("s").alias("min_x"), F.max("e").alias("max_x"))
