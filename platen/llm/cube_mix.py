"""Mixing sources to target weights by the cube method.

A source's target over its size gives every document of it whole copies and an inclusion probability for one more. The
flight phase moves the probabilities of three documents at a time along the null space of two balancing equations
(document total, token total), until one of the three is taken or left; so both totals stay what they were. It runs
in blocks of bounded size; the two documents or fewer that a block leaves undecided meet in a flight of the next
level, and only the last flight of a source lands, over the last two and a bounded number of documents that were kept for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import ROW, cut, fits_broadcast, plain_columns, to_python, with_row_id
from ._text import blocks, mix, words

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_ROWS = 20_000
EPS = 1e-9


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets that share `share` times all sizes by weight, none above `most` times its size; what is over goes to the others by weight.

    Sources of no size get nothing. Where every source is at its cap, the rest is not handed out.
    """
    out, budget = [0.0] * len(sizes), share * sum(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free:
        unit = budget / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            budget -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` (narrow but for the text) with the text replaced by `size`, its number of words; null has none."""
    rest = [c for c in docs.columns if c != text_col]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(words(b).first) for b in blocks(batch.column(len(rest)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())], names=[*rest, "size"])

    return to_python(docs.select(*rest, text_col)).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", size long")


def flight(p: np.ndarray, x: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities after the flight phase with balancing totals of 1 and x: at most two stay between 0 and 1."""
    p = p.astype(float).copy()
    x = x.astype(float)
    active: list[int] = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = round(p[i])
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[j]) if v > 0 else p[j]) / abs(v) for j, v in zip(active, u, strict=True) if v)
        down = min((p[j] if v > 0 else (1 - p[j])) / abs(v) for j, v in zip(active, u, strict=True) if v)
        move = up if draws[i] * (up + down) < down else -down
        for j, v in zip(active, u, strict=True):
            p[j] += move * v
        left = []
        for j in active:
            if EPS < p[j] < 1 - EPS:
                left.append(j)
            else:
                p[j] = float(p[j] > 0.5)
        active = left
    return p


HELD, LANDING = 256, 14


def landed(p: np.ndarray, x: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities after the flight and the landing: all 0 or 1. The documents come largest first.

    A quarter of the undecided documents, HELD at most and of all sizes, stay out of the flight. With the two that it leaves
    they are the landing problem: its documents are drawn in turn, each with its probability moved by what those before it
    left over or took too much, and of the subsets of the last LANDING the one is taken whose totals come nearest.
    """
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    held = open_[np.unique(np.linspace(0, len(open_) - 1, min(HELD, -(-len(open_) // 4))).astype(int))] if len(open_) else open_
    rest = np.setdiff1d(np.arange(len(p)), held)
    out = p.astype(float).copy()
    out[rest] = flight(p[rest], x[rest], draws[rest])
    todo = np.flatnonzero((out > EPS) & (out < 1 - EPS))
    owed, mass = float(out[todo] @ x[todo]), float(x[todo].sum())
    promised, count = float(out[todo] @ x[todo]), float(out[todo].sum())
    for i in todo[:-LANDING]:
        q = out[i] + ((owed - promised) / mass if mass else 0.0)
        promised, mass = promised - out[i] * x[i], mass - x[i]
        out[i] = float(draws[i] < q)
        owed, count = owed - out[i] * x[i], count - out[i]
    last = todo[-LANDING:]
    if len(last):
        size = x[last].astype(float)
        bits = (np.arange(1 << len(last))[:, None] >> np.arange(len(last)) & 1).astype(float)
        off = np.abs(bits @ size - owed) + np.abs(bits.sum(1) - count) * size.mean() / 16
        out[last] = bits[int(off.argmin())]
    return out


PLACED = "source string, `__row` long, `__at` long, turn long, id long, size long, source_size long, target double, whole int, p double, block long"


def turns(rows: DataFrame) -> DataFrame:
    """`rows` (a checkpoint with ROW) with turn: 0, 1, ... among rows of one content, in any order.

    They are counted by input partition first, so contents that many rows have are numbered in as many tasks.
    """
    rows = rows.withColumn("__n", F.monotonically_increasing_id()).withColumn("part", F.shiftright("__n", 33).cast("int"))
    own = Window.partitionBy(ROW[0])
    counts = rows.groupBy(ROW[0], "part").agg(F.count("*").alias("n"))
    base = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    again = cut(counts.withColumns({"all": F.sum("n").over(own), "base": F.coalesce(base, F.lit(0))}).where("all > 1").select(ROW[0], "part", "base"))
    if again.isEmpty():
        return rows.drop("__n", "part").withColumn("turn", F.lit(0).cast("long"))
    here = F.row_number().over(Window.partitionBy(ROW[0], "part").orderBy("__n")) - 1
    turn = F.when(F.col("base").isNull(), 0).otherwise(F.col("base") + here).cast("long")
    return cut(rows.join(F.broadcast(again) if fits_broadcast(again) else again, [ROW[0], "part"], "left").withColumn("turn", turn).drop("__n", "part", "base"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row for each of `docs`: source, ROW, id, size, source_size, target, copies (how often the mix takes the document).

    Sources stand in order of code points, null last, and get `weights` in turn. Nulls in the text count as no words, a null id is
    an id like any other, repeated rows are documents of their own; an empty table gives no rows. Reruns agree, wherever
    the table is stored and however it is cut into files: order and draws are hashes of the rows' contents, and rows of one
    content are numbered. The driver sees one row for each source.
    """
    plain, at = plain_columns(docs)
    return _copies(with_row_id(plain), at[id_col], at[text_col], at[source_col], **how)


def _copies(numbered: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_rows: int = BLOCK_ROWS, seed: int = 11) -> DataFrame:
    docs = numbered
    narrow = numbered.select(F.col(source_col).cast("string").alias("source"), *ROW, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = turns(cut(word_counts(narrow, "text")))
    by = rows.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    by.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    goal = targets([r["s"] for r in by], [weights[i % len(weights)] for i in range(len(by))], share, most)
    per = pd.DataFrame({"k": [r["source"] for r in by], "source_size": [r["s"] for r in by], "target": goal, "blocks": [max(1, -(-r["n"] // block_rows)) for r in by]}, columns=["k", "source_size", "target", "blocks"]).astype({"source_size": "int64", "target": "float64", "blocks": "int64"})
    spark = docs.sparkSession
    listed = spark.createDataFrame([(None if pd.isna(k) else k, int(s), float(t), int(b)) for k, s, t, b in per.itertuples(index=False)], "k string, source_size long, target double, blocks long")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = rows.join(listed, F.col("source").eqNullSafe(F.col("k"))).withColumn("whole", F.floor(ratio + EPS).cast("int"))
    place = F.pmod(F.xxhash64(ROW[0], "turn", F.lit(seed)), F.col("blocks"))
    placed = placed.select("source", *ROW, "turn", "id", "size", "source_size", "target", "whole", F.greatest(F.lit(0.0), ratio - F.col("whole")).alias("p"), place.alias("block"))

    def fly(pieces: pa.Table, land: bool) -> pa.Table:
        own, turn = pieces[ROW[0]].to_numpy(), pieces["turn"].to_numpy()
        keys = mix((own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (turn.astype(np.uint64) + np.uint64(seed)) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.lexsort((turn, own, keys, -pieces["size"].to_numpy()))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        draws = (mix(keys[order] + np.uint64(1)) >> np.uint64(11)) / float(1 << 53)
        p = (landed if land else flight)(pieces["p"].to_numpy()[order], pieces["size"].to_numpy()[order], draws)
        return pieces.set_column(pieces.schema.get_field_index("p"), "p", pa.array(p[back]))

    def level(df: DataFrame, last: bool) -> DataFrame:
        return cut(df.groupBy("source", "block").applyInArrow(lambda pieces: fly(pieces, last), PLACED))

    most_blocks = int(per["blocks"].max()) if len(per) else 1
    now, done = placed, []
    while True:
        last = most_blocks <= 1
        now = level(now, last)
        done.append(now if last else now.where(f"p < {EPS} OR p > {1 - EPS}"))
        if last:
            break
        fan = block_rows // 2
        most_blocks = -(-most_blocks // fan)
        now = now.where(f"p >= {EPS} AND p <= {1 - EPS}").withColumn("block", F.expr(f"block div {fan}"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("source", *ROW, "id", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("int")).alias("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents of the mix, all columns, each as often as the mix takes it."""
    plain, at = plain_columns(docs)
    numbered = with_row_id(plain)
    taken = _copies(numbered, at[id_col], at[text_col], at[source_col], **how).where("copies > 0").select(*ROW, "copies")
    return numbered.join(taken, list(ROW)).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*at.values()).toDF(*docs.columns)


def op8_cube_mix(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: what the mix takes of each document."""
    got = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
