"""Jaccard join of documents by a blocked sparse matrix product of documents by n-grams.

The matrix has a row for each different set of n-grams and a column for each n-gram. A product of two rows is their overlap.
What doesn't have to be multiplied is left out, and none of it loses a pair that is alike enough:

* A row's first n-grams by hash, and of these the rarest by their counts over the corpus, suffice to find a pair. If sets of na
  and nb n-grams link, each `front` (p of n by hash) shares g at least, and after the x - 1 most frequent of each front are left
  out, one at least. So what most of the corpus says is in no row's part, unless a text is made of nothing else.
* Rows lie in cells by size, and only sizes that can link meet.

Each column names its most central row, and rows that share many columns with a central row form families. A family's rows are
multiplied on their full sets in blocks of bounded size, in numpy: overlap counts add up over blocks of columns, pairs below the
bound of their sizes go, and a block gives out a forest of links, so that near copies aren't paired out. Rows of different
families and components meet in the columns they share, unless bitmaps of their fronts rule them out; counts add up in each task
and then over tasks, pairs below the bound that follows from their sizes go before a text is read, and the few others are
confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut, perhaps_in, table, to_python
from ._text import U, blocks, mix, shingles, words
from .graph import connected_components
from .minhash import confirmed

#: Rows and n-grams of a block, columns multiplied at once, and rows of a column that is multiplied by its pairs.
BLOCK_ROWS, BLOCK_GRAMS, COLUMNS, RARE = 1024, 1 << 21, 4096, 8
#: Words of a front's bitmap.
MAPS = 4
BITMAP = tuple(f"m{i}" for i in range(MAPS))


def needed(n, percent: int):
    """The overlap that a set of n n-grams has with any set that it links with, at least (n and the result numbers, arrays or columns)."""
    return -(-n * percent // 100) if not isinstance(n, Column) else F.ceil(n * percent / 100)


def look(n, percent: int):
    """g: how many of the fronts' n-grams linked sets share at least; as large as what a link may leave out."""
    if isinstance(n, Column):
        return F.greatest(F.lit(1), F.floor(n * (100 - percent) / 100))
    return np.maximum(1, n * (100 - percent) // 100)


def front(n, percent: int):
    """p: how many n-grams of a set, first by hash, are its front."""
    return n - needed(n, percent) + look(n, percent)


def spare(n, percent: int):
    """x: the least g of all sizes that a set of n may link with; its front may lose x - 1."""
    return look(needed(n, percent), percent)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """id, n (distinct n-grams of the whole text), k1 and k2 (128 bits that are equal for equal sets), front (the front's n-grams; none if n is 0), m0 to m3 (a bitmap of the front)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = shingles(words(block, lower=True), size)
                n = np.array([len(s) for s in sets], np.int64)
                k = [pa.array(np.array([int(f(s).sum(dtype=U).view(np.int64)) for s in sets], np.int64)) for f in (lambda s: mix(s ^ U(0x5851F42D4C957F2D)), lambda s: mix(s + U(0x14057B7EF767814F)))]
                sizes = np.where(n > 0, front(n, percent), 0)
                flat = np.concatenate([s[:p] for s, p in zip(sets, sizes.tolist(), strict=True)]).view(np.int64)
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                bits = np.zeros((len(sets), 64 * MAPS), bool)
                bits[np.repeat(np.arange(len(sets)), sizes), flat & (64 * MAPS - 1)] = True
                maps = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                columns = [batch.column(0).slice(block.lo, len(block)), pa.array(n), *k, pa.ListArray.from_arrays(ends, pa.array(flat)), *[pa.array(m) for m in maps.T.copy()]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "k1", "k2", "front", *BITMAP])

    return to_python(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, "id long, n long, k1 long, k2 long, front array<long>, " + ", ".join(f"{m} long" for m in BITMAP))


def different(prints: DataFrame) -> DataFrame:
    """row, id (the least), n, k (half of the set's 128 bits), front, m0 to m3: one row for each different set, as a table."""
    each = prints.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "front", *BITMAP)])
    return table(each.select(F.monotonically_increasing_id().alias("row"), "id", "n", F.col("k1").alias("k"), "front", *BITMAP))


def incidence(rows: DataFrame, percent: int) -> DataFrame:
    """row, n, shared (of the front's n-grams, the part that another row has), h: the matrix, one row for each n-gram of a row that takes part."""
    # counts and the join with them read one exchange, which has to be of the same rows and columns for both (no row is null or below 0)
    each = rows.where("row IS NOT NULL").select("row", F.explode("front").alias("h")).repartition("h")
    often = each.groupBy("h").agg(F.count_if(F.col("row") >= 0).alias("f")).where("f > 1")
    own = Window.partitionBy("row")
    placed = each.join(often, "h").withColumns({"at": F.row_number().over(own.orderBy("f", "h")), "m": F.count("*").over(own)}).join(rows.select("row", "n"), "row")
    n, p = F.col("n"), front(F.col("n"), percent)
    # what no other row has is the rarest and comes first
    kept = placed.where(F.col("at") + (p - F.col("m")) <= p - spare(n, percent) + 1)
    return table(kept.select("row", "n", (F.col("m") / p).alias("shared"), "h"))


def bound(a: Column, b: Column, percent: int) -> Column:
    """The count of common columns below which sets of sizes a and b can't link."""
    both = F.ceil((a + b) * percent / (100 + percent))
    beyond = F.greatest(a - front(a, percent), b - front(b, percent))
    return both - beyond - F.greatest(spare(a, percent), spare(b, percent)) + 1


def able(a: Column, b: Column, other: str, percent: int) -> Column:
    """Whether sets of sizes a and b can link, by their fronts' bitmaps (the second one's named with `other`): an n-gram whose bit the other front lacks isn't in that front."""
    gone = lambda x, y: sum(F.bit_count(F.col(f"{m}{x}").bitwiseAND(F.bitwise_not(F.col(f"{m}{y}")))) for m in BITMAP)
    most = F.least(front(a, percent) - gone("", other), front(b, percent) - gone(other, ""))
    return most >= F.ceil((a + b) * percent / (100 + percent)) - F.greatest(a - front(a, percent), b - front(b, percent))


def in_cells(matrix: DataFrame, percent: int) -> DataFrame:
    """The rows with b (their class by size) and, twice, cell: sizes that can link lie in one class or in two that follow each other, and such rows meet in the cell of the greater one."""
    b = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / (percent - 1))).cast("int")
    return matrix.withColumn("b", b).withColumn("cell", F.explode(F.array(F.col("b"), F.col("b") + 1)))


def families(cells: DataFrame, percent: int) -> DataFrame:
    """row, family: rows joined with the central row that they share most columns with, if these are half of what a link needs at least."""
    centre = F.max_by(F.struct("row", "n", "b"), F.struct("shared", F.xxhash64("row"))).alias("x")
    stars = cells.groupBy("h", "cell").agg(centre, F.count("*").alias("rows")).where("rows > 1")
    stars = stars.select("h", "cell", F.col("x.row").alias("v"), F.col("x.n").alias("n2"), F.col("x.b").alias("b2"))
    fits = (F.col("row") != F.col("v")) & (F.col("cell") == F.greatest("b", "b2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    met = cells.join(stars, ["h", "cell"]).where(fits).groupBy("row", "v", "n", "n2").agg(F.count("*").alias("c"))
    near = met.where(2 * F.col("c") >= bound(F.col("n"), F.col("n2"), percent))
    home = cut(near.groupBy("row").agg(F.max_by("v", F.struct("c", "v")).alias("v")))
    return connected_components(home.select(F.col("row").alias("u"), "v")).toDF("row", "family")


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Overlap counts of the sets left[i] and right[j] (places in `sets`), added up over blocks of columns; of a set with itself no count."""
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(left), len(right)), np.float32)
    often = np.bincount(column)
    wide = np.flatnonzero(often > RARE)
    place = np.full(len(often), -1)
    place[wide] = np.arange(len(wide))
    # columns of many rows by dense blocks
    at = place[column]
    for a in range(0, len(wide), COLUMNS):
        here = np.flatnonzero((at >= a) & (at < a + COLUMNS))
        block = np.zeros((len(sets), min(COLUMNS, len(wide) - a)), np.float32)
        block[row[here], at[here] - a] = 1
        out += block[left] @ block[right].T
    # columns of few rows by their pairs
    few = np.flatnonzero((often[column] > 1) & (at < 0))
    few = few[np.argsort(column[few], kind="stable")]
    to_left, to_right = np.full(len(sets), -1), np.full(len(sets), -1)
    to_left[left], to_right[right] = np.arange(len(left)), np.arange(len(right))
    for step in range(1, min(RARE, len(few))):
        a, b = few[:-step], few[step:]
        same = column[a] == column[b]
        for u, v in ((row[a][same], row[b][same]), (row[b][same], row[a][same])):
            fit = (to_left[u] >= 0) & (to_right[v] >= 0)
            np.add.at(out, (to_left[u][fit], to_right[v][fit]), 1)
    return out


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (u, v) between sets left[i] and right[j] that join all that any of their links joins."""
    n = np.array([len(s) for s in sets], np.float64)
    both = overlaps(sets, left, right)
    linked = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
    out, open_left, open_right = [], np.ones(len(left), bool), np.ones(len(right), bool)
    for seed in range(len(left)):
        if not open_left[seed]:
            continue
        open_left[seed] = False
        found_left, found_right = np.array([seed]), np.zeros(0, np.int64)
        while len(found_left):
            found_right = np.flatnonzero(linked[found_left].any(axis=0) & open_right)
            open_right[found_right] = False
            out += [(left[seed], right[j]) for j in found_right.tolist()]
            found_left = np.flatnonzero(linked[:, found_right].any(axis=1) & open_left)
            open_left[found_left] = False
            out += [(left[seed], left[i]) for i in found_left.tolist()]
    return out


def family_links(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(u, v): ids of links that join, within each family (members: id, k, n, family, b), all that links of its rows join.

    A family's rows in a cell are dealt into blocks of some BLOCK_ROWS rows or BLOCK_GRAMS n-grams, and each pair of blocks is a
    product of its own.
    """
    cells = members.withColumn("cell", F.explode(F.array(F.col("b"), F.col("b") + 1)))
    counted = cells.groupBy("family", "cell").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"), F.max("b").alias("top")).where("rows > 1 AND top = cell")
    parts = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    dealt = cells.join(counted.select("family", "cell", parts.alias("parts")), ["family", "cell"])
    dealt = dealt.select("id", "k", "family", "cell", "parts", F.pmod(F.xxhash64("k", "id"), F.col("parts")).cast("int").alias("own"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["family", "cell", "parts", "own", "id", "grams"]
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for block in blocks(batch.column(6)):
                found = shingles(words(block, lower=True), size)
                same = np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64) for s in found], np.int64) == keys[block.lo : block.lo + len(found)]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                part = batch.slice(block.lo, len(found))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(4), part.column(5), part.column(0), lists], names=names).filter(pa.array(same))

    texts = perhaps_in(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), members.select("id")).join(dealt, "id").select("id", "k", "family", "cell", "parts", "own", "text")
    whole = to_python(texts).mapInArrow(sets, "family long, cell int, parts int, own int, id long, grams array<long>")
    pairs = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).select("family", "cell", "low", "high", "own", "id", "grams")
    by = ["family", "cell", "low", "high"]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch, i) for batch in batches for i in range(len(batch)))
        for _, group in groupby(rows, key=lambda r: tuple(c[r[1]].as_py() for c in r[0].columns[:4])):
            own, ids, found, high = [], [], [], 0
            for batch, i in group:
                high = batch.column(3)[i].as_py()
                own.append(batch.column(4)[i].as_py())
                ids.append(batch.column(5)[i].as_py())
                found.append(np.array(batch.column(6)[i].values).view(np.uint64))
            own = np.array(own)
            right = np.flatnonzero(own == high)
            left = np.flatnonzero(own != high) if (own != high).any() else right
            edges = [(ids[u], ids[v]) for u, v in forest(found, left, right, percent) if ids[u] != ids[v]]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return to_python(pairs.repartition(*by).sortWithinPartitions(*by)).mapInArrow(product, "u long, v long")


def across(cells: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(u, v), u > v: ids of rows in different families and components (groups: row, id, family, c, m0 to m3) whose overlap reaches the bound of their sizes."""
    held = table(cells.drop("shared").join(groups, "row"))
    most = held.groupBy("h", "cell", "family").agg(F.count("*").alias("rows")).groupBy("h", "cell").agg(F.max_by("family", F.struct("rows", "family")).alias("most"), F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi")
    # of two rows in different families, one is outside the column's largest
    left = held.join(most.select("h", "cell", "most"), ["h", "cell"]).where("family <> most")
    right = held.select("h", "cell", F.col("row").alias("row2"), F.col("id").alias("v"), F.col("n").alias("n2"), F.col("b").alias("b2"), F.col("c").alias("d"), F.col("family").alias("family2"), *[F.col(m).alias(f"{m}_") for m in BITMAP])
    fits = (F.col("cell") == F.greatest("b", "b2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (F.col("id") != F.col("v"))
    # where both are outside it, each looks for the other, and one of them is enough
    once = (F.col("family2") == F.col("most")) | (F.col("row") > F.col("row2"))
    apart = left.join(right, ["h", "cell"]).where(fits & (F.col("c") != F.col("d")) & (F.col("family") != F.col("family2")) & once & able(F.col("n"), F.col("n2"), "_", percent))
    one, other = F.struct("row", "id", "n"), F.struct(F.col("row2").alias("row"), F.col("v").alias("id"), F.col("n2").alias("n"))
    summed = apart.groupBy(F.greatest(one, other).alias("a"), F.least(one, other).alias("b")).agg(F.count("*").alias("shared"))
    return summed.where(F.col("shared") >= bound(F.col("a.n"), F.col("b.n"), percent)).select(F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")).distinct()


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """One row for each of `docs`: id_col, n_shingles, component_id (smallest id reachable by links, itself included).

    Two documents link when 100 * intersection >= percent * union of their sets of `size` words. A text with fewer words is one
    n-gram; null and empty texts have none and link with nothing. Rows of one id are one document with several texts, and of
    repeated rows each is returned. A null id links with nothing and its component_id is null. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    prints = table(sketches(docs, id_col, text_col, size, percent))
    known = prints.where("id IS NOT NULL AND n > 0")
    same = known.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("id").alias("most")).where("rep <> most")
    copies = cut(known.join(same, ["k1", "k2"]).where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct())

    rows = different(prints)
    matrix = incidence(rows, percent)
    cells = in_cells(matrix, percent)
    own = families(cells, percent)
    members = rows.join(own, "row").select("row", "id", "k", "n", "family")
    sizes = matrix.select("row", "n").distinct()
    near = cut(in_cells(members, percent).select("id", "k", "n", "family", "b").distinct())
    links = cut(family_links(near, docs, id_col, text_col, size, percent))

    joined = connected_components(links).toDF("id", "component")
    groups = sizes.select("row").join(rows.select("row", "id", *BITMAP), "row").join(own, "row", "left").join(joined, "id", "left")
    groups = groups.select("row", "id", F.coalesce("family", -F.col("row") - 1).alias("family"), F.coalesce("component", "id").alias("c"), *BITMAP)
    fresh = cut(across(cells, groups, percent))
    links = links.union(cut(confirmed(fresh, docs, id_col, text_col, size, percent)))

    named = connected_components(links.union(copies)).toDF("id", "component")
    return prints.select("id", "n").join(named, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op13_blocked_ngram_join(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over all documents."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
