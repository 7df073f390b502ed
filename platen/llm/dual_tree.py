"""Exact ranked lexical search by two trees.

Items (queries) and documents are each put into a hierarchy whose nodes hold coordinate maxima: for a node of items the most
that a term weighs in one of them, for a node of documents the most that it counts in one of them. The product of two nodes'
maxima bounds every score between them. A pair of nodes whose bound is below the weakest kth score of its items is left with
all below it; only pairs of leaves that remain are scored. So nothing that could rank is lost.

Documents are read once, into the sparse counts of the items' terms. A first round over a part of them, picked by hash, sets
each item's kth score from below; the second one goes over all documents with these. Each task keeps k rows an item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut, table, to_python
from ._text import blocks, words

#: Items that are searched together, and characters of them; items and documents of a leaf; children of a node; leaves of a tree of documents, and values of their maxima.
BLOCK_ITEMS, BLOCK_CHARS, ITEM_LEAF, DOC_LEAF, FAN, DOC_LEAVES, LEAF_VALUES = 256, 1 << 20, 8, 32, 8, 64, 1 << 22
#: The first round reads one document in so many.
FIRST = 32
#: Bytes between terms: all of ASCII but digits and letters.
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def term_counts(text: str | None) -> Counter:
    """Terms of one text by their hashes."""
    found = [words(b, lower=True, apart=_APART).hashes for b in blocks(pa.array([text or ""]))]
    return Counter(np.concatenate(found).tolist() if found else [])


@dataclass
class Node:
    """Items of a node, their terms, and what a term weighs at most; a leaf has each item's weights, other nodes have children."""

    items: np.ndarray
    terms: np.ndarray
    most: np.ndarray
    weights: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)


def item_tree(items: list[tuple[np.ndarray, np.ndarray]], exact: type) -> Node:
    """Tree of items given as (terms, weights). Items whose heaviest terms agree stand together."""
    order = sorted(range(len(items)), key=lambda i: [t for _, t in sorted(zip((-items[i][1]).tolist(), items[i][0].tolist(), strict=True))[:3]])
    nodes = []
    for a in range(0, len(order), ITEM_LEAF):
        own = order[a : a + ITEM_LEAF]
        terms = np.unique(np.concatenate([items[i][0] for i in own]))
        weights = np.zeros((len(own), len(terms)), exact)
        for row, i in zip(weights, own, strict=True):
            row[np.searchsorted(terms, items[i][0])] = items[i][1]
        nodes.append(Node(np.array(own), terms, weights.max(axis=0, initial=0), weights))
    while len(nodes) > 1:
        above = []
        for a in range(0, len(nodes), FAN):
            own = nodes[a : a + FAN]
            terms = np.unique(np.concatenate([n.terms for n in own]))
            most = np.zeros(len(terms), exact)
            for n in own:
                at = np.searchsorted(terms, n.terms)
                most[at] = np.maximum(most[at], n.most)
            above.append(Node(np.concatenate([n.items for n in own]), terms, most, None, own))
        nodes = above
    return nodes[0]


class DocTree:
    """Tree of documents given as sparse rows (row, term, count's value), `n` of them; leaf i has the documents order[DOC_LEAF i:][:DOC_LEAF]."""

    def __init__(self, n: int, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, weight: np.ndarray, exact: type):
        self.n, self.width, self.exact = n, len(weight), exact
        # documents with the same rarest term stand together
        rarest = np.full(n, -1, np.int64)
        heavy = np.argsort(weight, kind="stable").argsort(kind="stable")
        np.maximum.at(rarest, rows, heavy[terms])
        self.order = np.argsort(-rarest, kind="stable")
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        by = np.argsort(place[rows], kind="stable")
        self.place, self.terms, self.values = place[rows][by], terms[by], values[by]
        leaves = -(-n // DOC_LEAF)
        self.starts = np.searchsorted(self.place, np.arange(leaves + 1) * DOC_LEAF)
        low = np.zeros((leaves, self.width), exact)
        np.maximum.at(low, (self.place // DOC_LEAF, self.terms), self.values)
        self.levels = [low]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    def leaf(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, their values by term) of a leaf."""
        a, b = self.starts[i], self.starts[i + 1]
        docs = self.order[i * DOC_LEAF : (i + 1) * DOC_LEAF]
        out = np.zeros((len(docs), self.width), self.exact)
        out[self.place[a:b] - i * DOC_LEAF, self.terms[a:b]] = self.values[a:b]
        return docs, out


class Best:
    """The k best documents so far of each item: by score, then known ids before null ones, then id."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.copy()
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(floors)

    def take(self, item: int, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        s, n, d = (np.concatenate(x) for x in zip(self.rows[item], (scores, nulls, ids), strict=True))
        top = np.lexsort((d, n, -s))[: self.k]
        self.rows[item] = s[top], n[top], d[top]
        if len(top) == self.k:
            self.floors[item] = max(self.floors[item], s[top[-1]])


def search(items: Node, docs: DocTree, ids: np.ndarray, nulls: np.ndarray, best: Best) -> int:
    """Takes the documents of a tree into `best`; returns how many pairs of an item and a document were scored."""
    left: dict[int, list[tuple[float, Node]]] = {}
    stack = [(items, len(docs.levels) - 1, 0)]
    while stack:
        node, level, i = stack.pop()
        bound = node.most @ docs.levels[level][i, node.terms]
        if bound <= 0 or bound < best.floors[node.items].min():
            continue
        if level == 0 and not node.children:
            left.setdefault(i, []).append((bound, node))
            continue
        below = range(i * FAN, min((i + 1) * FAN, len(docs.levels[level - 1]))) if level else (i,)
        stack += [(n, max(level - 1, 0), j) for n in node.children or [node] for j in below]
    scored = 0
    for i, pairs in sorted(left.items(), key=lambda x: -max(bound for bound, _ in x[1])):
        pairs = [node for bound, node in pairs if bound >= best.floors[node.items].min()]
        if not pairs:
            continue
        own, values = docs.leaf(i)
        for node in pairs:
            scores = (node.weights @ values[:, node.terms].T).astype(np.int64)
            scored += scores.size
            for item, line in zip(node.items.tolist(), scores, strict=True):
                fit = np.flatnonzero((line > 0) & (line >= best.floors[item]))
                if len(fit):
                    best.take(item, line[fit], nulls[own[fit]], ids[own[fit]])
    return scored


def counted(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """id, n (terms of the whole text, repeats included), terms (places in the sorted hashes `vocabulary`), tf: one row a document."""
    width = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = words(block, lower=True, apart=_APART)
                at = np.minimum(np.searchsorted(vocabulary, found.hashes), max(width - 1, 0))
                hit = np.flatnonzero(vocabulary[at] == found.hashes) if width else at[:0]
                key, tf = np.unique((np.searchsorted(found.first, hit, "right") - 1) * max(width, 1) + at[hit], return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(block) + 1) * max(width, 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((key % max(width, 1), pa.int32()), (tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, len(block)), pa.array(np.diff(found.first), pa.int64()), *lists], names=["id", "n", "terms", "tf"])

    return to_python(docs).mapInArrow(run, "id long, n long, terms array<int>, tf array<long>")


def _ranked(sparse: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, floors: np.ndarray, k: int, exact: type) -> DataFrame:
    """item (place in `items`), id, score of the k best documents of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, best = item_tree(items, exact), Best(floors, k)
        size = DOC_LEAF * max(1, min(DOC_LEAVES, LEAF_VALUES // len(weight)))
        for whole in batches:
            for a in range(0, len(whole), size):
                batch = whole.slice(a, size)
                lists = batch.column(2)
                per = np.diff(lists.offsets.to_numpy())
                rows, terms, tf = np.repeat(np.arange(len(batch)), per), lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                m = 75 + (25 * n_docs * batch.column(1).to_numpy()) // n_terms
                values = (1000000000 * tf) // (1000 * tf + 12 * m[rows])
                ids = batch.column(0)
                search(tree, DocTree(len(batch), rows, terms, values, weight, exact), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), best)
        item = np.repeat(np.arange(len(items)), [len(r[0]) for r in best.rows])
        scores, nulls, ids = (np.concatenate([r[i] for r in best.rows]) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=nulls), pa.array(scores, pa.int64())], names=["item", "id", "score"])

    near = sparse.mapInArrow(run, "item long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), id_col, score: the k documents of highest score above 0 for each item (all, if fewer), ties to smaller ids, null ids last.

    Terms are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased. Null and empty texts have no term.
    Rows of one item id are one item with the terms of all of them, and a null id is an id. Each row of `docs` is a
    document of its own, repeated ones too. Other columns are ignored, whatever their names. Without documents or items
    that have a term there are no rows. Terms are told apart by 64-bit hashes.

    Items are searched in blocks of BLOCK_ITEMS items or BLOCK_CHARS characters (on average), and only a block comes to the driver at once.
    """
    spark = docs.sparkSession
    named = cut(items.groupBy(F.col(item_id).alias("item")).agg(F.collect_list(F.col(item_text)).alias("texts"), F.sum(F.length(F.col(item_text))).alias("size")))
    n_items, chars = named.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_blocks = max(1, -(-n_items // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for b in range(n_blocks):
        own = [(r["item"], sum(map(term_counts, r["texts"]), Counter())) for r in named.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).collect()]
        own = [x for x in own if x[1]]
        vocabulary = np.unique(np.array([h for _, c in own for h in c], np.uint64))
        sparse = table(counted(texts, vocabulary))
        n_docs, n_terms = sparse.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not own:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for t, n in sparse.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the block's items at most
            df[t] = n
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        rows = []
        for _, c in own:
            terms = np.searchsorted(vocabulary, np.array(sorted(c), np.uint64))
            rows.append((terms, weight[terms] * np.array([c[h] for h in sorted(c)], np.int64)))
        # doubles add whole numbers below 2 ** 53 without error
        exact = np.float64 if max(w.sum() for _, w in rows) < 2**53 // 10**6 else np.int64
        how = dict(items=rows, weight=weight, n_docs=n_docs, n_terms=n_terms, k=k, exact=exact)
        some = _ranked(sparse.where(F.pmod(F.xxhash64("id", "n"), F.lit(FIRST)) == 0), floors=np.ones(len(rows), np.int64), **how)
        floors = np.ones(len(rows), np.int64)
        for item, score in some.where(F.col("rank") == k).select("item", "score").collect():  # one row an item of the block
            floors[item] = score
        ids = spark.createDataFrame([(i, own[i][0]) for i in range(len(own))], f"item long, name {named.schema['item'].dataType.simpleString()}")
        found = _ranked(sparse, floors=floors, **how).join(F.broadcast(ids), "item").select(F.col("name").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = named.schema["item"].dataType.simpleString()
        return spark.createDataFrame([], f"{item_id} {kind}, rank int, {id_col} long, score long")
    return out


def op11_dual_tree_search(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for every benchmark item over all documents."""
    return ranked_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
OP11_SQL = f"""
WITH i AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
d AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL),
n AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY 1),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM d, a WHERE term IN (SELECT term FROM i) GROUP BY 1),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM n, a),
s AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN d USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
