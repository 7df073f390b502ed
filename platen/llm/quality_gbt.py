"""Quality rules: gradient-boosted trees over document statistics, flattened into node arrays.

Statistics come from whole texts in one vectorised pass. The trees are trained here with numpy on a bounded sample of
labelled documents, by histograms, with monotonic constraints on chosen features, and are scored level by level from
flat arrays (feature, threshold, left child, value), all documents of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import to_python
from ._text import U, Block, blocks, mix, span_hashes, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features, and how the score may move as each grows: 1 up, -1 down, 0 freely.
FEATURES = {"log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "words_per_line": 0, "upper_share": 0, "digit_share": -1, "lone_mark_share": -1, "stop_share": 0}
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL, _UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands more than once."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def statistics(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(BASE as int64, FEATURES as float64), a row for each document of the block."""
    data, bounds, n = block.data, block.bounds, len(block)
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])
    found = words(block)
    count = np.diff(found.first)
    doc = np.repeat(np.arange(n), count)
    salt = mix(np.arange(1, n + 1, dtype=U))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    length = chars[found.ends] - chars[found.starts]
    per_doc = lambda x: np.bincount(doc, x, n).astype(np.int64)

    again = np.zeros(len(doc), bool)
    if len(doc) >= 3:
        h = found.hashes
        whole = doc[2:] == doc[:-2]
        triple = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]) + salt[doc[2:]]
        twice = np.zeros(len(triple), bool)
        twice[whole] = _repeated(triple[whole])
        for i in range(3):
            again[i : i + len(twice)] |= twice

    cuts = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((bounds[:-1], cuts + 1)))
    starts = starts[starts < len(data)]
    ends = np.empty_like(starts)
    ends[:-1], ends[-1:] = starts[1:], len(data)
    ends = np.where((data[ends - 1] == 10) & (ends > starts), ends - 1, ends) if len(ends) else ends
    has = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    starts, ends = starts[has], ends[has]
    line_doc = np.searchsorted(bounds, starts, "right") - 1
    keys = span_hashes(data, starts, ends) + salt[line_doc]
    _, first = np.unique(keys, return_index=True)
    dup = np.ones(len(keys), bool)
    dup[first] = False
    lines, dups = np.bincount(line_doc, minlength=n), np.bincount(line_doc[dup], minlength=n)

    base = np.column_stack((count, per_doc(length), total(_SYMBOL[data]), dups, per_doc(again))).astype(np.int64)
    lone = per_doc((length == 1) & _MARK[data[found.starts]])
    short = per_doc(length <= 3)
    w, c, s, d, r = base.T.astype(float)
    at_least = np.maximum(w, 1)
    features = np.column_stack((np.log1p(w), c / at_least, s / at_least, d / np.maximum(lines, 1), r / at_least, w / np.maximum(lines, 1), total(_UPPER[data]) / at_least, total(_DIGIT[data]) / at_least, lone / at_least, short / at_least))
    return base, features


@dataclass
class Trees:
    """Nodes of all trees in one set of arrays: feature -1 marks a leaf; the right child follows the left one."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of a good document, for every row at once."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                at = np.where(f < 0, at, self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at]))
            out += self.value[at]
        return out


def train(x: np.ndarray, y: np.ndarray, constraints: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int | None = None, ridge: float = 1.0) -> Trees | None:
    """Boosted trees for logistic loss; None where a class is missing. Splits that break a constraint are not made, and
    the values below a constrained split stay on their side of its middle. A leaf has `least` rows: by default a fiftieth of them, 3 to 20."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return None
    least = least or min(20, max(3, len(y) // 50))
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    codes = np.column_stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)])
    bias = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), bias)
    feature, threshold, left, value, roots = [], [], [], [], []

    def new() -> int:
        feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(new())
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            best = (1e-6, -1, 0, 0.0, 0.0)
            sg, sh = g[rows].sum(), h[rows].sum()
            if level < depth and len(rows) >= 2 * least:
                for f in range(x.shape[1]):
                    k, size = codes[rows, f], len(edges[f]) + 1
                    cg, ch, cn = (np.cumsum(np.bincount(k, w, size))[:-1] for w in (g[rows], h[rows], None))
                    if not len(cg):
                        continue
                    vl, vr = np.clip(cg / (ch + ridge), low, high), np.clip((sg - cg) / (sh - ch + ridge), low, high)
                    gain = 2 * (vl * cg + vr * (sg - cg)) - vl**2 * (ch + ridge) - vr**2 * (sh - ch + ridge) - sg**2 / (sh + ridge)
                    bad = (cn < least) | (len(rows) - cn < least) | (constraints[f] * (vr - vl) < 0)
                    gain[bad] = -np.inf
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (gain[b], f, b, vl[b], vr[b])
            _, f, b, vl, vr = best
            if f < 0:
                value[node] = rate * float(np.clip(sg / (sh + ridge), low, high))
                margin[rows] += value[node]
                continue
            feature[node], threshold[node], left[node] = f, float(edges[f][b]), new()
            right, mid = new(), (vl + vr) / 2
            below = codes[rows, f] <= b
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[constraints[f]]
            todo += [(left[node], rows[below], level + 1, *bounds[0]), (right, rows[~below], level + 1, *bounds[1])]
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), depth, bias)


def _columns(names: tuple[str, ...], kind: str) -> str:
    return ", ".join(f"{n} {kind}" for n in names)


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Trees | None:
    """Trees from at most `most` labelled documents: those whose ids have the least hashes. A document that is both
    good and bad in `labels`, or whose label or id is null, takes no part; of the texts of one id, the one of least statistics does."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("r")).where("q = r")
    sample = known.select(F.col("doc_id").cast("long").alias("id"), F.col("q").cast("double").alias("q")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(sample), "id").select("q", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                _, x = statistics(block)
                part = batch.slice(block.lo, len(block))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c) for c in x.T)], names=["q", "id", *FEATURES])

    # repeated ids give one row, so the driver sees `most` rows at most
    each = to_python(texts).mapInArrow(run, f"q double, id long, {_columns(tuple(FEATURES), 'double')}").groupBy("id").agg(F.min(F.struct("q", *FEATURES)).alias("s"))
    rows = each.select("s.q", "id", *[f"s.{c}" for c in FEATURES]).toPandas().sort_values(["id", *FEATURES])
    return train(rows[list(FEATURES)].to_numpy(), rows["q"].to_numpy(), list(FEATURES.values()))


def judge(docs: DataFrame, model: Trees | None, carry: list[str], text_col: str = "text", cut: float = 0.0, least_words: int = 50, most_repeat: int = 50) -> DataFrame:
    """The columns `carry` of each document with BASE, score (log odds), base_failed and kept.

    kept: not base_failed, and a score above `cut` (without a model every such document stays). Null and empty texts
    have no words, so they fail. Repeated rows are each judged; an empty table gives no rows; names in `carry` that
    clash with the added ones have to be renamed before.
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(len(carry))):
                base, x = statistics(block)
                score = model.score(x) if model else np.full(len(x), np.inf)
                failed = (base[:, 0] < least_words) | (100 * base[:, 4] > most_repeat * base[:, 0])
                part = batch.slice(block.lo, len(block))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *(pa.array(c) for c in base.T), pa.array(score), pa.array(failed), pa.array(~failed & (score > cut))], names=[*carry, *BASE, "score", "base_failed", "kept"])

    return to_python(docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text_col).alias("__text"))).mapInArrow(run, f"{schema}, {_columns(BASE, 'long')}, score double, base_failed boolean, kept boolean")


def quality_filter(docs: DataFrame, labels: DataFrame, cut: float = 0.0) -> DataFrame:
    """The documents that are kept, with all their columns."""
    model = fit(docs, labels)
    plain = [f"__c{i}" for i in range(len(docs.columns))]  # whatever the columns are called, none clashes with the added ones
    verdict = judge(docs.toDF(*plain), model, plain, plain[docs.columns.index("text")], cut)
    return verdict.where("kept").select(*plain).toDF(*docs.columns)


def op5_quality_gbt(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, fit(docs, labels), ["doc_id"]).select("doc_id", *BASE, "base_failed", "kept", "score")
