"""Packing documents into token sequences: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's whole windows leave at once; its rest goes into the open
window that it fills best. Where none has room, the fullest window takes the head of the piece and is emitted, full,
and the tail goes on. What partitions leave open is merged, group by group, in the same way, and the last
sequences are cut at powers of two, so nothing is padded unless `cut_last` is off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import table, to_python
from .tokens import encoded, task_encoder

WIDE = 4
FAN_IN = 64
PIECE = "id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, part long"
NAMES = ["id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset", "part"]


class Packer:
    """Places pieces (id, start, doc_tokens, ids as bytes); emitted rows gather in `out` as tuples in the order of NAMES."""

    def __init__(self, size: int, windows: int, space: int, part: int):
        self.size, self.most, self.space, self.part = size, windows, space, part
        self.open: list[list] = []
        self.used: list[int] = []
        self.out: list[tuple] = []
        self.made = 0

    def _emit(self, window: list) -> None:
        at = 0
        for ident, start, total, ids in window:
            n = len(ids) // WIDE
            self.out.append((ident, start, n, total, ids, self.space + self.made, at, self.part))
            at += n
        self.made += 1

    def add(self, ident: int | None, start: int, total: int, ids: bytes) -> None:
        whole = self.size * WIDE
        while len(ids) >= whole:
            self._emit([(ident, start, total, ids[:whole])])
            start, ids = start + self.size, ids[whole:]
        while ids:
            n = len(ids) // WIDE
            room = [(self.size - u - n, i) for i, u in enumerate(self.used) if self.size - u >= n]
            if room:
                i = min(room)[1]
            elif len(self.open) < self.most:
                self.open.append([])
                self.used.append(0)
                i = len(self.open) - 1
            else:
                i = max(range(self.most), key=lambda j: (self.used[j], -j))
                n = self.size - self.used[i]
            self.open[i].append((ident, start, total, ids[: n * WIDE]))
            self.used[i] += n
            start, ids = start + n, ids[n * WIDE :]
            if self.used[i] == self.size:
                self._emit(self.open.pop(i))
                self.used.pop(i)

    def leave(self) -> None:
        """Open pieces as rows without a sequence, for the merge."""
        for window in self.open:
            for ident, start, total, ids in window:
                self.out.append((ident, start, len(ids) // WIDE, total, ids, None, None, self.part))
        self.open, self.used = [], []

    def finish(self, cut_last: bool) -> None:
        """Everything that is left, in as few windows as it fills; cut at powers of two, or one shorter sequence."""
        pieces = [p for w in self.open for p in w]
        self.open, self.used = [], []
        self.most = 1
        for p in pieces:
            self.add(*p)
        for window, used in zip(self.open, self.used, strict=True):
            sizes = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1] if cut_last else [used]
            at = 0
            for size in sizes:
                need, part = size, []
                while need:
                    ident, start, total, ids = window[at]
                    n = min(need, len(ids) // WIDE)
                    part.append((ident, start, total, ids[: n * WIDE]))
                    need -= n
                    if n * WIDE == len(ids):
                        at += 1
                    else:
                        window[at] = (ident, start + n, total, ids[n * WIDE :])
                self._emit(part)
        self.open, self.used = [], []

    def rows(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=NAMES)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int | None = 2, windows: int = 16, cut_last: bool = True) -> DataFrame:
    """Pieces of documents: id_col, start, length, doc_tokens, ids (little-endian unsigned 32 bit), sequence_id, offset.

    A document's ids are its text's, then `end_id` (None: no end id). Null and empty texts have that id only; without
    it they have no piece. Repeated rows are documents of their own; ids may be null. An empty table gives no rows.
    sequence_id is unique and otherwise free: partition (or merge group) and place there. Partition contents follow the
    table's files, so reruns over the same files agree.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().cast("long").alias("part"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        end = np.array([end_id], "<u4").tobytes() if end_id is not None else b""
        with task_encoder(tokenizer) as tool:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                if packer is None and len(batch):
                    part = batch.column(2)[0].as_py()
                    packer = Packer(size, windows, part << 32, part)
                for lo, found, bounds in encoded(batch.column(1), tool):
                    data, cuts = found.tobytes(), (bounds * WIDE).tolist()
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = data[a:b] + end
                        packer.add(ids[lo + i], 0, len(own) // WIDE, own)
                        if len(packer.out) > 500:
                            yield packer.rows()
        if packer:
            packer.leave()
            yield packer.rows()

    now = table(to_python(rows).mapInArrow(first, PIECE))
    done = [now.where("sequence_id IS NOT NULL")]
    level, groups = 1, (now.agg(F.max("part")).first()[0] or 0) + 1
    open_ = now.where("sequence_id IS NULL")
    while True:
        groups = -(-groups // FAN_IN)
        last = groups == 1

        def merge(key: tuple, pieces: pa.Table, level: int, last: bool) -> pa.Table:
            packer = Packer(size, windows, (level << 56) + (key[0].as_py() << 32), key[0].as_py())
            for p in sorted(pieces.to_pylist(), key=lambda p: (-p["length"], p["id"] is None, p["id"] or 0, p["start"], p["doc_tokens"])):
                packer.add(p["id"], p["start"], p["doc_tokens"], p["ids"])
            packer.finish(cut_last) if last else packer.leave()
            return pa.Table.from_batches([packer.rows()])

        step = (lambda at, end: lambda key, pieces: merge(key, pieces, at, end))(level, last)
        merged = open_.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInArrow(step, PIECE)
        merged = table(merged)
        done.append(merged.where("sequence_id IS NOT NULL"))
        open_, level = merged.where("sequence_id IS NULL"), level + 1
        if last:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_col), "start", "length", "doc_tokens", "ids", "sequence_id", "offset")


def op10_online_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of all pieces."""
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
