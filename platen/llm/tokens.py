"""Token ids of whole texts through the tokenizers library, each piece of text encoded once.

A text is cut before every space, and before every line end after a non-space, that a non-space follows; for the tokenizers
used here no token spans such a place, so a text's ids are those of its pieces. (Where it isn't plain that the next
character is no white space, nothing is cut, which is always right.) Arrow gathers the different pieces of a block, new ones
are encoded some dozens at a time and their ids told apart by length, and numpy puts the ids of all pieces together. A memo,
bounded in bytes, keeps the ids of pieces seen before.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import Block, blocks

GROUP = 50
MEMO_BYTES, LONGEST = 64 << 20, 200
#: Bytes after which nothing is cut: white space, separators, and the first bytes of wider white space.
_OPEN = np.zeros(256, bool)
_OPEN[[*range(9, 14), *range(28, 33), 0x85, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_BLANKS, _LATE = np.zeros(256, bool), np.zeros(256, bool)
_BLANKS[[*range(9, 14), 32]] = True
#: Last bytes of characters that can't be those of wider white space.
_LATE[[*range(0xAA, 0xAF), *range(0xB0, 0xC0)]] = True


class Memo:
    """A dict of two generations, bounded in bytes: what isn't asked for while the younger one fills is forgotten."""

    def __init__(self, most: int):
        self.half, self.size, self.young, self.old = most // 2, 0, {}, {}

    def clear(self) -> None:
        self.size, self.young, self.old = 0, {}, {}

    def values(self, keys: list[bytes], make) -> list[bytes]:
        """The value of each key (no key twice); make(places) gives those of the keys at these places, which are new."""
        young, old = self.young, self.old
        out = [young.get(k) for k in keys]
        new, again = [], []
        for i, v in enumerate(out):
            if v is None:
                out[i] = v = old.get(keys[i])
                (new if v is None else again).append(i)
        for i, v in zip(new, make(new) if new else [], strict=True):
            out[i] = v
        for i in (*again, *new):
            k, v = keys[i], out[i]
            if len(k) <= LONGEST:
                young[k] = v
                self.size += len(k) + len(v) + 170
        if self.size > self.half:
            self.old, self.young, self.size = young, {}, 0
        return out


class Encoder:
    """Ids of texts; `memo` bounds the bytes of what is kept."""

    def __init__(self, path: str, memo: int = MEMO_BYTES, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = special_as_text
        self.memo = Memo(memo)
        #: Whether a piece keeps the space before it (byte-level), or spaces only separate.
        self.spaces = self._alone(" a") != self._alone("a")
        suffix = getattr(self.tool.model, "end_of_word_suffix", None) or ""
        #: Characters of each id's token, which are bytes of the text for byte-level vocabularies.
        self.width = np.ones(self.tool.get_vocab_size(), np.int64)
        for token, i in self.tool.get_vocab().items():
            self.width[i] = len(token.removesuffix(suffix) if suffix else token)

    def _alone(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids[bounds[i] : bounds[i + 1]] are those of the block's row i."""
        data, n = block.data, len(block.data)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(len(block) + 1, np.int64)
        shut = ~_OPEN[data]
        at = np.zeros(n, bool)
        at[:-1] = (data[:-1] == 32) & shut[1:]
        at[1:-1] |= (data[1:-1] == 10) & shut[2:] & shut[:-2]
        last = block.bounds[1:-1]
        at[last[last > 0] - 1] = False  # the next byte is another row's
        at[last[last < n]] = True
        at[0] = True
        starts = np.flatnonzero(at)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, n).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        known = pieces.dictionary
        offsets, raw = np.frombuffer(known.buffers()[1], np.int32)[: len(known) + 1], known.buffers()[2]
        stored, bytes_, cuts = np.frombuffer(raw, np.uint8), raw.to_pybytes(), offsets.tolist()
        keys = [bytes_[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        found = self.memo.values(keys, lambda new: self._fresh(keys, new, stored, offsets))
        flat, count = np.frombuffer(b"".join(found), "<u4"), np.array([len(f) for f in found], np.int64) >> 2
        index = pieces.indices.to_numpy()
        sizes = count[index]
        ends = np.cumsum(sizes)
        source = np.repeat((np.cumsum(count) - count)[index] - (ends - sizes), sizes) + np.arange(ends[-1])
        before = np.concatenate(([0], ends))
        return flat[source], before[np.searchsorted(starts, block.bounds)]

    def _fresh(self, keys: list[bytes], new: list[int], data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of the keys at `new`; data and offsets hold all keys. Such as begin with one space or line end and end in a character are encoded together."""
        at = np.array(new)
        lo, hi = offsets[at], offsets[at + 1]
        size = hi - lo
        plain = np.diff(np.concatenate(([0], np.cumsum(data < 128)))[np.stack((lo, hi))], axis=0)[0] == size
        length = size if self.spaces else size - np.diff(np.concatenate(([0], np.cumsum(_BLANKS[data])))[np.stack((lo, hi))], axis=0)[0]
        head, next_, before, last = data[lo], data[np.minimum(lo + 1, hi - 1)], data[np.maximum(hi - 2, lo)], data[hi - 1]
        ended = np.where(last < 128, ~_OPEN[last], ((before >= 0xC3) & (before < 0xE0)) | _LATE[last])
        good = (size > 1) & (size <= LONGEST) & ((head == 32) | (head == 10)) & ~_OPEN[next_] & ended
        out: list[bytes | None] = [None] * len(new)
        groups = [own[k : k + GROUP] for own in (np.flatnonzero(good & plain), np.flatnonzero(good & ~plain)) for k in range(0, len(own), GROUP)]
        texts = [b"".join([keys[new[i]] for i in own.tolist()]).decode() for own in groups]
        use = [k for k, t in enumerate(texts) if "<|" not in t]
        for k, got in zip(use, self.tool.encode_batch_fast([texts[k] for k in use], add_special_tokens=False) if use else [], strict=True):
            own, ids = groups[k], np.array(got.ids, "<u4")
            sizes = length[own]
            if self.tool.normalizer and not plain[own[0]]:
                parts = self.tool.normalizer.normalize_str(texts[k]).split(" ")[1:]
                if len(parts) != len(own) or self.spaces:
                    continue
                sizes = np.array([len(p.encode()) for p in parts])
            reach, ends = np.concatenate(([0], np.cumsum(self.width[ids]))), np.cumsum(sizes)
            cut = np.minimum(np.searchsorted(reach, ends), len(reach) - 1)
            if reach[-1] != ends[-1] or (reach[cut] != ends).any():
                continue  # these are encoded alone
            part, cut = ids.tobytes(), (cut * 4).tolist()
            for i, a, b in zip(own.tolist(), [0, *cut], cut, strict=False):
                out[i] = part[a:b]
        alone = [i for i, o in enumerate(out) if o is None]
        for i, got in zip(alone, self.tool.encode_batch_fast([keys[new[i]].decode() for i in alone], add_special_tokens=False) if alone else [], strict=True):
            out[i] = np.array(got.ids, "<u4").tobytes()
        return out


@lru_cache(4)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder a worker and file."""
    return Encoder(path, special_as_text=special_as_text)


def give_back() -> None:
    """Memory that Python and Arrow hold free goes back to the system, where its C library can do that: a worker lives on between tasks, and its executor pays for what it keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def task_encoder(path: str) -> Iterator[Encoder]:
    """The worker's encoder for one task; its memo is given back afterwards, since other stages use the worker too."""
    give_back()
    tool = encoder(path)
    try:
        yield tool
    finally:
        tool.memo.clear()
        give_back()


def encoded(column: pa.Array, tool: Encoder, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, bounds) of about `limit` bytes of texts; null is empty."""
    for block in blocks(column, limit):
        yield block.lo, *tool.encode(block)


def with_tokens(df: DataFrame, text_col: str, path: str, out: str = "tokens") -> DataFrame:
    """`df` with the ids of `text_col` as array<long>; a column named `out` is replaced."""
    kept = [(n, k) for n, k in df.dtypes if n != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(path) as tool:
            for batch in batches:
                for lo, ids, bounds in encoded(batch.column(len(kept)), tool):
                    lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(bounds) - 1).columns[: len(kept)], lists], names=[*(n for n, _ in kept), out])

    from pyspark.sql import functions as F

    rows = df.select(*[f"`{n}`" for n, _ in kept], F.col(f"`{text_col}`").alias("__text"))
    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in [*kept, (out, "array<long>")]))
