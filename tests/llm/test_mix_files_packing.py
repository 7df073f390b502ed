import os
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from platen.llm.cube_mix import copies, flight, mix_documents, targets
from platen.llm.packing import pack
from platen.llm.record_files import frame as framed
from platen.llm.record_files import read_records, unframe, write_records
from platen.llm.tokens import Encoder, Memo, encoded

BYTE, WORD = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ROWS = [(5, "Hello there, general.\nKenobi  x", "a"), (3, None, "b"), (9, "", None), (5, "Hello again", "a"), (1, "long text " * 3000, "a"), (None, "no id", "b"), (2, "x", "c"), (2, "x", "c")]


def ids_of(tool, text):
    return tool.encode(text or "", add_special_tokens=False).ids


def test_targets():
    assert targets([100, 100], [1, 1], 1.5, 2) == [150, 150]
    assert targets([10, 100], [5, 1], 1.5, 2) == [20, 145]
    assert targets([10, 10], [1, 1], 9, 2) == [20, 20]
    assert targets([0, 10], [5, 2], 1.5, 2) == [0, 15]
    assert targets([], [], 1.5, 2) == []


def test_flight_keeps_totals():
    draw = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 3000):
        p, x = draw.uniform(size=n), draw.integers(0, 500, n)
        out = flight(p, x, draw.uniform(size=n))
        assert ((out > 1e-6) & (out < 1 - 1e-6)).sum() <= 2
        assert abs(out.sum() - p.sum()) < 1e-6 and abs(out @ x - p @ x) < 1e-4
    same = flight(np.full(9, 0.5), np.full(9, 7), draw.uniform(size=9))
    assert ((same > 1e-6) & (same < 1 - 1e-6)).sum() <= 2


def test_mix(docs):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 4}" if i % 9 else None) for i in range(900)] + [(7, "w w", "s0")] * 3 + [(None, None, "s1")]
    table = docs(rows)
    first = copies(table, block_rows=100).collect()
    again = copies(table, block_rows=100).collect()
    key = lambda r: (str(r["source"]), r["__row"], r["__at"], r["copies"])
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == len(rows)
    taken, goal, size = {}, {}, {}
    for r in first:
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        goal[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    order = sorted(size, key=lambda s: (s is None, s or ""))
    assert [goal[s] for s in order] == pytest.approx(targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2))
    assert all(abs(taken[s] - goal[s]) <= 25 for s in taken)
    mixed = mix_documents(table, block_rows=100)
    assert mixed.columns == table.columns and mixed.count() == sum(r["copies"] for r in first)
    assert copies(docs([])).count() == 0


#: Letters whose normal form ends in a mark, letters by composition, wide white space, separators and special tokens.
BITS = ["a", "b", "é", "\n", " ", "  ", ".", ",", "!", "'s", "'", "1", "\t", "\r\n", "_", "-", "Σ", "İ", "DEKİ.", "ΑΣ.", "A\u030a", "\u0308", "\u0301", "\u00a0", "\u2009", "\u3000", "\u0661", "日本", "🙂", "<|endoftext|>", "<|startoftext|>", "<|", "\x1c", "\x85"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_exact(path):
    import random

    draw = random.Random(0)
    texts = ["", None, " ", "DEKİ.", "x" * 5000, *["".join(draw.choice(BITS) for _ in range(draw.randrange(1, 24))) for _ in range(12000)]]
    tool, own, seen = Tokenizer.from_file(path), Encoder(path, memo=60_000), 0
    for lo, ids, bounds in encoded(pa.array(texts), own, limit=20_000):
        assert lo == seen
        for i in range(len(bounds) - 1):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == ids_of(tool, texts[lo + i]), repr(texts[lo + i])
        seen += len(bounds) - 1
    assert seen == len(texts)


def test_memo_forgets():
    memo = Memo(2000)
    for lo in range(0, 100, 3):
        keys = [str(i).encode() for i in range(lo, lo + 3)] + [b"x" * 300]
        assert memo.values(keys, lambda new: [keys[i] for i in new]) == keys
        assert len(memo.young) + len(memo.old) <= 20 and b"x" * 300 not in memo.young


def test_frames():
    for ident in (None, -5, 2**40):
        data = b"x" + framed(ident, np.array([1, 2, 50000], "<u4"), 2) + framed(1, np.array([], "<u4"), 4)
        got, ids, at = unframe(data, 1)
        assert got == ident and ids.tolist() == [1, 2, 50000] and unframe(data, at)[0] == 1
    for i in range(1, 20):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            unframe(bytes(broken), 1)


def test_records_round_trip(docs, tmp_path):
    uri = f"file://{tmp_path}/records"
    files = write_records(docs(ROWS), uri, BYTE, partitions=3)
    got = sorted(read_records(files, uri, chunk=2).collect(), key=lambda r: r["start"])
    tool = Tokenizer.from_file(BYTE)
    assert [r["id"] for r in got] == [None, 1, 2, 2, 3, 5, 5, 9]
    want = sorted((str(i), tuple([*ids_of(tool, t), 0])) for i, t, _ in ROWS)
    assert sorted((str(r["id"]), tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    assert not list((tmp_path / "records").glob(".part*"))


def test_records_empty(docs, tmp_path):
    files = write_records(docs([]), f"file://{tmp_path}/none", BYTE)
    assert files.count() == 0


@pytest.mark.parametrize("cut_last", [True, False])
def test_packing(docs, cut_last):
    rows = ROWS + [(100 + i, "word " * (i * 37 % 90), "a") for i in range(120)]
    got = pack(docs(rows), WORD, size=128, windows=3, cut_last=cut_last).collect()
    tool = Tokenizer.from_file(WORD)
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] > 0
    for own in used.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 128 and (not cut_last or at & (at - 1) == 0)
    want = sorted((str(i), tuple([*ids_of(tool, t), 2])) for i, t, _ in rows)
    whole = {}
    for r in got:  # repeated ids are told apart by their contents only, so compare all ids as a multiset
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert sum(len(ids) for own in whole.values() for _, ids in own) == sum(len(w[1]) for w in want)
    for (i, n), own in whole.items():
        texts = [w[1] for w in want if w[0] == str(i) and len(w[1]) == n]
        if len(texts) == 1:
            assert tuple(t for _, ids in sorted(own) for t in ids) == texts[0]
    assert len(used) <= -(-sum(len(w[1]) for w in want) // 128) + 7
    assert pack(docs([]), WORD).count() == 0


def test_checksums(docs):
    got = pack(docs([(1, "one two", "a")]), WORD, end_id=None).first()
    assert zlib.crc32(got["ids"]) == zlib.crc32(np.array(ids_of(Tokenizer.from_file(WORD), "one two"), "<u4").tobytes())


def test_a_task_gives_its_memory_back():
    """In a process of its own: what a task's encoder took is free again for the executor, not only for its worker."""
    code = """
import random
import pyarrow as pa
import public_tokenizers
from platen.llm.tokens import encoded, task_encoder
def held(): return int(open("/proc/self/statm").read().split()[1]) * 4096
draw = random.Random(1)
texts = [" ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(300)) for _ in range(1000)]
with task_encoder(public_tokenizers.path("word_bpe_49k.json")) as tool:
    list(encoded(pa.array(["a"]), tool))
    before = held()
    for _ in encoded(pa.array(texts), tool):
        pass
    within = held()
print(before >> 20, within >> 20, held() >> 20)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    before, within, after = map(int, out.split())
    assert after - before < 0.4 * (within - before)
