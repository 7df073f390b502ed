import random

import numpy as np
import pyarrow as pa

from platen.llm import line_dedup
from platen.llm._text import blocks
from platen.llm.line_dedup import EDITS, FEW, dedup_lines, edits_of, plan, within
from platen.llm.minhash import OnePermutation, near_duplicates, one_of_each_group


def sets_of(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(n_shingles, component) of each row; rows of one id are one document."""
    sets = [sets_of(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and (rows[i][0] == rows[j][0] or a and b and 100 * len(a & b) >= 75 * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(len(sets[i]), least.get(find(i)) if r[0] is not None else None) for i, r in enumerate(rows)]


def corpus():
    draw = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    rows, ident = [], 100
    for size in (3, 5, 6, 8, 12, 40, 150):
        base = [draw.choice(vocab) for _ in range(size)]
        for k in range(14):
            w = list(base)
            for _ in range(k % 7):
                w[draw.randrange(len(w))] = draw.choice(vocab)
            rows.append((ident, " ".join(w).upper() if k % 2 else "\n".join(w), "a"))
            ident += draw.randrange(1, 4)
    draw.shuffle(rows)
    rows += [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (None, rows[0][1], "a"), rows[5], rows[5], (rows[6][0], "quite another text of its own here", "b"), (4, "é " * 9000, "a")]
    return rows


def test_components_match_brute_force(docs):
    rows = corpus()
    got = near_duplicates(docs(rows)).collect()
    want = [(r[0], *w) for r, w in zip(rows, brute(rows), strict=True)]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    left = one_of_each_group(docs(rows)).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == sorted({w[2] for w in want if w[2] is not None})
    assert near_duplicates(docs([])).count() == 0


def test_signature_estimates_similarity():
    draw = np.random.default_rng(0)
    method = OnePermutation(64, 4)
    for n in (4, 40, 2000):
        pool = draw.integers(0, 2**63, n * 2, dtype=np.int64).view(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 4 : n + n // 4])
        same = np.mean([np.mean(method.signature(a) == method.signature(b))])
        s = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(same - s) < 0.25


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(draw, items, times, pool):
    out = list(items)
    for _ in range(times):
        i, what = draw.randrange(len(out) + 1), draw.randrange(3)
        out[i : i + (what > 0)] = [draw.choice(pool)] if what < 2 else []
    return out


def near(a, b):
    """The definition: by words, or by characters where both have few words."""
    wa, wb = a.split(), b.split()
    if min(len(a), len(b)) < 40 or (len(wa) < 8) != (len(wb) < 8):
        return False
    x, y, most = (wa, wb, edits_of(min(len(wa), len(wb)), EDITS)) if len(wa) >= 8 else (a, b, 1)
    return abs(len(x) - len(y)) <= most and edits(x, y) <= most


def expected(rows):
    """Text that is left and lines that go, by id, of rows in the order of ids."""
    seen, out = [], {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        keep = []
        for line in (t or "").split("\n"):
            counts = len(line) >= 40 or any(c.isalnum() for c in line)
            if not (counts and (line in seen or any(near(line, s) for s in seen))):
                keep.append(line)
            if counts:
                seen.append(line)
        out[i] = ("\n".join(keep) if t is not None else None, len((t or "").split("\n")) - len(keep))
    return out


def test_edit_distance_matches_brute_force():
    draw = random.Random(1)
    pairs = []
    for _ in range(3000):
        a = [draw.randrange(3) for _ in range(draw.randrange(12))]
        pairs.append((a, changed(draw, a, draw.randrange(6), range(3)), draw.randrange(6)))
    side = lambda k: (np.concatenate([np.array(p[k], np.uint64) for p in pairs]), np.cumsum([0, *(len(p[k]) for p in pairs[:-1])]), np.array([len(p[k]) for p in pairs]))
    got = within(side(0), side(1), np.array([p[2] for p in pairs]))
    assert got.tolist() == [edits(a, b) <= m for a, b, m in pairs] and 500 < got.sum() < 2500


def test_segments_and_probes_are_complete():
    draw = random.Random(2)
    for classes, sizes in ((EDITS, (8, 9, 15, 16, 17, 18, 30, 62, 63, 64, 65, 67, 100, 254, 255, 256, 258, 260, 300)), (FEW, (40, 41, 70, 3000))):
        for k in range(900):
            a = [draw.randrange(50) for _ in range(draw.choice(sizes))]
            t = edits_of(len(a), classes)
            b = changed(draw, a, t, range(50)) if k % 3 else changed(draw, a[: len(a) // 2], t, range(50)) + a[len(a) // 2 :]
            s, l = sorted((a, b), key=len)
            if edits_of(len(s), classes) < t:
                continue
            own = lambda x, index: {(t, i, tuple(x[at : at + n])) for t, i, at, n, flag in plan(len(x), classes) if flag >= index}
            assert own(s, 1) & own(l, 0), (len(s), len(l))


def test_line_dedup_matches_brute_force(docs):
    draw = random.Random(5)
    vocab = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(2, 9))) for _ in range(300)]
    pool = [" ".join(draw.choice(vocab) for _ in range(n)) for n in (7, 8, 9, 12, 15, 16, 17, 30, 63, 64, 70, 255, 260)]
    pool += ["".join(draw.choice("abcdé") for _ in range(n)) for n in (39, 40, 41, 60)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(draw.randrange(5)):
            line = draw.choice(pool)
            cut = " " in line
            line = changed(draw, line.split(" ") if cut else line, draw.choice((0, 0, 1, 2, 3, 4, 5)), vocab if cut else "abcdé")
            lines.append((" " if cut else "").join(line))
        rows.append((i * 3 % 151, "\n".join(lines), "a"))
    rows += [(500, None, "a"), (501, "", "a"), (None, pool[0] + "\nshort\n" + pool[1], "b"), (502, "short\n\nshort\n---\n---", "a"), (503, "x" * 30000 + "\n" + "x" * 30001, "a")]
    got = {r["doc_id"]: (r["text"], r["__dropped"]) for r in dedup_lines(docs(rows)).collect()}
    want = expected([r for r in rows if r[0] != 503]) | {503: ("x" * 30000, 1)}
    assert got == want and sum(n for _, n in want.values()) > 100
    assert [r["__lines"] for r in dedup_lines(docs([(500, None, "a"), (501, "", "a")])).orderBy("doc_id").collect()] == [0, 1]
    same = dedup_lines(docs([(1, pool[3], "a")] * 3)).collect()
    assert sorted(r["text"] for r in same) == ["", "", pool[3]]
    assert dedup_lines(docs([])).count() == 0


def test_one_segment_of_thousands_of_lines(docs):
    """Lines that all share a segment: variants of one line, some of them far from each other, and others that only begin like it."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(24)]
    lines = [" ".join(base)]
    for k in range(2500):
        if k % 5:  # changed after the first segment
            w = list(base)
            for at in draw.sample(range(8, 24), k % 4 + 1):
                w[at] = word()
        else:
            w = base[:6] + [word() for _ in range(18)]
        lines.append(" ".join(w))
    draw.shuffle(lines)
    rows = [(i, line, "a") for i, line in enumerate(lines)]
    got = {r["doc_id"]: r["__dropped"] for r in dedup_lines(docs(rows)).collect()}
    words, gone = [line.split() for line in lines], {}
    for i, w in enumerate(words):  # no word moves here, so edits are places that differ
        gone[i] = int(any(sum(x != y for x, y in zip(w, v, strict=True)) <= 2 for v in words[:i]))
    assert got == gone and 400 < sum(gone.values()) < 2400


def test_added_and_clashing_columns(frame):
    import corpus_pipeline as cp
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("__row", "__at", "__lines", "n_lost", "N_Lines", "copies", "turn", "line")]])
    rows = [{"doc_id": i, "text": "All rights reserved.\nline %d" % i, "source": "a", "n_chars": 27, "__row": "r", "__at": f"p{i}", "__lines": "l", "n_lost": "k", "N_Lines": "m", "copies": "c", "turn": "t", "line": None} for i in range(4)]
    table = frame(rows, schema)
    out = dedup_lines(table, dropped="gone")
    assert out.columns == [c for c in table.columns if c != "__lines"] + ["__lines", "gone"]
    assert sorted((r["doc_id"], r["__at"], r["gone"]) for r in out.collect()) == [(i, f"p{i}", int(i > 0)) for i in range(4)]
    for stage in (cp.line_dedup, cp.near_dedup, cp.source_mix):
        got = stage(table.sparkSession, table, "")
        assert got.columns == table.columns and {r["n_lost"] for r in got.collect()} <= {"k"}


def test_short_lines_go_exactly(docs, tmp_path):
    import corpus_pipeline as cp
    from platen.llm.line_dedup import op6_segment_line_dedup

    rows = [(3, "All rights reserved.\n\nÉ\n}\n}\nLes.", "a"), (1, "Les.\nAll rights reserved.\nAll rights reserve.", "a"), (2, "é\n\n---\nLes.\nLes. ", "a"), (4, "---\nLes.", "b")]
    want = {1: "Les.\nAll rights reserved.\nAll rights reserve.", 2: "é\n\n---\nLes. ", 3: "\nÉ\n}\n}", 4: "---"}
    table = docs(rows)
    assert {r["doc_id"]: r["text"] for r in dedup_lines(table).collect()} == want
    assert {r["doc_id"]: r["text"] for r in cp.line_dedup(table.sparkSession, table, "").collect()} == want
    table.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["n_dropped"] for r in op6_segment_line_dedup(table.sparkSession, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 2, 4: 1}


def test_blocks_of_nulls_and_long_texts():
    import pyarrow as pa

    got = list(blocks(pa.array([None, "", "a" * 5000, "b"]), limit=100))
    assert sum(len(b) for b in got) == 4 and sum(len(b.data) for b in got) == 5001


def test_lines_that_no_verdict_names_are_not_dealt_out(docs, monkeypatch):
    """However many verdicts there are: beyond what is sent everywhere, a bitmap of them says which lines meet them. A key's row is two numbers."""
    draw = random.Random(3)
    vocab = ["".join(draw.choice("abcde") for _ in range(7)) for _ in range(200)]
    pool = [" ".join(draw.choice(vocab) for _ in range(n)) for n in (6, 9, 9, 12, 17, 30)]
    rows = []
    for i in range(60):
        lines = [draw.choice(pool).split(" ") for _ in range(draw.randrange(4))]
        rows.append((i * 3 % 61, "\n".join(" ".join(changed(draw, line, draw.choice((0, 1, 2)), vocab)) for line in lines), "a"))
    plans, checkpoint = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "SPREAD_ROWS", 0)
    monkeypatch.setattr(line_dedup, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), checkpoint(df))[1])
    got = {r["doc_id"]: (r["text"], r["__dropped"]) for r in dedup_lines(docs(rows)).collect()}
    assert got == expected(rows) and sum(n for _, n in got.values()) > 20
    assert any("bitmap_construct_agg" in p for p in plans)
    batch = pa.RecordBatch.from_arrays([pa.array([2, 4]), pa.array([" ".join(f"word{i}" for i in range(9)), "x" * 45])], names=["line", "text"])
    keys = pa.Table.from_batches(line_dedup._keys(iter([batch])))
    assert keys.column_names == ["key", "line"] and {(k & -2, k & 1) for k in keys["line"].to_pylist()} == {(2, 0), (2, 1), (4, 0), (4, 1)}
