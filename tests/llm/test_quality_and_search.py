import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from platen.llm.quality_gbt import BASE, FEATURES, fit, judge, quality_filter, train
from platen.llm.topk_bsi import BitSlices, top_k

LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])


def stats(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in x), dup, len(marked))


def test_statistics_match_brute_force(docs):
    rows = [(i, t, "a") for i, t in enumerate([None, "", "\n", " \n \n", "a", "a\na\n\na", "é ü\vß|# $", "a b c a b c", "x y z\nx y z\n x y z", "a b c d", "w " * 20000, "a\r\na\r\n"])] + [(5, "a\na\n\na", "b"), (None, "q r s q r s", None)]
    got = judge(docs(rows), None, ["doc_id"]).collect()
    assert collections.Counter((r["doc_id"], *[r[b] for b in BASE]) for r in got) == collections.Counter((i, *stats(t)) for i, t, _ in rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"]) for r in got)
    assert judge(docs([]), None, ["doc_id"]).count() == 0


def test_constraints_hold():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(3000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + draw.normal(size=3000) * 0.3 > 0).astype(float)
    model = train(x, y, [1, -1, 0])
    grid = np.tile(draw.normal(size=(50, 1, 3)), (1, 40, 1))
    for f, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, :, f] = np.linspace(-3, 3, 40)
        steps = np.diff(model.score(g.reshape(-1, 3)).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-12).all()
    assert ((model.score(x) > 0) == y).mean() > 0.75
    assert train(x, np.ones(3000), [0, 0, 0]) is None


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where("doc_id % 2 = 0"))
    got = judge(docs, model, ["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in got]) > 0.97
    assert len(FEATURES) == 10


def test_filter_keeps_columns_and_survives_odd_labels(docs, frame):
    rows = [(i, "good words here " + " ".join(f"w{i}x{j}" for j in range(60)), "a") for i in range(30)]
    odd = docs(rows).withColumnRenamed("lang", "kept").withColumnRenamed("n_chars", "score")
    out = quality_filter(odd, frame([{"doc_id": None, "quality": 1, "toxic": 0}, {"doc_id": 1, "quality": None, "toxic": 0}, {"doc_id": 2, "quality": 0, "toxic": 0}, {"doc_id": 2, "quality": 1, "toxic": 0}], LABELS))
    assert out.columns == odd.columns and out.count() == 30
    assert quality_filter(odd, frame([], LABELS)).count() == 30


VECS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("rank", pa.string())])


def test_top_k_matches_brute_force(frame):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=6).round(1).tolist()) for i in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (7, rows[7][1]), (300, None), (301, [1.0, None, 1, 1, 1, 1]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [1.0]), (None, rows[1][1]), (320, [0.0] * 6)]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(frame([{"vec_id": i, "embedding": v, "rank": "clash"} for i, v in rows], VECS), k=9).collect()]
    padded = lambda v: np.array([*v, *[0.0] * (6 - len(v))], np.float32).astype(float)
    good = [(i, np.floor(64 * padded(v)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in {i: v for i, v in good if i % 20 == 0}.items():
        near = sorted(((-int(v @ u), i) for i, u in good if i != q))[:9]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert sorted(got) == sorted(want)
    assert top_k(frame([], VECS)).count() == 0
    few = top_k(frame([{"vec_id": 0, "embedding": [1.0], "rank": None}, {"vec_id": 1, "embedding": [2.0], "rank": None}], VECS)).collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 64 * 128)]


def test_slices_add_up():
    draw = np.random.default_rng(4)
    rows = draw.integers(-40, 40, (333, 5))
    index, q = BitSlices(np.arange(333), rows), np.array([-13, 7, 0, 1, 31])
    score = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:333].astype(int) << w for w, s in enumerate(index.add(q)))
    assert len(set(score - rows @ q)) == 1


def test_driver_gets_one_row_of_each_labelled_id(frame, docs, monkeypatch):
    import pyarrow as pa

    from platen.llm import quality_gbt

    sizes = []
    monkeypatch.setattr(quality_gbt, "train", lambda x, y, constraints: sizes.append(len(x)))
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int64())])
    labels = frame([{"doc_id": i, "quality": i % 2} for i in range(4)], schema)
    quality_gbt.fit(docs([(i, f"some text {i} {k}", "a") for i, k in [(0, 0), (1, 0), (2, 0)] + [(3, k) for k in range(50)]]), labels, 4)
    assert sizes == [4]


def test_vectors_of_other_lengths_and_large_components(frame):
    """A shorter vector counts as if zeros followed; components and scores are whole 64-bit numbers, and what is larger fails."""
    rows = [(i, [1.0, i / 8]) for i in range(5)] + [(20, [1.0, 1.0, 2.0]), (40, []), (41, [-3e9, 5e8, 1.0]), (60, [2.0**40, 1.0])]
    make = lambda rows: frame([{"vec_id": i, "embedding": v, "rank": None} for i, v in rows], VECS)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(make(rows), k=4).collect()]
    whole = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in rows}
    want = []
    for q in (0, 20, 40, 60):
        near = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:4]  # noqa: B905
        want += [(q, k + 1, i, -score) for k, (score, i) in enumerate(near)]
    assert sorted(got) == sorted(want)
    for bad in ([(0, [1e30]), (1, [1.0])], [(0, [2.0**40]), (1, [2.0**40])]):
        with pytest.raises(Exception, match="fit 64 bits"):
            top_k(make(bad)).collect()


def test_blocks_and_parts(frame, monkeypatch):
    from platen.llm import topk_bsi

    for name, value in (("BLOCK_ROWS", 64), ("LEAST_ROWS", 16), ("QUERY_ROWS", 3)):
        monkeypatch.setattr(topk_bsi, name, value)
    draw = np.random.default_rng(3)
    rows = draw.integers(-9, 9, (500, 3))
    got = top_k(frame([{"vec_id": i, "embedding": (v / 64).tolist(), "rank": None} for i, v in enumerate(rows)], VECS), k=5).collect()
    for q in range(0, 500, 20):
        near = sorted((-int(rows[q] @ rows[i]), i) for i in range(500) if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == near


def test_least_vector_of_a_repeated_query_id_asks(frame):
    """Two rows of one query id with other vectors give one answer, the same one however the rows are dealt."""
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(1, 90)] + [(20, [1.0, 2.0]), (20, [0.5, 9.0]), (20, [3.0, 0.0])]
    shape = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])
    table = frame([{"vec_id": i, "embedding": v} for i, v in rows], shape)
    first = {tuple(r) for r in top_k(table, k=5, scale=64.0).where("query_id = 20").collect()}
    again = {tuple(r) for r in top_k(table.repartition(7), k=5, scale=64.0).where("query_id = 20").collect()}
    least = min([int(64 * c) for c in v] for i, v in rows if i == 20)
    best = sorted((-sum(a * int(64 * b) for a, b in zip(least, v, strict=True)), i) for i, v in rows if i != 20)[:5]
    assert first == again == {(20, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
