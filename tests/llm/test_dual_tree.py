import math
import random
import re

import numpy as np
import pyarrow as pa

from platen.llm import dual_tree as D

ITEMS = pa.schema([("item_id", pa.int64()), ("text", pa.string()), ("score", pa.string())])
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, k):
    own = [(i, terms_of(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms_of(t))
    out = []
    df = {t: sum(t in set(d) for _, d in own) for q in asked.values() for t in q}
    for item, query in asked.items():
        found = []
        for doc, terms in own:
            m = 75 + (25 * len(terms) * n_docs) // total if total else 0
            score = 0
            for t in query:
                tf = terms.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if gone else doc, -score) for rank, (score, gone, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(draw, n, vocab):
    words = [f"w{i}" for i in range(vocab)]
    weights = [1 / (i + 1) for i in range(vocab)]
    rows = []
    for i in range(n):
        text = " ".join(draw.choices(words, weights, k=draw.choice([1, 5, 30, 90])))
        rows.append((i * 3, draw.choice([str.upper, str, lambda t: t.replace(" ", "--é "), lambda t: t.replace(" ", "\n")])(text), "a"))
    return rows


def test_ranks_match_brute_force(spark, docs, frame):
    draw = random.Random(4)
    rows = corpus(draw, 400, 300)
    rows += [(7, None, "a"), (8, "", "a"), (9, "!?", None), rows[3], rows[3], (None, rows[5][1], "a"), (10, "w1 w250 " * 9000, "a")] + [(1000 + i, "w7 w8 w9", "a") for i in range(30)]
    items = [(i, rows[draw.randrange(300)][1], "x") for i in range(40)] + [(40, None, None), (41, "nowhere", ""), (42, "", ""), (None, "w7 w8", ""), (43, "w3 w3 W3", ""), (43, "w5", "")]
    table = frame([dict(zip(ITEMS.names, r, strict=True)) for r in items], ITEMS)
    for k in (1, 20):
        got = [tuple(r) for r in D.ranked_documents(docs(rows), table, k).collect()]
        assert sorted(got, key=str) == brute([r[:2] for r in rows], [r[:2] for r in items], k)
    assert D.ranked_documents(docs([]), table).count() == 0
    assert D.ranked_documents(docs(rows), table.limit(0)).count() == 0


def test_items_in_blocks_rank_alike(docs, frame, monkeypatch):
    draw = random.Random(6)
    rows = corpus(draw, 120, 200)
    items = [(i, rows[draw.randrange(100)][1], "") for i in range(30)]
    table = frame([dict(zip(ITEMS.names, r, strict=True)) for r in items], ITEMS)
    monkeypatch.setattr(D, "BLOCK_ITEMS", 8)  # read on the driver alone
    got = [tuple(r) for r in D.ranked_documents(docs(rows), table, 5).collect()]
    assert sorted(got, key=str) == brute([r[:2] for r in rows], [r[:2] for r in items], 5)


def test_bounds_cut_pairs_and_lose_none():
    """Of topics that don't share words, pairs of other topics are left unscored."""
    draw = np.random.default_rng(2)
    topics, n, width = 40, 2048, 800
    topic = draw.integers(0, topics, n)
    rows = np.repeat(np.arange(n), 10)
    terms = topic[rows] * 20 + draw.integers(0, 20, len(rows))
    pairs = np.unique(np.stack([rows, terms]), axis=1)
    rows, terms = pairs
    values = draw.integers(1, 1000, len(rows))
    weight = draw.integers(1, 50, width)
    items = []
    for i in range(80):
        t = np.sort(draw.choice(20, 6, replace=False)) + (i % topics) * 20
        items.append((t, weight[t]))
    for exact in (np.float64, np.int64):
        best = D.Best(np.ones(len(items), np.int64), 5)
        scored = D.search(D.item_tree(items, exact), D.DocTree(n, rows, terms, values, weight, exact), np.arange(n) * 7, np.zeros(n, bool), best)
        dense = np.zeros((n, width), np.int64)
        dense[rows, terms] = values
        for (t, w), (scores, _, ids) in zip(items, best.rows, strict=True):
            all_ = dense[:, t] @ w
            want = sorted((-s, i * 7) for i, s in enumerate(all_.tolist()) if s > 0)[:5]
            assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want
        assert scored < 0.4 * n * len(items)
