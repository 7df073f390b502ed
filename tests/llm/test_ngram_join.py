import random
import re

import numpy as np

from platen.llm import ngram_join as J


def sets_of(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size=4, percent=85):
    sets = [sets_of(t, size) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and (rows[i][0] == rows[j][0] or a and b and 100 * len(a & b) >= percent * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i)) if r[0] is not None else None) for i, r in enumerate(rows)]


def in_order(rows):
    return sorted(rows, key=lambda x: tuple((v is not None, v or 0) for v in x))


def corpus(seed, vocab=3000, sizes=(1, 3, 4, 5, 8, 11, 25, 60, 150), copies=14):
    """Groups of copies with ever more changes, chains of them, and passages that many texts share."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    passage = [draw.choice(words) for _ in range(40)]
    rows, ident = [], 100
    for size in sizes:
        base = [draw.choice(words) for _ in range(size)]
        for k in range(copies):
            w = list(base)
            for _ in range(k % 5):
                w[draw.randrange(len(w))] = draw.choice(words)
            if k % 3 == 2:
                w = w[: max(1, len(w) - k // 3)]
            if k % 7 == 6:
                base = w
            if k % 4 == 3:
                w = passage + w[: draw.choice([3, 6, 50])]
            rows.append((ident, " ".join(w).upper() if k % 2 else "\n".join(w), "a"))
            ident += draw.randrange(1, 4)
    draw.shuffle(rows)
    return rows


def test_components_match_brute_force(docs):
    rows = corpus(3)
    rows += [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (None, rows[0][1], "a"), rows[5], rows[5], (rows[6][0], "quite another text of its own here", "b"), (4, "é " * 9000, "a")]
    got = J.ngram_components(docs(rows)).collect()
    assert in_order(tuple(r) for r in got) == in_order(brute(rows))
    assert J.ngram_components(docs([])).count() == 0


def test_small_vocabulary_and_other_thresholds(docs):
    """N-grams of a few words are all frequent, so columns hold rows of many components."""
    draw = random.Random(8)
    rows = [(i, " ".join(draw.choice("abc") for _ in range(draw.choice([4, 6, 9, 30]))), "a") for i in range(150)]
    assert in_order(tuple(r) for r in J.ngram_components(docs(rows), percent=60).collect()) == in_order(brute(rows, percent=60))
    rows = corpus(9, vocab=40, sizes=(9, 30, 90))
    assert in_order(tuple(r) for r in J.ngram_components(docs(rows), size=2, percent=70).collect()) == in_order(brute(rows, 2, 70))


def test_fronts_share_what_they_must():
    """For sets that just link, what the fronts keep shares a column, whatever the order by frequency."""
    draw = np.random.default_rng(1)
    for _ in range(3000):
        percent, a = int(draw.choice([60, 75, 85, 90])), int(draw.integers(1, 160))
        b = int(draw.integers(J.needed(a, percent), a + 1))
        both = -(-(a + b) * percent // (100 + percent))
        if both > b:
            continue
        items = draw.permutation(a + b - both)
        rank = draw.permutation(len(items))
        fronts, kept = [], []
        for own in (items[:a], items[a - both :]):
            n = len(own)
            f = np.sort(own)[: J.front(n, percent)]
            fronts.append(f)
            kept.append(f[np.argsort(rank[f])][: len(f) - J.spare(n, percent) + 1])
        assert len(np.intersect1d(*fronts)) >= max(J.spare(a, percent), J.spare(b, percent))
        common = len(np.intersect1d(*kept))
        assert common >= 1
        beyond = max(n - J.front(n, percent) for n in (a, b))
        assert common >= both - beyond - max(J.spare(a, percent), J.spare(b, percent)) + 1


def test_overlaps_and_forests_match_brute_force():
    draw = np.random.default_rng(7)
    for pool in (40, 400, 5000):
        sets = [np.unique(draw.integers(0, pool, int(draw.integers(1, 60)))).astype(np.uint64) for _ in range(50)]
        for left, right in ((np.arange(50), np.arange(50)), (np.arange(20), np.arange(20, 50))):
            got = J.overlaps(sets, left, right)
            assert all(got[i, j] == len(np.intersect1d(sets[a], sets[b])) for i, a in enumerate(left) for j, b in enumerate(right) if a != b)
            for percent in (20, 50):
                edges = J.forest(sets, left, right, percent)
                want = [(a, b) for i, a in enumerate(left) for j, b in enumerate(right) if a != b and 100 * got[i, j] >= percent * (len(sets[a]) + len(sets[b]) - got[i, j])]
                assert roots(50, edges) == roots(50, want) and len(edges) <= 2 * 50


def roots(n, edges):
    root = list(range(n))
    for _ in range(n):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    return root


def test_families_over_several_blocks(docs, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 5)  # read on the driver alone
    rows = corpus(12, sizes=(8, 25, 60), copies=40)
    assert in_order(tuple(r) for r in J.ngram_components(docs(rows)).collect()) == in_order(brute(rows))


def test_bitmaps_rule_out_no_link(spark, docs):
    """Every pair that links passes the bitmaps' test, and pairs that share a passage alone mostly don't."""
    from pyspark.sql import functions as F

    draw = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = corpus(21, sizes=(5, 25, 60, 150)) + [(10000 + i, passage + " " + " ".join(f"q{draw.randrange(9999)}" for _ in range(50)), "a") for i in range(30)]
    prints = J.sketches(docs(rows), "doc_id", "text", 4, 85).where("n > 0")
    left = prints.select("id", "n", *J.BITMAP)
    right = prints.select(F.col("id").alias("v"), F.col("n").alias("n2"), *[F.col(m).alias(f"{m}_") for m in J.BITMAP])
    passed = {(r["id"], r["v"]) for r in left.join(right, F.col("id") > F.col("v")).where(J.able(F.col("n"), F.col("n2"), "_", 85)).collect()}
    sets = {r[0]: sets_of(r[1], 4) for r in rows}
    linked = {(u, v) for u in sets for v in sets if u > v and 100 * len(sets[u] & sets[v]) >= 85 * len(sets[u] | sets[v])}
    assert linked and linked <= passed
    assert sum(u >= 10000 and v >= 10000 for u, v in passed) < 0.1 * 30 * 29 / 2


def test_texts_that_no_join_needs_are_not_dealt_out(spark, docs):
    """The bitmap loses no id that is asked for, and few others pass."""
    from platen.llm._store import perhaps_in

    rows = docs([(i, f"text {i}", "a") for i in [None, *range(-2000, 2000)]]).selectExpr("doc_id as id", "text")
    wanted = spark.createDataFrame([(None,)] + [(i,) for i in range(-1999, 9000, 40)] * 2, "id long")
    got = [r["id"] for r in perhaps_in(rows, wanted).collect()]
    assert sorted(got) == list(range(-1999, 2000, 40))
    few = [r["id"] for r in perhaps_in(rows, wanted, 12).collect()]
    assert set(got) <= set(few) and len(few) == len(set(few)) < 1000
    assert perhaps_in(rows, wanted.limit(0)).count() == 0


def test_fronts_are_dealt_out_once(spark, docs, monkeypatch):
    rows = J.different(J.sketches(docs(corpus(5, sizes=(8, 25))), "doc_id", "text", 4, 85))
    monkeypatch.setattr(J, "table", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matrix = J.incidence(rows, 85)
        assert matrix.collect()
        final = matrix._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in final.splitlines() if "Exchange hashpartitioning(h#" in line or "ReusedExchange" in line]
    assert sum("ReusedExchange" in line for line in dealt) >= 1 and sum("ReusedExchange" not in line for line in dealt) == 1
