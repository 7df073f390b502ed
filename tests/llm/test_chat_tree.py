import hashlib

import pyarrow as pa

from platen.llm.chat_tree import prefix_tree, read_back

TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("node", pa.string()), ("part", pa.string())])


def turns_of(rows):
    return [{"conv_id": c, "turn": t, "role": r, "text": x, "node": "clash", "part": "clash"} for c, t, r, x in rows]


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello <|im_end|>\\ <\\|x"), (1, 2, "user", "bye"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello <|im_end|>\\ <\\|x"), (2, 2, "user", "more"),
    (3, 0, "user", "hi"), (3, 1, "assistant", None), (4, 0, "sys\n\\n<|", ""), (5, 0, "user", "hi"),
    (None, 0, "user", "x" * 5000), (6, 0, None, "t"), (6, 0, None, "t"), (6, None, "assistant", "first"),
]


def test_round_trip_and_shared_turns(frame):
    nodes, leaves = prefix_tree(frame(turns_of(ROWS), TURNS), partitions=3)
    back = {r["conv_id"]: [(t["role"], t["text"], t["loss_text"]) for t in r["turns"]] for r in read_back(nodes, leaves).collect()}
    for conv in {r[0] for r in ROWS}:
        own = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x in ROWS if c == conv])
        assert back[conv] == [(r, x, x if r == "assistant" else "") for _, r, x in own]
    check_sequence(nodes.orderBy("start").collect())
    assert nodes.where("formatted LIKE '<|im_start|>user\nhi<%'").count() == 1


def check_sequence(rows):
    """One sequence without gaps; parents stand before, positions go on from the parent's, and the intervals are those of all ancestors."""
    at, by = 0, {}
    for r in rows:
        above, p = [], r["parent"]
        while p is not None:
            above.append((p, p + by[p]["n_tokens"]))
            p = by[p]["parent"]
        assert r["start"] == at and r["n_tokens"] == len(r["formatted"]) and r["depth"] == len(above)
        assert r["position"] == sum(b - a for a, b in above)
        joined = []
        for a, b in reversed(above):
            if joined and joined[-1][1] == a:
                joined[-1] = (joined[-1][0], b)
            else:
                joined.append((a, b))
        assert [(x["start"], x["end"]) for x in r["ancestors"]] == joined
        assert r["formatted"].count("<|") == 2
        by[at] = r
        at += r["n_tokens"]
    assert len({(r["parent"], r["formatted"]) for r in rows}) == len(rows)


def test_paths_over_many_partitions(frame):
    """A random tree, copies, prefixes of others and a third of all conversations with one first turn, whatever the partitions."""
    import random

    draw, rows = random.Random(6), []
    for c in range(150):
        turns = ["hot"] * (c % 3 == 0) + [draw.choice("abc") for _ in range(draw.randrange(1, 7))]
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(turns)]
    want = {c: [(r, x) for k, _, r, x in rows if k == c] for c in range(150)}
    for n in (1, 7, 40):
        nodes, leaves = prefix_tree(frame(turns_of(rows), TURNS), partitions=n)
        check_sequence(nodes.orderBy("start").collect())
        assert nodes.count() == len({tuple(w[: i + 1]) for w in want.values() for i in range(len(w))})
        assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read_back(nodes, leaves).collect()} == want


def test_long_conversations_stay_small(frame):
    rows = [(c, t, "user", f"t{t if t < 4000 else (c, t)}") for c in range(3) for t in range(5000)]
    nodes, leaves = prefix_tree(frame(turns_of(rows), TURNS), partitions=3)
    assert nodes.count() == 7000 and max(len(r["ancestors"]) for r in nodes.select("ancestors").collect()) <= 2
    assert [len(r["starts"]) for r in leaves.collect()] == [5000] * 3


def test_tokens_of_a_tokenizer(frame):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    nodes, _ = prefix_tree(frame(turns_of(ROWS), TURNS), partitions=2, tokenizer=path)
    tool, at = Tokenizer.from_file(path), 0
    for r in nodes.orderBy("start").collect():
        assert r["tokens"] == tool.encode(r["formatted"], add_special_tokens=False).ids and (r["start"], r["n_tokens"]) == (at, len(r["tokens"]))
        at += r["n_tokens"]


def test_empty(frame):
    nodes, leaves = prefix_tree(frame([], TURNS))
    assert nodes.count() == 0 and leaves.count() == 0


def test_query_digest(spark):
    from platen.llm.chat_tree import op1_chat_prefix_tree

    got = {r["conv_id"]: r for r in op1_chat_prefix_tree(spark, "/root/testdata/sf0.001").collect()}
    by = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    by[-1] = [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]
    assert set(by) == set(got)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
