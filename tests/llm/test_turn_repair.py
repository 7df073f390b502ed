import hashlib
import random
import re
import zlib
from functools import lru_cache

import pyarrow as pa
import pytest

from platen.llm import turn_repair as T

TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("conv", pa.string())])
WORD = re.compile(r"[^\x20\x09-\x0D]")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        words = WORD.findall(text)
        out.append("b" if not words else "d" if (role, text) in seen else "" if words[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired turns), by memoised recursion over (turns done, what stands so far); inserts come one or two at a time."""
    n = len(rows)

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == n and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 2:
            role = "assistant" if state == "u" else "user"
            c, a, r = best(i, role[0], inserts + 1)
            found.append((c + 3, "I" + a, (f"{role}:", *r)))
        if i < n:
            (role, text), fault = rows[i], faults[i]
            c, a, r = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, r))
            if fault not in ("b", "d"):
                late = 3 * (fault == "t")
                if (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    c, a, r = best(i + 1, role[:1], 0)
                    found.append((c + late, "K" + a, (f"{role}:{text}", *r)))
                to = "assistant" if state == "u" else "user"
                c, a, r = best(i + 1, to[0], 0)
                found.append((c + late + 3, "R" + a, (f"{to}:{text}", *r)))
        return min(found, key=lambda f: f[:2], default=(10**9, "~", ()))

    return best(0, "", 0)


def brute(rows):
    """The contract's rows, from (conv_id, turn, role, text) before damage."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        say = lambda v: " " if v is None else str(v)
        code = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for conv, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in own if t is not None}
        rows_ = [r[1:] for r in own]
        faults = faults_of(rows_)
        cost, audit, left = cheapest(tuple(rows_), tuple(faults))
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows_, rows_[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), bad, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def talk(draw, conv, turns):
    say = ["Yes.", "No!", "And then", " ", "", "\t\n", "Tell me more?", "é ünd.", "Well… ", "ok. "]
    return [(conv, None if draw.random() < 0.03 else draw.randrange(1, turns + 2), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "a", ""]), draw.choice([f"{draw.choice(say)}{draw.randrange(9)}.", draw.choice(say), None if draw.random() < 0.1 else "x."])) for _ in range(turns)]


def test_search_matches_brute_force():
    draw = random.Random(1)
    for _ in range(1500):
        n = draw.randrange(0, 14)
        rows = [(draw.choice(["user", "assistant", "system", "tool", " ", ""]), "x") for _ in range(n)]
        faults = [draw.choice(["", "", "", "b", "d", "t"]) for _ in range(n)]
        cost, audit, left = cheapest(tuple(rows), tuple(faults))
        assert T.search([(r[:1], f) for (r, _), f in zip(rows, faults, strict=True)]) == (cost, audit)
        got = T.repaired(audit, [r for r, _ in rows], [t for _, t in rows])
        assert [f"{role}:{text}" for _, role, text in got] == list(left)


def test_search_grows_with_length_alone():
    draw = random.Random(5)
    rows = [(draw.choice("usau "), draw.choice(["", "b", "t"])) for _ in range(2000)]
    cost, audit = T.search(rows)
    assert cost == T.suffix_bounds(rows)[0][0] or cost <= T.suffix_bounds(rows)[0][0] + 6
    assert sum(e != "I" for e in audit) == 2000


@pytest.mark.parametrize("size", [256, 3])
def test_digest_matches_brute_force(spark, frame, size):
    """Conversations of many pieces too, over several partitions."""
    draw = random.Random(size)
    rows = [r for conv in [None, *range(40)] for r in talk(draw, conv, draw.choice([1, 2, 5, 9]))] + talk(draw, 99, 300)
    rows += [(7, 3, "user", "long. " * 60000), (8, None, None, None), (8, None, None, None)]
    draw.shuffle(rows)
    kept = {}
    names = ["conv_id", "turn", "role", "text"]
    table = frame([dict(zip(names, r, strict=True)) | {"fault": "x", "conv": "y"} for r in rows], TURNS)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for r in T.repair_digests(table, most_turns=size).collect():
            kept[r["conv_id"]] = tuple(r)[1:]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = brute(rows)
    assert kept.keys() == want.keys()
    for conv, row in want.items():
        assert kept[conv] == row, conv


def test_repaired_turns_follow_the_grammar(frame):
    draw = random.Random(2)
    names = ["conv_id", "turn", "role", "text"]
    rows = [r for conv in range(20) for r in talk(draw, conv, 6)]
    turns = frame([dict(zip(names, r, strict=True)) | {"fault": "", "conv": None} for r in rows], TURNS)
    out = {}
    for r in sorted(T.repair_conversations(turns).collect(), key=lambda r: (r["conv"], r["part"], r["no"], r["place"])):
        out[r["conv"]] = out.get(r["conv"], "") + r["role"][:1]
    assert out and all(re.fullmatch("(s?(ua)+)?", v) for v in out.values())
    assert T.repair_conversations(turns.limit(0)).count() == 0
