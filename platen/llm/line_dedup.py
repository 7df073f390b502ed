"""Line dedup by a segment-partition edit join.

A line is a sequence of words, and an edit inserts, deletes or replaces one. Lines of one class of lengths have a threshold
t, and t + 1 segments of one size at their beginning. Two lines within t edits share one segment of the shorter line
unchanged, and no more places away than edits stand before it; so every line is indexed by its segments and probes, by the
classes that a partner's length can have, the few substrings at which such a segment can stand. Keys are hashes of (threshold,
segment number, content). Candidates are confirmed by banded bit-parallel edit distance.

A segment that many lines share isn't paired out. Its lines are first held against two of them, the earliest and the one
that the corpus has most often; one that is within t of an earlier line is settled then. The others look for partners among
the lines of the segment that share one of the t + 1 rarest words with them, which two lines within t edits do.

Lines of few words (one word may be very long) are sequences of characters instead, with a threshold of one character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import ROW, cut, fits_broadcast, perhaps_in, plain_columns, table, to_python, with_row_id
from ._text import U, blocks, mix, span_hashes, words

LEAST_CHARS = 40
#: (words from, edits): two lines are near if they are that many edits apart, by the shorter one's words.
EDITS = ((8, 1), (16, 2), (64, 3), (256, 4))
#: The same of lines with fewer words, in characters; and how many characters a token of such a line has.
FEW, GRAM = ((LEAST_CHARS, 1),), 3
#: What a line must have to be more than layout.
WORDY = r"[\p{L}\p{N}]"
SEEN, PAIRS = 1 << 18, 1 << 12
#: Rarest words, beyond the threshold, of which lines within the threshold share all but what edits took.
MORE = 8
#: Rows of a frame that is sent to every executor at most: of some 100 bytes, and of one hash.
SPREAD_ROWS, SPREAD_HASHES = 200_000, 1_000_000


def edits_of(n: int, classes: tuple[tuple[int, int], ...]) -> int:
    """The threshold of a sequence of n places; 0 if it is too short to have one."""
    return max([0, *(t for lo, t in classes if lo <= n)])


def plan(n: int, classes: tuple[tuple[int, int], ...]) -> list[tuple[int, int, int, int, int]]:
    """(threshold, segment, start, size, index) of the substrings that stand for a sequence of n places; index: it is a segment of its own class."""
    own = sum(lo <= n for lo, _ in classes) - 1
    out = []
    for k in range(max(0, own - 1), own + 1):
        lo, t = classes[k]
        if k < own and n - t >= classes[own][0]:
            continue  # no partner is short enough for the class below
        size = lo // (t + 1)
        # with segment i the first before whose end at most i edits stand, i edits stand before it
        out += [(t, i, at, size, int(k == own and at == i * size)) for i in range(t + 1) for at in range(i * size - i, min(i * size + i, n - size) + 1)]
    return out


def sequences(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, codes, starts, sizes, worded): what each text is a sequence of, word hashes or code points."""
    for block in blocks(column):
        found = words(block)
        count = np.diff(found.first)
        worded = count >= EDITS[0][0]
        few = np.flatnonzero(~worded)
        texts = [block.data[block.bounds[i] : block.bounds[i + 1]].tobytes().decode("utf-8", "replace") for i in few]
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        starts, sizes = found.first[:-1].astype(np.int64), count.astype(np.int64)
        sizes[few] = [len(t) for t in texts]
        starts[few] = len(found.hashes) + np.cumsum(sizes[few]) - sizes[few]
        yield block.lo, np.concatenate((found.hashes, chars)), starts, sizes, worded


def within(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], most: np.ndarray) -> np.ndarray:
    """Whether the sequences a, b (codes, starts, sizes) of each pair are at most `most` edits apart.

    Bit-parallel in a band: bit k of state e says that with e edits diagonal k - t (place in b less place in a) is
    reached at the current place in a; all pairs move on by one place at once.
    """
    (ca, sa, na), (cb, sb, nb) = a, b
    swap = na > nb
    codes = np.concatenate((ca, cb))
    sa, sb = np.where(swap, sb + len(ca), sa), np.where(swap, sa, sb + len(ca))
    na, nb = np.minimum(na, nb), np.maximum(na, nb)
    out = np.zeros(len(most), bool)
    todo = np.flatnonzero(nb - na <= most)
    todo = todo[np.argsort(-na[todo], kind="stable")]
    if not len(todo):
        return out
    top = int(most[todo].max())
    sa, sb, na, nb, most = sa[todo], sb[todo], na[todo], nb[todo], most[todo]
    full = U((1 << 2 * top + 1) - 1)
    states = [np.full(len(todo), 1 << top, U)]
    for _ in range(top):
        states.append((states[-1] | states[-1] << U(1)) & full)
    i = 0
    while True:
        n = int(np.searchsorted(-na, -i))  # pairs that are longer than i; the others are at their end
        if n < len(na):
            end = (nb[n:] - na[n:] + top).astype(U)
            out[todo[n:]] = np.choose(most[n:], [s[n:] >> end & U(1) for s in states]).astype(bool)
        keep = np.arange(n) if i % 8 else np.flatnonzero(np.bitwise_or.reduce([s[:n] for s in states]))  # where no state is left, the pair is too far apart
        todo, sa, sb, na, nb, most = (x[keep] for x in (todo, sa, sb, na, nb, most))
        states = [s[keep] for s in states]
        if not len(keep):
            return out
        here, same = codes[sa + i], np.zeros(len(keep), U)
        for k in range(2 * top + 1):
            j = i + k - top
            if j >= 0:
                ok = nb > j
                same |= (ok & (codes[np.where(ok, sb + j, 0)] == here)).astype(U) << U(k)
        after: list[np.ndarray] = []
        for e, state in enumerate(states):
            now = state & same
            if e:
                now |= states[e - 1] | states[e - 1] >> U(1) | after[e - 1] << U(1)
            after.append(now & full)
        states, i = after, i + 1


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, line) rows of lines given as (line, text), where line, which is even, gets 1 more if the key is an index; a line that the task had shortly before is left out."""
    plans: dict[tuple[int, bool], np.ndarray] = {}
    seen: set[int] = set()
    for batch in batches:
        for lo, codes, starts, sizes, worded in sequences(batch.column(1)):
            lines = batch.column(0).slice(lo, len(sizes)).to_numpy()
            kept = []
            for i, line in enumerate(lines.tolist()):
                if line not in seen:
                    seen.add(line)
                    kept.append(i)
            if len(seen) > SEEN:
                seen = set()
            own = []
            for i in kept:
                at = int(sizes[i]), bool(worded[i])
                if at not in plans:
                    plans[at] = np.array(plan(at[0], EDITS if at[1] else FEW), np.int64).reshape(-1, 5)
                own.append(plans[at])
            if not own:
                continue
            count, kept = np.array([len(p) for p in own]), np.array(kept)
            rows, at = np.concatenate(own), np.repeat(starts[kept], count)
            hashes = span_hashes(codes, at + rows[:, 2], at + rows[:, 2] + rows[:, 3])
            name = (rows[:, 0] * 64 + rows[:, 1] * 2 + np.repeat(worded[kept], count) + 1).astype(U)
            keys = mix(hashes + name * U(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(lines[kept], count) | rows[:, 4])], names=["key", "line"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, token, size, edits, most) of lines given as (line, text): each different word, or run of GRAM characters; places and edits of the line, and how many of the rarest tokens one has to look at."""
    for batch in batches:
        for lo, codes, starts, sizes, worded in sequences(batch.column(1)):
            lines = batch.column(0).slice(lo, len(sizes)).to_numpy()
            found: list[tuple[np.ndarray, ...]] = []
            for line, at, n, by_word in zip(lines.tolist(), starts.tolist(), sizes.tolist(), worded.tolist(), strict=True):
                size, edits = (1, edits_of(n, EDITS)) if by_word else (GRAM, edits_of(n, FEW))
                begin = np.arange(n - size + 1)
                own = np.unique(codes[at : at + n] if by_word else span_hashes(codes[at : at + n], begin, begin + size))
                found.append((np.full(len(own), line), own.view(np.int64), *(np.full(len(own), x, np.int32) for x in (n, edits, size * edits + 1))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["line", "token", "size", "edits", "most"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, line2) of the rows (line, line2, one text, another) whose texts are near."""
    for whole in batches:
        for lo in range(0, len(whole), PAIRS):
            batch = whole.slice(lo, PAIRS)
            sides = []
            for c in (2, 3):
                parts = list(sequences(batch.column(c)))
                shift = np.cumsum([0, *(len(p[1]) for p in parts)])
                sides.append([np.concatenate([p[k] + (s if k == 2 else 0) for p, s in zip(parts, shift, strict=False)]) for k in (1, 2, 3, 4)] if parts else [np.zeros(0, U), *[np.zeros(0, np.int64)] * 2, np.zeros(0, bool)])
            (*a, worded), (*b, other) = sides
            n = np.minimum(a[2], b[2])
            most = sum((n >= at).astype(np.int64) * (t - u) for (at, t), (_, u) in zip(EDITS, ((0, 0), *EDITS), strict=False))
            most = np.where(worded, most, (n >= FEW[0][0]) * FEW[0][1])
            good = within(a, b, most) & (worded == other) & (most > 0) if len(batch) else np.zeros(0, bool)
            yield batch.select(["line", "line2"]).filter(pa.array(good))


def lines_of(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """ROW, id, place and text of every line of `least` characters or more, or with a letter or digit; two hashes name its content, the first of them even."""
    each = docs.select(*ROW, F.col(id_col).cast("long").alias("id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("place", "text"))
    wanted = (F.length("text") >= least) | F.col("text").rlike(WORDY)
    return each.where(wanted).select("*", F.xxhash64("text").bitwiseAND(F.lit(-2)).alias("line"), F.xxhash64(F.lit(17), "text").alias("line2"))


def _first() -> Column:
    return F.min(F.struct(F.col("id").isNull().alias("late"), "id", *ROW, "place"))


def _spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """A narrow frame as the side of a join that is sent everywhere, if it has few enough rows."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def near_lines(each: DataFrame, least: int) -> DataFrame | None:
    """line, line2 of the lines of `each` that the corpus has before with 1 to t edits; None if no two share a segment."""
    keys = each.where(F.length("text") >= least).select("line", "text").mapInArrow(_keys, "key long, line long")
    own = Window.partitionBy("key")
    shared = keys.withColumns({"lo": F.min("line").over(own), "hi": F.max("line").over(own), "any": F.max(F.col("line").bitwiseAND(F.lit(1))).over(own)}).where("lo div 2 <> hi div 2 AND any = 1")
    shared = cut(shared.groupBy("key", F.col("line").bitwiseAND(F.lit(-2)).alias("line")).agg((F.max(F.col("line").bitwiseAND(F.lit(1))) == 1).alias("index")))
    if shared.isEmpty():
        return None
    wanted = cut(shared.select("line").distinct())
    texts = table(each.join(_spread(wanted, SPREAD_HASHES), "line").groupBy("line", "line2").agg(F.first("text").alias("text"), _first().alias("first"), F.count("*").alias("n")))
    placed = cut(shared.join(texts.groupBy("line").agg(F.min("first").alias("first"), F.sum("n").alias("n")), "line"))

    def checked(pairs: DataFrame) -> DataFrame:
        side = lambda p: texts.select(F.col("line").alias(p), F.col("line2").alias(f"{p}2"), F.col("first").alias(f"{p}_first"), F.col("text").alias(f"{p}_text"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").where("a_text <> b_text")
        pick = lambda a, b: F.when(F.col("a_first") > F.col("b_first"), F.col(a)).otherwise(F.col(b))
        later = both.select(pick("a", "b").alias("line"), pick("a2", "b2").alias("line2"), "a_text", "b_text")
        return cut(later.mapInArrow(_verified, "line long, line2 long").distinct())

    member = F.struct("line", "index")
    hubs = placed.groupBy("key").agg(F.count("*").alias("m"), F.min_by(member, "first").alias("h1"), F.max_by(member, F.struct("n", F.xxhash64("line"))).alias("h2"))
    star = placed.join(hubs, "key").select("line", "index", F.explode(F.array("h1", "h2")).alias("h")).where("line <> h.line AND (index OR h.index)")
    tried = cut(star.select(F.least("line", "h.line").alias("a"), F.greatest("line", "h.line").alias("b")).distinct())
    near = checked(tried)
    # the others, among the lines of segments that three lines or more share
    open_ = cut(placed.join(hubs.where("m > 2").select("key"), "key", "left_semi"))
    todo = cut(open_.select("line").distinct().join(near.select("line"), "line", "left_anti"))
    if todo.isEmpty():
        return near
    # a line has as many keys as plan gives, so these arrays are short
    marks = cut(open_.groupBy("line").agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("index"), F.col("key"))).alias("own"), F.first("first").alias("first")))
    tokens = cut(texts.select("line", "text").join(marks.select("line"), "line", "left_semi").mapInArrow(_tokens, "line long, token long, size int, edits int, most int"))
    rare = Window.partitionBy("line").orderBy("f", "token")
    placed_ = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("f")), "token").withColumns({"at": F.row_number().over(rare), "all": F.count("*").over(Window.partitionBy("line"))})
    front = cut(placed_.where(F.col("at") <= F.col("most") + (MORE - 1)))
    # the first k words that two lines share are among the first t + k of each, so lines that share fewer are no partners
    arrays = front.groupBy("line").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda s: s["token"]).alias("front"), F.first(F.col("all") - F.col("most") + 1).alias("sure"))
    rows = cut(front.where("at <= most AND f > 1").select("line", "token", "size", "edits").join(arrays.join(marks, "line"), "line"))
    left = rows.join(todo, "line", "left_semi")
    right = rows.select("token", *[F.col(c).alias(f"{c}2") for c in ("line", "size", "edits", "keys", "own", "first", "front", "sure")])
    common = F.array_intersect("front", "front2")
    alike = (F.get(common, F.lit(0)) == F.col("token")) & (F.size(common) >= F.least(F.lit(MORE), F.greatest("sure", "sure2"))) & F.expr("abs(size - size2) <= least(edits, edits2) AND (arrays_overlap(own, keys2) OR arrays_overlap(keys, own2))")
    pairs = left.join(right, "token").where(F.expr("first > first2 AND line <> line2") & alike).select(F.least("line", "line2").alias("a"), F.greatest("line", "line2").alias("b")).distinct()
    return near.union(checked(pairs.join(tried, ["a", "b"], "left_anti"))).distinct()


def dropped_places(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """ROW and dropped (sorted places of lines) of the rows of `docs`, numbered by with_row_id, that lose a line."""
    each = lines_of(docs, id_col, text_col, least)
    marked = each.groupBy("line", "line2").agg(F.count("*").alias("n")).where("n > 1").select("line", "line2", F.lit(False).alias("near"))
    near = near_lines(each, least)
    if near is not None:
        marked = marked.unionByName(near.withColumn("near", F.lit(True))).groupBy("line", "line2").agg(F.max("near").alias("near"))
    marked, rows = cut(marked), each.drop("text")
    if fits_broadcast(marked, SPREAD_ROWS):
        rows = rows.join(F.broadcast(marked), ["line", "line2"])
    else:  # the other lines stay where they are
        of = perhaps_in(rows.withColumnsRenamed({"id": "__id", "line": "id"}), marked.select(F.col("line").alias("id")))
        rows = of.withColumnsRenamed({"id": "line", "__id": "id"}).join(marked, ["line", "line2"])
    rows = cut(rows)
    first = rows.where("NOT near").groupBy("line", "line2").agg(_first().alias("first"))
    stays = F.coalesce(F.struct(*[F.col(f"first.{c}") for c in (*ROW, "place")]) == F.struct(*ROW, "place"), F.lit(False))
    lost = rows.where("near").select(*ROW, "place").unionByName(rows.where("NOT near").join(_spread(cut(first)), ["line", "line2"]).where(~stays).select(*ROW, "place"))
    return lost.groupBy(*ROW).agg(F.sort_array(F.collect_list("place")).alias("dropped"))


def _cut_lines(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns `names` of rows whose last two columns are the text and its dropped places, with the text that is left and both counts."""
    for batch in batches:
        text, gone = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        lines = pc.fill_null(pc.add(pc.count_substring(text, "\n"), 1), 0).cast(pa.int64())
        has = gone.is_valid()
        new = []
        for t, places in zip(text.filter(has).to_pylist(), gone.filter(has).to_pylist(), strict=True):
            parts = t.split("\n")
            for place in reversed(places):
                parts[place] = None
            new.append("\n".join([x for x in parts if x is not None]))
        left = pc.replace_with_mask(text, has, pa.array(new, text.type)) if new else text
        dropped = pc.fill_null(pc.list_value_length(gone), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], left, lines, dropped], names=[*names, "text", "lines", "dropped"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS, lines: str = "__lines", dropped: str = "__dropped") -> DataFrame:
    """`docs` with `text_col` less its repeated lines, and the columns `lines` and `dropped`: how many it had and lost.

    A line goes if the corpus, in order of id (nulls last), content and place, has the same line before, or one within the edits
    that EDITS gives the shorter of the two; that one may itself have gone. Lines without a letter or digit (blank lines, rules,
    lone brackets) of fewer than `least` characters stay always, other lines of fewer than `least` go by sameness only. A
    null or empty text stays as it is; repeated rows keep their lines in the first of them only; an empty table gives no
    rows. Other columns stay, whatever their names; one called as an added column is replaced.
    """
    plain, at = plain_columns(docs)
    numbered = with_row_id(plain)
    lost = cut(dropped_places(numbered.select(*ROW, at[id_col], at[text_col]), at[id_col], at[text_col], least))
    size = lost.agg(F.count("*"), F.coalesce(F.sum(F.size("dropped")), F.lit(0))).first()
    rows = numbered.join(F.broadcast(lost) if 10 * size[0] + size[1] < 10 * SPREAD_ROWS else lost, list(ROW), "left")
    rest = [at[c] for c in docs.columns if c != text_col]
    kinds = dict(plain.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rest) + (", " if rest else "") + "text string, lines long, dropped long"
    out = to_python(rows.select(*rest, at[text_col], "dropped")).mapInArrow(lambda batches: _cut_lines(batches, rest), schema)
    kept = [c for c in docs.columns if c not in (lines, dropped)]
    return out.select(*[F.col("text" if c == text_col else at[c]).alias(c) for c in kept], F.col("lines").alias(lines), F.col("dropped").alias(dropped))


def op6_segment_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its lines, those that it lost, and a digest of the text that is left."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
