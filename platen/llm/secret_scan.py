"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by kind in every whole text. The base kinds (assign, access, hex) are always reported. The
method adds spans of kind `live`: long mixed tokens of no base kind whose value the corpus shows with few owners
only. A value that many owners or repositories show is a copied example and is not added. Values leave the scan as
digests, never as text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Kind:
    """A pattern; a match counts if its group is at least `least` characters and all patterns of `has` are found in it."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True
    has: tuple[str, ...] = ()


#: In the order in which spans of one start are listed. For hex and access a match is a whole run of the class, so
#: the least length can stand in the pattern; in assign a failing match still uses its text up.
KINDS = (
    Kind("assign", ASSIGN, 2, 8),
    Kind("access", "AKIA[A-Z0-9]{12,}"),
    Kind("hex", "[0-9a-f]{32,}"),
    Kind("live", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", base=False, has=("[0-9]", "[a-z]", "[A-Z]")),
)


def matches(text: Column, kind: Kind, order: int) -> Column:
    """Array of (kind, i, gap, n, digest) of a kind's matches, leftmost and not overlapping: code points since the match before, and of
    the match itself; digest of its value, null if it fails."""
    found, between = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    sized = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    value = lambda m: F.regexp_extract(m, kind.pattern, kind.group) if kind.group else m
    good = lambda m: reduce(and_, [value(m).rlike(p) for p in kind.has], F.length(value(m)) >= kind.least)
    digest = lambda m: F.when(good(m), F.sha2(value(m), 256))
    return F.transform(sized, lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("i"), x["gap"].alias("gap"), F.length(x["m"]).alias("n"), digest(x["m"]).alias("digest")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_cols: tuple[str, ...] = ("source",), repo_cols: tuple[str, ...] = ("source", "lang")) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): row and id of each document; row, owner, repo, start, kind, end, digest of each candidate span. Texts are read once, and places are running sums over rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = lambda cols: F.to_json(F.array(*[F.col(c).cast("string") for c in cols]))
    each = [matches(F.col("text"), kind, i) for i, kind in enumerate(KINDS)]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), name(owner_cols).alias("owner"), name(repo_cols).alias("repo"))
    found = cut(rows.select("id", "owner", "repo", F.concat(*each).alias("found"))).withColumn("row", F.monotonically_increasing_id())
    parts = found.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("m")).select("row", "owner", "repo", "m.*")
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spans = parts.withColumn("end", end).where("digest IS NOT NULL").select("row", "owner", "repo", (F.col("end") - F.col("n")).alias("start"), "kind", "end", "digest")
    return found.select("row", "id"), cut(spans)


def ownership(spans: DataFrame) -> DataFrame:
    """digest, n_repos, n_owners, n_seen over the corpus; counts are taken before the shuffle first, so a value that every row shows is cheap."""
    by_repo = spans.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n_seen"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.count("*").alias("n_repos"), F.sum("n_seen").alias("n_seen"))
    return by_owner.groupBy("digest").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n_seen").alias("n_seen"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_cols: tuple[str, ...] = ("source",), repo_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = 1, most_repos: int = 2) -> DataFrame:
    """One row for each of `docs`: id_col and found, an array of (start, end, kind, live).

    `live`: at most `most_owners` distinct owners and `most_repos` distinct repositories show the value. Base spans are
    there either way; a span of kind live that overlaps a base span, or that isn't live, is left out. Null text is
    empty; a null owner or repository is a name of its own; repeated rows are each returned; an empty table gives no
    rows. Other columns are ignored.
    """
    rows, spans = scan(docs, id_col, text_col, owner_cols, repo_cols)
    verdict = ownership(spans).select("digest", ((F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos)).alias("live"))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    judged = spans.join(verdict, "digest").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("all"))
    n_base = sum(k.base for k in KINDS)
    base = F.filter("all", lambda s: s["kind"] < n_base)
    clear = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    kept = F.filter("all", lambda s: (s["kind"] < n_base) | (s["live"] & clear(s)))
    shown = F.transform(kept, lambda s: F.struct(s["start"], s["end"], F.element_at(names, s["kind"] + 1).alias("kind"), s["live"]))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,live:boolean>>")
    return rows.join(judged.select("row", shown.alias("found")), "row", "left").select(F.col("id").alias(id_col), F.coalesce("found", none).alias("found"))


def op2_secret_ownership(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over all documents, with counts of live and copied base values beside it."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    bases = [k.name for k in KINDS if k.base]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin(bases))
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    of = lambda kind: lambda s: s["kind"] == kind
    return found.select(
        "doc_id",
        *[count(of(k)).alias(f"n_{k}") for k in bases],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        count(lambda s: s["live"]).alias("n_owner_specific"),
        count(lambda s: ~s["live"]).alias("n_copied"),
    )
