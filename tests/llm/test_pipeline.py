import corpus_pipeline as cp
from platen.llm.minhash import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if i < len(cp.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name == "near_dedup":
            want = {r["component_id"] for r in near_duplicates(before).collect()}
            assert {r["doc_id"] for r in docs.collect()} == want and kept[name] == len(want)
        if name == "quality_rules":
            bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").join(docs, "doc_id")
            assert bad.count() == 0
    assert kept["quality_rules"] >= kept["line_dedup"] >= kept["near_dedup"] > 0
    sizes = docs.groupBy("sequence_id").sum("length").collect()
    assert all(n <= 4096 and n & (n - 1) == 0 for _, n in sizes)


def test_reruns_agree(spark, tmp_path):
    """Two runs, the second over a copy of the table in other files, keep the same documents and tokens; only where pieces lie in sequences follows the files."""
    import zlib

    import corpus_pipeline as cp

    copied = tmp_path / "copy"
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5).write.parquet(str(copied / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(copied / "labels.parquet"))

    def seen(where):
        whole = {}
        for r in cp.run(spark, where).collect():
            whole.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"], zlib.crc32(r["ids"])))
        return {i: (sum(n for _, n, _, _ in own), sorted(t for s, _, t, _ in own if s == 0)) for i, own in whole.items()}

    assert seen("/root/testdata/sf0.001") == seen(str(copied))


def test_stages_take_odd_tables(docs):
    """Nulls, empty texts, ties, repeated rows and empty tables pass every stage, each fed with what the one before it left."""
    import corpus_pipeline as cp

    words = " ".join(f"w{i}" for i in range(80))
    odd = docs([(1, None, "a"), (2, "", None), (3, words, "a"), (3, words, "a"), (4, words + " end", "b"), (None, words.upper(), None), (5, words + "\n" + words, "b"), (6, "---\n\n", "c")])
    spark = odd.sparkSession
    for table in (odd, docs([])):
        now = table
        for name, stage in cp.STAGES[1:]:
            now = stage(spark, now, "")
            assert name == "packing" or now.columns == table.columns, name
        now.count()
