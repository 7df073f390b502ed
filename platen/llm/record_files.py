"""Token ids in length-delimited binary records, with a separate offset index.

A record is: length of the payload (8 bytes), masked CRC-32 of those 8 bytes (4), payload, masked CRC-32 of the payload
(4); all little-endian. A payload is the document's id (8 bytes, signed), a flag byte (1: the id is null), the width of a token
(1: 2 or 4 bytes), then the ids. Beside each data file `part-N.rec` stands `part-N.idx` with each record's offset and the
number of tokens before it in the file (8 bytes each), so any stretch of records can be read alone. A mask turns the CRC right by 15 bits and adds a
constant, since a CRC over data that holds its own CRC says little.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, qualified, shared_dir, to_python
from .tokens import encoded, encoder, task_encoder

MASK_DELTA = 0xA282EAD8
HEAD, NAME, TAIL, ENTRY = "<QI", "<qBB", "<I", "<QQ"
READ = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(ident: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = struct.pack(NAME, ident or 0, ident is None, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(TAIL, masked(length)) + payload + struct.pack(TAIL, masked(payload))


def unframe(data: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """(id, token ids, where the next record begins); ValueError where a checksum fails."""
    length, crc = struct.unpack_from(HEAD, data, at)
    body = at + struct.calcsize(HEAD)
    if masked(data[at : at + 8]) != crc:
        raise ValueError("record length is damaged")
    payload = data[body : body + length]
    if len(payload) < length or masked(payload) != struct.unpack_from(TAIL, data, body + length)[0]:
        raise ValueError("record is damaged")
    ident, null, width = struct.unpack_from(NAME, payload)
    return None if null else ident, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(NAME)), body + length + struct.calcsize(TAIL)


def write_records(docs: DataFrame, uri: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, partitions: int | None = None) -> DataFrame:
    """Writes the ids of all texts under `uri` (any file system of pyarrow), ascending by id (nulls first), and returns the files:
    part, n_records, n_tokens, data, index (paths).

    Rows of one id follow each other by the text's hash. Ids are cut into partitions by range, so a file is a stretch of the
    order; a task writes under a name of its own and renames when it is done, so a task that is run again, elsewhere or
    twice at once, leaves the same file. Null text is empty. An empty table writes no file.
    """
    spark = docs.sparkSession
    uri = qualified(spark, uri)
    folder, base = fs.FileSystem.from_uri(uri)
    folder.create_dir(base, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(count, "id", "tie").sortWithinPartitions("id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        system, root = fs.FileSystem.from_uri(uri)
        width = 2 if encoder(tokenizer).tool.get_vocab_size() <= 1 << 16 else 4
        end = np.array([] if end_id is None else [end_id], "<u4")
        own = f"{root}/.part-{part:05d}-{uuid.uuid4().hex}"
        n_records, n_tokens, at, data = 0, 0, 0, None
        with task_encoder(tokenizer) as tool:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for lo, found, bounds in encoded(batch.column(1), tool):
                    if data is None:
                        data, index = system.open_output_stream(f"{own}.rec"), system.open_output_stream(f"{own}.idx")
                    records, entries = [], []
                    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                        tokens = np.concatenate((found[a:b], end))
                        records.append(frame(ids[lo + i], tokens, width))
                        entries.append(struct.pack(ENTRY, at, n_tokens))
                        at, n_records, n_tokens = at + len(records[-1]), n_records + 1, n_tokens + len(tokens)
                    data.write(b"".join(records))
                    index.write(b"".join(entries))
        if data is None:
            return
        data.close(), index.close()
        names = [f"{root}/part-{part:05d}.{kind}" for kind in ("rec", "idx")]
        for name in names:
            system.move(f"{own}.{name[-3:]}", name)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, n_records, n_tokens, *names)], names=["part", "n_records", "n_tokens", "data", "index"])

    return cut(to_python(ordered.select("id", "text")).mapInArrow(run, "part long, n_records long, n_tokens long, data string, index string"))


def read_records(files: DataFrame, uri: str, chunk: int = 256) -> DataFrame:
    """id, ids (little-endian unsigned 32 bit), n_tokens and start (tokens of all records before it) of every record.

    The index splits files into runs of `chunk` records; each task reads its runs by offset and checks every checksum.
    The driver sees one row for each file.
    """
    spark = files.sparkSession
    before, tasks = 0, []
    for r in sorted(files.collect(), key=lambda r: r["part"]):
        tasks.append((r["part"], before, r["n_records"], r["data"], r["index"]))
        before += r["n_tokens"]
    runs = spark.createDataFrame(tasks, "part long, base long, n long, data string, index string")
    runs = runs.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long")))).withColumn("hi", F.least("n", F.col("lo") + chunk))
    runs = runs.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part", "lo")
    uri, entry = qualified(spark, uri), struct.calcsize(ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for r in batch.to_pylist():
                n = r["hi"] - r["lo"]
                with system.open_input_file(r["index"]) as file:
                    file.seek(r["lo"] * entry)
                    entries = np.frombuffer(file.read((n + (r["hi"] < r["n"])) * entry), "<u8").reshape(-1, 2).astype(np.int64)
                with system.open_input_file(r["data"]) as file:
                    offsets = entries[:, 0] if r["hi"] < r["n"] else np.append(entries[:, 0], file.size())
                    k = 0
                    while k < n:
                        upto = min(n, max(k + 1, int(np.searchsorted(offsets, offsets[k] + READ))))
                        file.seek(int(offsets[k]))
                        data, at, out = file.read(int(offsets[upto] - offsets[k])), 0, []
                        for j in range(k, upto):
                            ident, ids, at = unframe(data, at)
                            out.append((ident, ids.astype("<u4").tobytes(), len(ids), r["base"] + int(entries[j, 1])))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["id", "ids", "n_tokens", "start"])
                        k = upto

    return runs.mapInArrow(run, "id long, ids binary, n_tokens long, start long")


def op9_record_files(spark, sf_dir: str) -> DataFrame:
    """The contract's digest, read back from the files that it writes in the shared folder."""
    import public_tokenizers

    uri = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_records(docs, uri, public_tokenizers.path("byte_bpe_50k.json"))
    return read_records(files, uri).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
