import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


@pytest.fixture
def frame(spark, tmp_path):
    """Writes rows as Parquet and reads them with Spark."""
    count = [0]

    def make(rows, schema):
        count[0] += 1
        path = tmp_path / f"t{count[0]}.parquet"
        pq.write_table(pa.Table.from_pylist(rows, schema=schema), path)
        return spark.read.parquet(str(path))

    return make


@pytest.fixture
def docs(frame):
    def make(rows):
        return frame([{"doc_id": i, "text": t, "lang": "en", "source": s, "n_chars": len(t or "")} for i, t, s in rows], DOCS)

    return make
