"""The pipeline's stages on tables with columns that operators use themselves, and without rows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import SCHEMA, prose  # noqa: E402


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:4]], ids=lambda s: s[0])
def test_own_columns_keep_their_values(spark, tmp_path, stage):
    data = [dict(zip(SCHEMA.names, (k, prose(60), "en", "a", 1))) for k in range(12)]
    pq.write_table(pa.Table.from_pylist(data, SCHEMA), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": ["one two three"]}), tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for c in ("KEPT", "n_words", "dropped", "class_id", "items", "__own", "a.b"):
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    out = stage[1](spark, docs, str(tmp_path))
    rows = out.collect()
    assert out.columns == docs.columns and rows
    assert all(r[c] == f"mine {c}" for r in rows for c in docs.columns[5:])
    assert stage[1](spark, docs.limit(0), str(tmp_path)).count() == 0
