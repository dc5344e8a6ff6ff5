"""The near-duplicate stage of the pipeline comes through fingerprints."""

import corpus_pipeline
from decoylens.llm import neardup, simhash
from pyspark.sql import functions as F


def test_near_duplicates_come_through_fingerprints(spark, monkeypatch):
    sketch = neardup.sketch_column
    monkeypatch.setattr(neardup, "sketch_column", lambda text: sketch(text).withField("bands", F.array().cast("array<long>")))
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, text), (2, text + " end"), (3, text + " other end"), (4, "something else"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {r["_id"] for r in simhash.groups(docs).filter(F.col("component_id") == 1).collect()}
    assert linked >= {1, 2}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {1, 2, 3, 4, 5} - (linked - {1})
