"""The classifiers and the pipeline."""

import zlib

import brute
import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from decoylens.llm import quality, queries, toxicity
from test_llm_neardup import first_of_groups

MIDDLE, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"


def held_out_scores(spark, query, folds, out, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = query(spark, MIDDLE).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out) and 0 <= r["score"] <= 1
    kept = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    score, predicted, truth = map(np.array, zip(*kept))
    auc = (score[truth == 1][:, None] > score[truth == 0][None, :]).mean()
    return auc, (predicted == truth).mean(), predicted[truth == 0].mean(), predicted[truth == 1].mean(), max(truth.mean(), 1 - truth.mean())


def test_toxicity_on_held_out_labels(spark):
    auc, accuracy, false_alarms, found, majority = held_out_scores(spark, queries.op7_toxicity, 4, 2, "toxic")
    assert auc > 0.95 and accuracy > majority + 0.05 and false_alarms < 0.05 and found > 0.8


def test_quality_on_held_out_labels(spark):
    auc, accuracy, _, found, majority = held_out_scores(spark, queries.op10_quality, 3, 1, "quality")
    assert auc > 0.97 and accuracy > majority + 0.08 and found > 0.97


def test_misspellings_share_vectors():
    calm = ["the weather is fine and the road is long today", "a table with a lamp and a chair by the window"] * 30
    rude = ["the weather is fine you horrible nitwit of the road", "a table with nitwit and a horrible chair by the window"] * 30
    model = toxicity.fit(calm + rude, [0] * 60 + [1] * 60, 0.5)
    at = lambda word: model.score(f"the road and the {word} by the window today")
    assert at("horrible") > 0.6 and at("nitwit") > 0.1 and at("lamp") < 0.01
    assert at("nitwits") > 10 * at("lamp") and at("nittwit") > 10 * at("lamp")  # neither word was in the sample
    long = "the road is long " * 3000
    assert model.score(long + "you horrible nitwit") > model.score(long) + 0.3  # found at the end of a long text


def test_batches_do_not_change_toxicity():
    model = toxicity.fit(["good day"] * 9 + ["bad day"] * 9, [0] * 9 + [1] * 9, 0.5)
    texts = [t for _, t in cases.AWKWARD] + ["bad", "good day bad day " * 50]
    assert np.allclose(model.score_all(texts), [model.score(t) for t in texts])


def test_toxicity_windows_cover_all_words():
    for n in (0, 1, 5, 6, 7, 40):
        _, bounds = toxicity.ngrams(" ".join(["word"] * n))
        begin, end = toxicity.windows(bounds)
        assert begin[0] == 0 and end[-1] == bounds[-1] and (begin[1:] <= end[:-1]).all() and len(bounds) == n + 1


def test_chunks_cover_all_bytes():
    for n in (0, 1, 63, 64, 65, 512, 513, 5000):
        text = "".join(chr(33 + i % 90) for i in range(n))
        rows = quality.chunks(text)
        step = quality.CHUNK - quality.OVERLAP
        joined = rows[0].tobytes() + b"".join(r[quality.OVERLAP :].tobytes() for r in rows[1:])
        assert joined.rstrip(b"\0") == text.encode() and len(rows) == max(1, -(-(n - quality.OVERLAP) // step))


def test_batches_do_not_change_quality():
    net = quality.fit(["fine words here"] * 9 + ["%%% $$$ ###"] * 9, [1] * 9 + [0] * 9, 0.5)
    texts = [t for _, t in cases.AWKWARD] + ["x" * 600_000, "%%%"]
    assert np.allclose(net.score_all(texts), [net.score_all([t])[0] for t in texts], atol=1e-5)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_awkward_labels_and_rows(spark, module, label):
    docs = cases.documents(spark, [*cases.AWKWARD, *((100 + i, f"bad words {i}" if i % 2 else f"nice words {i}") for i in range(40))], extra=True)
    rows = [(100 + i, i % 2) for i in range(40)] + [(None, 1), (101, 0), (7, None), (999, 1), (4, 5), (102, 0), (102, 0)]
    labels = spark.createDataFrame(rows, f"doc_id long, {label} int")
    scored = module.score(docs, labels)
    assert scored.count() == docs.count()
    for r in scored.select("_doc.doc_id", "held_out", "score", "predicted").collect():
        assert 0 <= r["score"] <= 1 and (r["doc_id"] is not None or r["held_out"] is False)
    assert module.score(docs.limit(0), labels).count() == 0
    for few in (labels.limit(0), labels.filter(f"{label} = 1")):
        assert len({round(r["score"], 9) for r in module.score(docs, few).select("score").collect()}) == 1


def test_scores_do_not_depend_on_other_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    changed = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(0))
    for module in (toxicity, quality):
        a, b = ({r["doc_id"]: r["score"] for r in module.score(d, labels).select("_doc.doc_id", "score").collect()} for d in (docs, changed))
        assert a == b


def test_stages_of_the_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing to target weights", "token-id output"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = [{*texts}]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        result = stage(spark, docs, SMALL)
        assert result.columns == docs.columns
        docs = spark.read.parquet(stored_at(result, spark, i))
        steps.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    toxic = {r["doc_id"] for r in queries.op7_toxicity(spark, SMALL).collect() if r["predicted"]}
    assert steps[1] == steps[0] - toxic
    left = sorted(steps[1])
    assert steps[2] == first_of_groups([(i, texts[i]) for i in left])
    assert steps[3] == {i for i in steps[2] if not brute.contamination(texts[i], items, 10)[1]}
    assert steps[4] == steps[3]
    order = [r["doc_id"] for r in docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == order
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == brute.tokens([texts[i] for i in order])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()} == steps[4]


def stored_at(frame, spark, i):
    from decoylens.session import scratch_path

    path = scratch_path(spark, f"stage-{i}")
    frame.write.parquet(path)
    return path


def test_stages_on_awkward_documents(spark):
    awkward = cases.documents(spark, [*cases.AWKWARD, *cases.AWKWARD], extra=True)
    for _, stage in corpus_pipeline.STAGES:
        for docs in (awkward, awkward.limit(0)):
            result = stage(spark, docs, SMALL)
            assert result.count() <= docs.count()
            if stage is not corpus_pipeline.write_tokens:
                assert result.columns == docs.columns
