"""The near-duplicate stage against the Jaccard similarity of all pairs."""

import random

import cases
import corpus_pipeline
import numpy as np
import pytest

from decoylens.llm import neardup, tables

VOCABULARY = [f"w{i}" for i in range(3000)]


def shingles(text):
    own = (text or "").lower().split()
    return {" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def first_of_groups(docs):
    """The smallest id of each group, over all pairs."""
    sets, parent = [shingles(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc_id, _) in enumerate(docs):
        groups.setdefault(root(i), []).append(doc_id)
    return {min(g) for g in groups.values()}


def changed(rng, text, n):
    own = text.split()
    for at in rng.sample(range(len(own)), n):
        own[at] = "new"
    return " ".join(own)


@pytest.mark.parametrize("slice_nodes", [1024, 4])
def test_near_copies_go(spark, monkeypatch, slice_nodes):
    monkeypatch.setattr(neardup, "SLICE_NODES", slice_nodes)
    rng = random.Random(6)
    base = [" ".join(rng.choices(VOCABULARY, k=k)) for k in [100] * 10 + [400] * 10]
    near = [changed(rng, b, n) for b in base for n in ((1, 2, 3) if len(b.split()) == 100 else (4, 8, 12))]
    crowd = [changed(rng, base[0], 1) for _ in range(20)]
    docs = list(enumerate([*base, *near, *crowd]))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, cases.documents(spark, docs, extra=True), "").collect()}
    assert kept == first_of_groups(docs)
    assert len(kept) < len(docs) - 50


def test_links_are_those_of_the_sets():
    rng = random.Random(9)
    base = " ".join(rng.choices(VOCABULARY, k=120))
    texts = [base, *(changed(rng, base, n) for n in (1, 2, 3, 4, 8) for _ in range(4))]
    sets = [neardup.shingle_set(t) for t in texts]
    a, b = neardup.links_within(np.arange(len(texts)), sets)
    part = list(range(len(texts)))
    for x, y in zip(a, b):
        part = [part[x] if p == part[y] else p for p in part]
    assert {part.index(p) for p in part} == first_of_groups(list(enumerate(texts)))


def test_rows_without_words_or_ids(spark):
    text = "one two three four five six seven eight"
    docs = [(5, text), (3, text), (3, text), (None, text), (None, "alone without an id here"), (7, None), (8, ""), (None, None)]
    frame = cases.documents(spark, docs, extra=True)
    kept = neardup.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, text), (None, docs[4][1]), (7, None)], key=str)
    assert neardup.deduplicate(frame.limit(0)).count() == 0


def test_texts_are_shuffled_once(spark, monkeypatch):
    """Keeping the first documents and dropping repeated rows took two shuffles of whole documents."""
    docs = cases.documents(spark, [(5, "one two"), (3, "one two"), (3, "one two"), (None, "alone"), (None, "alone"), (0, ""), (None, "")])
    first = docs.filter("doc_id is null or doc_id = 3").select(*tables.row_key(docs))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = tables.of_rows(docs, first)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("LeftSemi")]
        assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, ""), (0, "alone"), (3, "one two")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
