"""Operators on whole corpora: decontamination, line dedup, near duplicates, neighbours, mixing."""

import random

import brute
import cases
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from decoylens.llm import ann, components, decontaminate, linededup, mixing, queries, simhash

SMALL = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


# Benchmark decontamination

ITEMS = {
    1: "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu",
    10: "short item",
    2: "the theta iota kappa",
    3: None,
    4: "",
    5: "Éa b c d e f g h i j k l",
    6: "alpha beta gamma delta epsilon zeta eta theta iota kappa",
}
DOCS = [
    *cases.AWKWARD,
    (40, "x Alpha, BETA gamma-delta epsilon zeta eta theta iota kappa lambda y"),
    (41, "alpha beta gamma delta epsilon zeta eta theta iota nothing"),
    (42, "a short item in a Short Item, short. item"),
    (42, "Éa b c d e f g h i j k l and éa b c d e f g h i j k l"),
    (43, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu the theta iota kappa"),
    (43, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu the theta iota kappa"),
]


def marked(spark, docs, items, **options):
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = decontaminate.mark(docs, bench, **options)
    return rows.select("_doc.doc_id", "n_words", F.coalesce(F.size("positions"), F.lit(0)), F.coalesce("item_ids", F.array().cast("array<string>")))


@pytest.mark.parametrize("size, limit", [(10, 1000), (10, 0), (3, 1000)])
def test_contamination(spark, size, limit):
    docs = cases.documents(spark, DOCS, extra=True)
    rows = marked(spark, docs, ITEMS, size=size, broadcast_rows=limit)
    expected = [(i, *brute.contamination(t[:2000] if t and t.startswith("long ") else t, ITEMS, size)) for i, t in DOCS]
    expected = [(i, len(brute.words(t)), *e[2:]) for (i, t), e in zip(DOCS, expected)]
    assert plain(rows.collect()) == plain((i, n, h if h > 0 else 0, list(x)) for i, n, h, x in expected)


def test_clean_and_cut_spans(spark):
    docs = cases.documents(spark, DOCS, extra=True)
    bench = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    hit = [brute.contamination(t if not t or len(t) < 1000 else "", ITEMS, 10)[1] > 0 for _, t in DOCS]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert plain(kept.select("doc_id", "text").collect()) == plain(d for d, h in zip(DOCS, hit) if not h)
    cut = {(r["doc_id"], r["text"]) for r in decontaminate.without_spans(docs, bench).collect()}
    assert (40, "x  y") in cut and (43, "") in cut and (42, "a  in a ") in cut
    assert all((i, t) in cut for (i, t), h in zip(DOCS, hit) if not h)
    empty = bench.limit(0)
    assert decontaminate.clean(docs, empty).count() == len(DOCS) and decontaminate.clean(docs.limit(0), bench).count() == 0


def test_decontamination_runs_no_python(spark):
    plan = queries.op3_decontamination(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


# Line dedup

LINES = ["a line that is long enough to count", "  A LINE that is long enough to count\t", "short", "another line of more than twenty", "", "x" * 19, "y" * 20, "é" * 20, "trailing \r"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 8), st.lists(st.sampled_from(LINES), max_size=6).map("\n".join)), min_size=1, max_size=14))
def test_line_dedup(spark, docs):
    rows = linededup.deduplicate(cases.documents(spark, docs, extra=True), batches=3, fan_in=2)
    rows = rows.select("_doc.doc_id", "n_lines", "n_dropped", "kept")
    assert plain(rows.collect()) == plain(brute.line_dedup(docs))


def test_line_dedup_of_awkward_rows(spark):
    line = "this very line is in a lot of documents"
    docs = [*cases.AWKWARD, (None, line), (None, line), (60, line), (61, f"{line}\n{line}\nother"), (62, "none"), (63, f" {line.upper()} ")]
    frame = cases.documents(spark, docs, extra=True)
    rows = linededup.deduplicate(frame, batches=2).select("_doc.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert plain(rows) == plain(brute.line_dedup(docs))
    cleaned = linededup.clean(frame)
    assert cleaned.columns == frame.columns
    assert plain(cleaned.select("doc_id", "text").collect()) == plain((i, t) for i, _, _, t in brute.line_dedup(docs))
    assert linededup.clean(frame.limit(0)).count() == 0


def test_runs_stay_disjoint_through_compaction(spark):
    runs = linededup.LineRuns(spark, buckets=4, fan_in=2)
    rng, seen = random.Random(3), {}
    for batch in range(5):
        rows = [(batch * 100 + d, rng.randrange(30), 0) for d in range(20)]
        rows = sorted(set(rows))
        runs.add(spark.createDataFrame(rows, "doc_id long, h1 long, h2 int"))
        for doc, h, _ in rows:
            seen.setdefault(h, set()).add(doc)
        keys = [r["h1"] for run in runs.runs() for r in run.collect()]
        assert sorted(keys) == sorted(seen)
        assert all(len(level) < 2 for level in runs.levels)
    assert {(r["h1"], r["last_doc"]) for r in runs.frequent(3).collect()} == {(h, max(d)) for h, d in seen.items() if len(d) >= 3}
    runs.drop()


# SimHash


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "Word", "\x1f", " ", "x y", " "]), max_size=30).map(" ".join))
def test_fingerprints(text):
    assert simhash.fingerprint(text, 3) == brute.fingerprint(text)


def test_every_pair_in_reach_shares_a_mask():
    rng = random.Random(5)
    for radius in (1, 2, 3):
        for positions in (list(range(64)), rng.sample(range(64), 30), rng.sample(range(64), 14)):
            masks = simhash.covering_masks(positions, radius, 11)
            assert len(masks) <= 2 ** (radius + 1) - 1
            for _ in range(500):
                change = sum(1 << p for p in rng.sample(positions, radius))
                assert any(not change & m for m in masks)


def test_groups_match_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(25)]
    near = [" ".join(w if rng.random() > 0.01 else "new" for w in b.split()) for b in base for _ in range(3)]
    docs = list(enumerate([*base, *near, *base[:5], *(t for _, t in cases.AWKWARD)]))
    rows = simhash.groups(cases.documents(spark, docs, extra=True)).collect()
    prints = [brute.fingerprint(t) for _, t in docs]
    expected = brute.components([i for i, _ in docs], prints, 3)
    assert len({*expected}) < len(docs) - 20
    assert sorted((r["_id"], r["fp"] % 2**64, r["component_id"]) for r in rows) == [(i, p, c) for (i, _), p, c in zip(docs, prints, expected)]


def test_large_buckets_are_split_without_loss(spark):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(700):
        x = rng.choice(list(prints)) if rng.random() < 0.7 else centre
        for p in rng.sample(range(64), rng.randrange(1, 6)):
            x ^= 1 << p
        prints.add(x)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(frame, bucket_limit=128)).collect()}
    expected = brute.components(signed, prints, 3)
    mine = [roots.get(p, p) for p in signed]
    assert len(set(zip(mine, expected))) == len(set(mine)) == len(set(expected))


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (2000, 2001), (2001, 2000)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, parts.values())) == [list(range(101)), list(range(1000, 1100)), [2000, 2001]]


def test_one_document_of_each_group_stays(spark):
    text = "one two three four five six seven eight"
    docs = [(5, text), (3, text), (3, text), (None, text), (9, "something else that is not near to it at all"), (None, "alone without an id here"), (None, "alone without an id here"), (7, None), (8, "")]
    frame = cases.documents(spark, docs, extra=True)
    kept = simhash.deduplicate(frame)
    assert kept.columns == frame.columns
    assert plain(kept.select("doc_id", "text").collect()) == plain([(3, text), (9, docs[4][1]), (None, docs[5][1]), (7, None)])
    assert simhash.deduplicate(frame.limit(0)).count() == 0


# Nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, class string, id int")


def searched(frame, k=20):
    found = {}
    for r in sorted(ann.search(frame, F.col("vec_id") % 20 == 0, k=k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(found.setdefault(r["query_id"], [])) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    return found


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, matrix = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    found = {}
    for r in queries.op2_ann(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert r["score"] == pytest.approx(matrix[ids == r["query_id"]][0] @ matrix[ids == r["vec_id"]][0], abs=1e-12)
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0} and all(len(v) == 20 for v in found.values())
    recall = np.mean([len(found[q] & set(brute.nearest(ids, matrix, q, 20))) / 20 for q in found])
    assert recall >= 0.95


def test_vectors_of_unequal_length_and_many_copies(spark):
    rng = np.random.default_rng(4)
    matrix = rng.standard_normal((400, 16)).astype(np.float32) * rng.uniform(0.2, 3, (400, 1)).astype(np.float32)
    matrix[100:200] = matrix[100]
    frame = vectors(spark, [(i, v.tolist()) for i, v in enumerate(matrix)])
    found = searched(frame)
    exact = matrix.astype(np.float64)
    recall = np.mean([len({i for i, _ in found[q]} & set(brute.nearest(np.arange(400), exact, q, 20))) / 20 for q in found])
    assert recall >= 0.9
    near = brute.nearest(np.arange(400), exact, 100, 20)
    assert [i for i, _ in found[100]] == near or len({*near} & {i for i, _ in found[100]}) >= 18


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
        (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, None), (10, [-1.0, 0.0]), (10, [-1.0, 0.0]), (2, [5.0, 5.0]),
    ]
    found = searched(vectors(spark, rows))
    assert found == {0: [(1, 1.0), (2, 1.0), (20, 0.0), (10, -1.0)], 20: [(1, 2.0), (2, 2.0), (0, 0.0), (10, 0.0)]}
    assert searched(vectors(spark, rows[:1])) == {}
    assert searched(vectors(spark, []).limit(0)) == {}


def test_perturbations_are_valid_and_in_order():
    sets = ann.perturbations(5, 60)
    assert len(set(sets)) == len(sets) == 60 and sets[0] == () and sets[1] == (0,)
    assert all(not {9 - r for r in s} & set(s) for s in sets)


# Mixing


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0.01, 5), min_size=1))
def test_no_block_is_early_or_late(weights):
    share = mixing.shares(weights, 200)
    assert sum(share.values()) == 200
    slots = mixing.period_slots(share)
    assert sorted(x for s in slots.values() for x in s) == list(range(200))
    for s, a in share.items():
        for k, slot in enumerate(slots[s]):
            assert k * 200 // a <= slot < -(-(k + 1) * 200 // a)


def test_mixing_places_every_row_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    weights = {f"src{i}": 1.0 + i for i in range(20)}
    rows = mixing.mix(docs, weights, block_rows=4).select("_doc.doc_id", "mix_group", "block", "slot", "position").collect()
    assert sorted(r["position"] for r in rows) == list(range(docs.count()))
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert [r["slot"] for r in sorted(rows, key=lambda r: r["position"])] == sorted(r["slot"] for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r["slot"], set()).add((r["mix_group"], r["block"]))
    assert all(len(s) == 1 for s in slots.values()) and sorted(slots) == list(range(len(slots)))
    # While all sources last, each has its weight's part of the slots, up to less than one block.
    share = mixing.shares(weights, 1000)
    last = {s: max(r["slot"] for r in rows if r["mix_group"] == s) for s in weights}
    for t in range(1, min(last.values()) + 1):
        done = [next(iter(slots[x]))[0] for x in range(t)]
        assert all(abs(done.count(s) - share[s] / 1000 * t) < 1 for s in weights)


def test_mixing_of_awkward_rows(spark):
    docs = cases.documents(spark, [*cases.AWKWARD, (70, "a"), (70, "a"), (70, "b")], extra=True)
    rows = mixing.mix(docs, block_rows=2, max_sources=8).select("position", "_doc.doc_id").collect()
    assert sorted(r["position"] for r in rows) == list(range(len(cases.AWKWARD) + 3))
    arranged = mixing.arrange(docs, block_rows=2)
    assert arranged.columns == docs.columns and arranged.count() == docs.count()
    assert [r["doc_id"] for r in arranged.collect()] == [r["doc_id"] for r in mixing.mix(docs, block_rows=2).orderBy("position").select("_doc.doc_id").collect()]
    assert mixing.arrange(docs.limit(0)).count() == 0
    folded = mixing.mix(docs, max_sources=2)
    assert folded.select("mix_group").distinct().count() <= 2 and folded.count() == docs.count()
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 1.0})
