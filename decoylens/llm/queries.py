"""The registered queries of this package, op1 to op13 and the pipeline, and the SQL twins of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import ann, decontaminate, hardnegatives, hyperminhash, licences, linededup, lloyd, mixing, pii, quality, simhash, tokenfile, toxicity
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]
DOC = "_doc.doc_id"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    n_hit = F.coalesce(F.size("positions"), F.lit(0)).cast("long")
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    return marked.select(
        DOC,
        F.col("n_words").cast("long").alias("n_words"),
        F.when(F.col("positions").isNull(), F.lit(0)).otherwise(n_hit).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("positions").isNotNull().alias("contaminated"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = linededup.deduplicate(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return lines.select(DOC, "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.groups(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.select(F.col("_id").alias("doc_id"), simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write(table(spark, sf_dir, "documents"))
    return tokenfile.read(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(DOC, "held_out", "score", "predicted")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(DOC, F.col("_doc.source").alias("source"), "block", "slot", "position")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(DOC, "held_out", "score", "predicted")


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = hyperminhash.groups(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False))
    return groups.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hardnegatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label, scale=256, positives=5, per_positive=5, share=(80, 100))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lloyd.report(*lloyd.cluster(table(spark, sf_dir, "embeddings"), clusters=16, rounds=3, width=64, scale=64))
    return found.withColumnRenamed("id", "vec_id")


WORDS_SQL = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS words FROM benchmark),
starts AS (SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS pos FROM b WHERE len(words) > 0),
grams AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(words[pos:pos + n - 1], ' ') AS gram FROM starts),
sizes AS (SELECT DISTINCT n FROM grams),
spots AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM d, sizes),
texts AS (SELECT doc_id, n, pos, array_to_string(words[pos:pos + n - 1], ' ') AS gram FROM spots),
found AS (SELECT doc_id, t.n, pos, item FROM texts t JOIN grams g ON t.n = g.n AND t.gram = g.gram),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4_SQL = r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> last_doc AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP11_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, greatest(len(words) - 3, 1) + 1)]) AS shingle FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_ids AS (SELECT a, min(b) AS least_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id, doc_id <= coalesce(least_id, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ids ON a = doc_id
"""

OP12_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) <= 5)
SELECT p.a_id AS anchor_id, p.b_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.b_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a_id = p.a_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
WINDOW w AS (PARTITION BY p.a_id, p.b_id ORDER BY s.score DESC, s.b_id) QUALIFY row_number() OVER w <= 5
"""


def _lloyd_round(n: int) -> str:
    """Assignments to the centroids of round ``n``, and the centroids of the next."""
    return f"""
a{n} AS (
    SELECT vec_id, v.c, cluster, CAST(list_sum(list_transform(list_zip(v.c, m.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance
    FROM v, c{n} AS m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1
),
s{n} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(c) AS x, unnest(range(64)) AS i FROM a{n}) GROUP BY ALL),
c{n + 1} AS (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{n} AS o LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY cluster) AS m USING (cluster)),"""


OP13_SQL = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS (SELECT CAST(row_number() OVER o - 1 AS INTEGER) AS cluster, c FROM v WINDOW o AS (ORDER BY sha256('1:' || vec_id)) QUALIFY row_number() OVER o <= 16),
{"".join(map(_lloyd_round, range(4))).rstrip(",")}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_pii, op2_ann, op3_decontamination, op4_line_dedup, op5_simhash, op6_token_file, op7_toxicity, op8_licences, op9_mixing, op10_quality, op11_hyperminhash, op12_hard_negatives, op13_centroids)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {"op3_decontamination": OP3_SQL, "op4_line_dedup": OP4_SQL, "op11_hyperminhash": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_centroids": OP13_SQL}
