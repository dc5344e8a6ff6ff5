"""Benchmark decontamination: a hash set of benchmark word windows against every word window of a corpus.

Only DataFrame expressions are used. A window is ``size`` consecutive words of a benchmark text; a text of
fewer words, but not none, is one window. Window hashes are built by doubling (1, 2, 4, 8 words, then their
sums), so a document word takes part in a handful of hashes whatever the window size. The hashes meet the set
in a broadcast hash join while it has at most ``broadcast_rows`` windows, otherwise in a shuffled join that
adaptive execution splits where a window is frequent; each match is verified on its words.

Defined cases: null and empty texts have no words, are never hit and contaminate nothing; repeated rows each
keep their own result row; rows with a null id are scanned like others; an empty benchmark hits nothing; other
columns, whatever their names, are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import row_key, same_key, stored, unpacked, words

#: Windows above this number (about 200 bytes each) are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _joined(left: Column, right: Column, shift: int, count: Column) -> Column:
    """Hashes of windows made of a left part and the part that starts ``shift`` words later."""
    return F.zip_with(F.slice(left, F.lit(1), count), F.slice(right, F.lit(1 + shift), count), lambda a, b: F.xxhash64(a, b))


def with_window_hashes(frame: DataFrame, sizes: list[int]) -> DataFrame:
    """Add ``_h<n>`` for each size: the hashes of the n-word windows of column ``_words``, by start position."""
    binary = {n: [1 << i for i in range(n.bit_length()) if n >> i & 1][::-1] for n in sizes}
    frame = frame.withColumn("_n", F.size("_words")).withColumn("_p1", F.transform("_words", lambda w: F.xxhash64(w)))
    have = 1
    while have * 2 <= max(sizes, default=1):
        count = F.greatest(F.col("_n") - (2 * have - 1), F.lit(0))
        frame = frame.withColumn(f"_p{2 * have}", _joined(F.col(f"_p{have}"), F.col(f"_p{have}"), have, count))
        have *= 2
    for size, parts in binary.items():
        done, column = parts[0], F.col(f"_p{parts[0]}")
        for part in parts[1:]:
            column = _joined(column, F.col(f"_p{part}"), done, F.greatest(F.col("_n") - (done + part - 1), F.lit(0)))
            done += part
        frame = frame.withColumn(f"_h{size}", column)
    return frame


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """One row per window of every item: item_id, length, gram (its words, space-joined)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("_words")).filter(F.size("_words") > 0)
    length = F.least(F.size("_words"), F.lit(size))
    starts = items.select("item_id", "_words", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("_words") - length + 1)).alias("_at"))
    gram = F.array_join(F.slice("_words", F.col("_at"), F.col("length")), " ")
    return starts.select(F.col("item_id").cast("string").alias("item_id"), "length", gram.alias("gram")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Verified occurrences: one row per document key with the hit word positions and the items found.

    Columns ``_id``, ``_text_key``, ``positions`` (array, from 0) and ``item_ids`` (sorted strings).
    """
    windows = stored(benchmark_windows(benchmark, size), "benchmark-windows")
    sizes = [r[0] for r in windows.select("length").distinct().orderBy(F.desc("length")).collect()] or [size]
    grams = windows.groupBy("gram", "length").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    grams = with_window_hashes(grams.withColumn("_words", F.split("gram", " ")), sizes)
    hashed = F.coalesce(*(F.when(F.col("length") == n, F.col(f"_h{n}")[0]) for n in sizes))
    grams = grams.select(hashed.alias("_hash"), "gram", "length", "items")
    if windows.count() <= broadcast_rows:
        grams = F.broadcast(grams)

    scanned = docs.select(*row_key(docs), words(F.col("text")).alias("_words"))
    scanned = with_window_hashes(scanned, sizes)
    every = F.concat(*(F.col(f"_h{n}") for n in sizes))
    scanned = scanned.select("_id", "_text_key", "_words", "_n", F.posexplode(every).alias("_at", "_hash"))
    # Position within the hashes of its own size: those of the larger sizes come first.
    before, skipped = F.lit(0), None
    for n in sizes:
        test = F.col("length") == n
        skipped = F.when(test, before) if skipped is None else skipped.when(test, before)
        before = before + F.greatest(F.col("_n") - (n - 1), F.lit(0))
    found = scanned.join(grams, "_hash").withColumn("_at", F.col("_at") - skipped)
    found = found.filter((F.col("_at") >= 0) & (F.array_join(F.slice("_words", F.col("_at") + 1, F.col("length")), " ") == F.col("gram")))
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("_at"), F.col("_at") + F.col("length") - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    return found.groupBy("_id", "_text_key").agg(covered.alias("positions"), items.alias("item_ids"))


def mark(docs: DataFrame, benchmark: DataFrame, size: int = 10, **options) -> DataFrame:
    """Per document row: ``_doc`` (the whole row), n_words, hit positions (null if none), item_ids."""
    found = hits(docs, benchmark, size, **options)
    left = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), *row_key(docs), F.size(words(F.col("text"))).alias("n_words"))
    return left.join(found, same_key(left, found), "left").select("_doc", "n_words", "positions", "item_ids")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, **options) -> DataFrame:
    """The documents without any benchmark window; columns as before."""
    found = hits(docs, benchmark, size, **options)
    left = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), *row_key(docs))
    return left.join(found, same_key(left, found), "left_anti").select("_doc.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10, **options) -> DataFrame:
    """The documents with every hit word cut from ``text``, and the gap before it where the word before is hit too."""
    marked = mark(docs, benchmark, size, **options)
    text = F.col("_doc.text")
    pieces = F.regexp_extract_all(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    first_is_word = text.rlike(r"^[0-9A-Za-z\x{80}-\x{10FFFF}]").cast("int")
    shift = 1 - first_is_word  # piece i is word (i - shift) / 2 when that is whole
    word_of = lambda i: F.floor((i - shift) / 2).cast("int")
    is_word = lambda i: F.pmod(i - shift, F.lit(2)) == 0
    cut = lambda w: F.array_contains("positions", w)
    keep = lambda _, i: ~F.when(is_word(i), cut(word_of(i))).otherwise(cut(word_of(i)) & cut(word_of(i) + 1))
    cleaned = F.when(F.col("positions").isNull(), text).otherwise(F.array_join(F.filter(pieces, keep), ""))
    return unpacked(marked, docs.columns, cleaned)
