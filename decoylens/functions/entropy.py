"""Shannon entropy in bits, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _weight(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))


def shannon_entropy(text: Column | str) -> Column:
    """Bits per character of a string; 0 for null and empty strings.

    Walks the distinct characters and removes each from what is left of the string; how much it
    shrinks is the count. Every step is one native replace on an ever shorter string. The state is
    (what is left, its size before the last removal, size of the removed character, weight so far).
    """
    text = F.col(text) if isinstance(text, str) else text
    size = F.length(text).cast("double")
    removed = lambda s: (s["before"] - F.octet_length(s["rest"])) / s["width"]
    start = F.struct(
        text.alias("rest"), F.octet_length(text).alias("before"), F.lit(1).alias("width"), F.lit(0.0).alias("total")
    )
    total = F.aggregate(
        F.array_distinct(F.split(text, "")),
        start,
        lambda s, symbol: F.struct(
            F.replace(s["rest"], symbol).alias("rest"),
            F.octet_length(s["rest"]).alias("before"),
            F.octet_length(symbol).alias("width"),
            (s["total"] + _weight(removed(s))).alias("total"),
        ),
        lambda s: s["total"] + _weight(removed(s)),
    )
    return F.when(F.coalesce(size, F.lit(0.0)) > 0, F.abs(F.log2(size) - total / size)).otherwise(F.lit(0.0))


def list_entropy(items: Column | str) -> Column:
    """Bits per element of a bounded array; 0 for null and empty arrays."""
    items = F.col(items) if isinstance(items, str) else items
    size = F.size(items).cast("double")
    counts = F.transform(F.array_distinct(items), lambda item: F.size(F.filter(items, lambda other: other == item)))
    total = F.aggregate(counts, F.lit(0.0), lambda acc, count: acc + _weight(count.cast("double")))
    return F.when(F.coalesce(size, F.lit(0.0)) > 0, F.abs(F.log2(size) - total / size)).otherwise(F.lit(0.0))


def entropy_of_counts(count: Column) -> Column:
    """Aggregate: entropy of a group whose rows each carry one category's count.

    Uses log2(N) - sum(c*log2 c)/N, which is built from plain sums and so combines on the map side.
    """
    positive = F.when(count > 0, count.cast("double"))
    total = F.sum(positive)
    return F.when(
        F.coalesce(total, F.lit(0.0)) > 0,
        F.abs(F.log2(total) - F.sum(positive * F.log2(positive)) / total),
    ).otherwise(F.lit(0.0))
