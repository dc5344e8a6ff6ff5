"""Fixed-length event sequences per source address."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.entropy import shannon_entropy
from ..functions.scalars import MICROS, micros
from ..functions.vocabulary import EVENT_CODES, PROTOCOL_CODES, STATE_CODES, lookup
from .ordered import first_n

EVENT_DIMS, FLOW_DIMS = 7, 8


def _log_delta() -> Column:
    """log1p of the seconds since the previous step, 0 on the first, never negative."""
    step = micros("timestamp") - F.lag(micros("timestamp")).over(Window.partitionBy("src_ip").orderBy("rank"))
    return F.log1p(F.greatest(F.coalesce(step, F.lit(0)), F.lit(0)) / F.lit(float(MICROS)))


def event_vector() -> list[Column]:
    """Seven dimensions of one session event, apart from the time delta."""
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    return [
        F.col("hour") / 23.0,
        F.length(text("username")) / 32.0,
        F.length(text("password")) / 32.0,
        shannon_entropy("password") / 8.0,
        (F.coalesce(F.col("eventid") == "cowrie.login.success", F.lit(False))).cast("double"),
        lookup(EVENT_CODES, F.col("eventid"), 0) / 7.0,
    ]


def flow_vector() -> list[Column]:
    """Eight dimensions of one flow, apart from the time delta."""
    number = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return [
        F.col("hour") / 23.0,
        F.log1p(number("duration")),
        F.log1p(number("orig_bytes")),
        F.log1p(number("resp_bytes")),
        number("dst_port") / 65535.0,
        lookup(PROTOCOL_CODES, F.lower("proto"), 3) / 3.0,
        lookup(STATE_CODES, F.coalesce("conn_state", F.lit("OTH")), 12) / 12.0,
    ]


def first_steps(
    df: DataFrame, kind: str, seq_len: int, order: Sequence[str], salt: str, valid: DataFrame | None = None
) -> DataFrame:
    """``(src_ip, rank, vec)`` for the first ``seq_len`` rows of each (valid) address.

    Validity is a property of the address, so it is tested after the group limit, on few rows.
    """
    first = first_n(df.filter(F.col("src_ip").isNotNull()), ["src_ip"], list(order), seq_len, salt)
    if valid is not None:
        first = first.join(valid, "src_ip", "left_semi")
    rest = event_vector() if kind == "events" else flow_vector()
    return first.select("src_ip", "rank", F.array(_log_delta(), *[c.cast("double") for c in rest]).alias("vec"))


def pad_sequences(steps: DataFrame, seq_len: int, dims: int) -> DataFrame:
    """One row per address: ``n_steps`` and ``seq``, zero rows in front up to ``seq_len``."""
    zero = F.array_repeat(F.lit(0.0), dims)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec"))), lambda s: s["vec"])
    packed = steps.groupBy("src_ip").agg(ordered.alias("_seq")).withColumn("n_steps", F.size("_seq"))
    padding = F.array_repeat(zero, F.lit(seq_len) - F.col("n_steps"))
    return packed.select("src_ip", "n_steps", F.concat(padding, "_seq").alias("seq"))


def build_sequences(
    df: DataFrame, kind: str, seq_len: int, order: Sequence[str], salt: str, valid: DataFrame | None = None
) -> DataFrame:
    dims = EVENT_DIMS if kind == "events" else FLOW_DIMS
    return pad_sequences(first_steps(df, kind, seq_len, order, salt, valid), seq_len, dims)


def attach_labels(sequences: DataFrame, labels: DataFrame) -> DataFrame:
    return sequences.join(labels, "src_ip")


def step_moments(sequences: DataFrame, training: Column) -> DataFrame:
    """Mean and population deviation per dimension over the real steps of the training rows."""
    real = sequences.filter(training).select(
        F.explode(F.slice("seq", F.size("seq") - F.col("n_steps") + 1, F.col("n_steps"))).alias("step")
    )
    used = real.filter(F.exists("step", lambda v: v != 0))
    cells = used.select(F.posexplode("step").alias("dim", "v"))
    return cells.groupBy("dim").agg(F.avg("v").alias("mu"), (F.stddev_pop("v") + F.lit(1e-8)).alias("sd"))


def standardise_sequences(sequences: DataFrame, training: Column) -> DataFrame:
    """Z-score every real step with the training moments; padding stays zero.

    Padding is known from ``n_steps``, not guessed from row sums. The moments are one row per
    dimension and enter the plan as a scalar subquery. The sequences are read twice, hence cached.
    """
    sequences = sequences.persist()
    table = step_moments(sequences, training).agg(F.array_sort(F.collect_list(F.struct("dim", "mu", "sd"))).alias("m"))
    scaled = sequences.withColumn("_m", table.scalar())
    pad = F.size("seq") - F.col("n_steps")
    z = F.transform(
        "seq",
        lambda step, i: F.when(
            i >= pad, F.zip_with(step, F.col("_m"), lambda v, m: (v - m["mu"]) / m["sd"])
        ).otherwise(F.transform(step, lambda v: F.lit(0.0))),
    )
    return scaled.withColumn("seq", z).drop("_m")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Per class sqrt(n / (k * n_c)), divided by the mean over the classes."""
    whole = Window.partitionBy(F.lit(0))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    raw = F.sqrt(F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n")))
    return counts.withColumn("_raw", raw).select(label, "n", (F.col("_raw") / F.avg("_raw").over(whole)).alias("weight"))
