"""What histograms of sequence codes cost under coding tables: entropy bound, a default table, a fresh one, and the choice of mode. All are
grouped sums over (channel, code, n) rows and a small table of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.entropy import inverse_log

# Fixed values (RFC 8878, section 3.1.1.3.2.2): the default distributions of the three channels, -1 for less than one state, and the log of their states.
DEFAULTS = {
    "ll": (6, (4, 3, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3, 2, 1, 1, 1, 1, 1, -1, -1, -1, -1)),
    "ml": (6, (1, 4, 3, 2, 2, 2, 2, 2, 2, *(1,) * 37, *(-1,) * 7)),
    "of": (5, (1, 1, 1, 1, 1, 1, 2, 2, 2, *(1,) * 15, *(-1,) * 5)),
}


def default_table(spark: SparkSession) -> DataFrame:
    """channel, code, norm, price: the default distributions, and a code's price in 256ths of a bit under them (-1 counts as one state)."""
    rows = [(c, k, v, inverse_log(abs(v) << (8 - log))) for c, (log, norms) in DEFAULTS.items() for k, v in enumerate(norms)]
    return spark.createDataFrame(rows, "channel string, code int, norm int, price int")


def description_bits(largest: Column) -> Column:
    """Estimated bits of a fresh table's description: six for each code up to the largest, and eight."""
    return (largest + 1) * 6.0 + 8


def channel_costs(histogram: DataFrame, *by: str) -> DataFrame:
    """Of each group of (code, n) rows by channel: n_codes, n, largest code, entropy_bits (the lower bound), fresh_bits (the bound and a
    description), default_bits (null if the default table lacks a code)."""
    # the default table has fewer than 150 rows, so it goes to every task
    rows = histogram.join(F.broadcast(default_table(histogram.sparkSession)), ["channel", "code"], "left")
    n = F.sum("n")
    out = rows.groupBy(*by, "channel").agg(
        F.count("*").alias("n_codes"), n.cast("long").alias("n"), F.max("code").alias("largest"), (n * F.log2(n) - F.sum(F.col("n") * F.log2("n"))).alias("entropy_bits"),
        F.when(F.count("price") == F.count("*"), F.floor(F.sum(F.col("n") * F.col("price")) / 256)).cast("long").alias("default_bits"),
    )
    return out.withColumn("fresh_bits", F.col("entropy_bits") + description_bits(F.col("largest")))


def repeat_costs(histogram: DataFrame, previous: DataFrame, *by: str) -> DataFrame:
    """Bits of (channel, code, n) rows under the code shares of a previous histogram of the same group, `repeat_bits`; null if that lacks a code."""
    old = previous.groupBy(*by, "channel").agg(F.sum("n").alias("total")).join(previous, [*by, "channel"]).select(*by, "channel", "code", F.log2(F.col("total") / F.col("n")).alias("bits"))
    rows = histogram.join(old, [*by, "channel", "code"], "left")
    return rows.groupBy(*by, "channel").agg(F.when(F.count("bits") == F.count("*"), F.sum(F.col("n") * F.col("bits"))).alias("repeat_bits"))


def table_mode(n_codes: Column, n: Column, fresh: Column, default: Column, repeat: Column) -> Column:
    """The cheapest way to send a channel: 'rle' for one code seen more than twice, else the cheapest of 'repeat', 'predefined' and
    'fresh', the earlier at equal bits."""
    inf = F.lit(float("inf"))
    r, d = F.coalesce(repeat, inf), F.coalesce(default.cast("double"), inf)
    return F.when((n_codes == 1) & (n > 2), "rle").when((r <= d) & (r <= fresh), "repeat").when(d <= fresh, "predefined").otherwise("fresh")


def parse_cost(literal_bits: Column, extra_bits: Column, n_sequences: Column, code_bits: int) -> Column:
    """Bits of a parse before entropy coding of its codes: literals at their entropy, and code_bits for each sequence with its extra bits."""
    return literal_bits + extra_bits + n_sequences * code_bits
