"""Percentiles per group by exact bisection.

For each (group, percentile) an interval of values is kept in which the target rank lies.  A pass cuts every interval at
its midpoints, counts the rows in each part, and keeps the part with the target rank; when a part holds one distinct
value, that is the percentile.  Intervals are cut in the order-preserving integer code of a double, so that at most
64 / log2(``ways``) passes are needed whatever the values; the parts' smallest and largest values narrow them further.
After each pass only the rows inside live intervals are written for the next, so of the whole table there are two scans.

Counting has partial sums before its shuffle, so a group with a third of all rows is no hot spot; the live intervals are
broadcast only while there are at most ``broadcast_rows`` of them.  Beyond, rows and intervals are joined by group and one
of ``salts`` parts of the group's codes, so that a large group is many tasks then too.

:func:`summarize` gives the mergeable form: per group, counts, smallest and largest value of each bin of relative width
2**-bits.  Summaries of parts, children or days are combined by :func:`merge` and hold any percentile to within that
relative error (:func:`bounds`).

Defined cases: null and NaN values do not count; a null group is a group; -0.0 equals 0.0; ties are one value counted so
often; infinite values count as the largest and smallest; empty tables give empty tables.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.workspace import materialize, remove_table


def order_code(value: Column) -> Column:
    """A long that orders as the double does: sign, exponent and mantissa, exactly."""
    size = F.abs(value)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-1023)).cast("double")
    guess = F.when(size < F.pow(F.lit(2.0), guess), guess - 1).when(size >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    exponent = F.greatest(F.least(guess, F.lit(1023.0)), F.lit(-1022.0))
    normal = (exponent + 1023).cast("long") * F.lit(1 << 52) + ((size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(float(1 << 52))).cast("long")
    tiny = (size * F.pow(F.lit(2.0), F.lit(537.0)) * F.pow(F.lit(2.0), F.lit(537.0))).cast("long")
    code = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 << 52)).when(size < 2.0**-1022, tiny).otherwise(normal)
    return F.when(value < 0, -code).otherwise(code)


def _ranks(percentiles: list[float], n: Column) -> Column:
    """For each percentile the rank of the smallest value that at least that share of the rows does not exceed, in
    integers: p * n rounded up, at least 1."""
    one = []
    for p in percentiles:
        share = Fraction(str(p))
        raised = n * share.numerator + (share.denominator - 1)
        rank = (raised - F.pmod(raised, F.lit(share.denominator))) / F.lit(share.denominator)
        one.append(F.struct(F.lit(float(p)).alias("p"), F.greatest(rank.cast("long"), F.lit(1).cast("long")).alias("rank")))
    return F.array(*one)


def exact(
    df: DataFrame, group: str, value: str, percentiles: list[float], ways: int = 256, broadcast_rows: int = 200_000, salts: int = 32
) -> DataFrame:
    """(group, p, percentile, n): exact percentiles, by the rule of :func:`_ranks`."""
    number = F.col(value).cast("double")
    rows = df.select(F.col(group).alias("g"), number.alias("v")).where("v is not null and not isnan(v)").withColumn("c", order_code(F.col("v")))
    found = bisected(materialize(rows, "percentile_rows"), percentiles, ways, broadcast_rows, salts)
    return found.withColumnRenamed("g", group)


def bisected(rows: DataFrame, percentiles: list[float], ways: int = 256, broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """(g, p, percentile, n) of stored rows (g, v, c), c being the code of v."""
    stored = False
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("v").alias("least"), F.max("v").alias("most"))
    state = sizes.select("g", "n", "lo", "hi", "least", "most", F.explode(_ranks(percentiles, F.col("n"))).alias("t")).select("g", "n", "lo", "hi", "least", "most", "t.p", "t.rank")
    state = materialize(state, "percentile_state")
    solved = [state.where("lo = hi").select("g", "p", F.col("least").alias("percentile"), "n")]
    while live := (open_ := state.where("lo < hi")).count():
        # Parts of equal width in code; the width is computed in halves, as hi - lo may not fit a long.  Where it is less
        # than a part each (w = 1), every code is a part of its own: halves would leave adjacent codes together for ever.
        cut = open_.withColumn("w", ((F.expr("hi div 2 - lo div 2") / F.lit(max(ways // 2, 2))).cast("long") + 1))
        # Intervals of a group are the same or apart: those of several percentiles are counted once, known by their start.
        side = cut.select(F.col("g").alias("sg"), "lo", "hi", "w").distinct()
        inside = _inside(rows, side, live <= broadcast_rows, salts)
        part = F.expr("case when w = 1 then c - lo else (c div 2 - lo div 2) div w end")
        counted = inside.groupBy("g", "lo", part.alias("part")).agg(F.count("*").alias("k"), F.min("c").alias("a"), F.max("c").alias("b"), F.min("v").alias("va"), F.max("v").alias("vb"))
        # At most about ways parts of each interval: one sorted array, no window over rows.
        parts = counted.groupBy("g", F.col("lo").alias("from")).agg(F.sort_array(F.collect_list(F.struct("part", "k", "a", "b", "va", "vb"))).alias("parts"))
        step = cut.select(F.col("g").alias("sg"), "p", "lo", "rank", "n").join(parts, F.col("g").eqNullSafe(F.col("sg")) & (F.col("lo") == F.col("from"))).drop("lo")
        walk = F.expr(
            "aggregate(parts, named_struct('left', rank, 'hit', cast(null as struct<part:bigint,k:bigint,a:bigint,b:bigint,va:double,vb:double>)),"
            " (s, x) -> if(s.hit is not null, s, if(s.left <= x.k, named_struct('left', s.left, 'hit', x), named_struct('left', s.left - x.k, 'hit', s.hit))))"
        )
        state = step.withColumn("s", walk).select("g", "n", F.col("s.hit.a").alias("lo"), F.col("s.hit.b").alias("hi"), F.col("s.hit.va").alias("least"), F.col("s.hit.vb").alias("most"), "p", F.col("s.left").alias("rank"))
        state = materialize(state, "percentile_state")
        solved.append(state.where("lo = hi").select("g", "p", F.col("least").alias("percentile"), "n"))
        # What the next passes need: the rows inside a live interval, each once, as intervals of a group may meet.
        ahead = state.where("lo < hi")
        if ahead.isEmpty():
            break
        ends = ahead.groupBy("g").agg(F.collect_set(F.struct("lo", "hi")).alias("ends")).withColumnRenamed("g", "sg")
        near = _inside(rows, ends.select("sg", "ends", F.array_min("ends")["lo"].alias("lo"), F.array_max(F.transform("ends", lambda x: x["hi"])).alias("hi")), live <= broadcast_rows, salts)
        kept = materialize(near.where(F.exists("ends", lambda x: (F.col("c") >= x["lo"]) & (F.col("c") <= x["hi"]))).select("g", "v", "c"), "percentile_rows")
        if stored:
            remove_table(rows)
        rows, stored = kept, True
    out = solved[0]
    for more in solved[1:]:
        out = out.unionByName(more)
    return out.select("g", "p", "percentile", "n")


def _inside(rows: DataFrame, side: DataFrame, small: bool, salts: int) -> DataFrame:
    """Rows (g, v, c) with each interval (sg, lo, hi, ...) of their group that they lie in."""
    fits = F.col("g").eqNullSafe(F.col("sg")) & (F.col("c") >= F.col("lo")) & (F.col("c") <= F.col("hi"))
    if small:
        return rows.join(F.broadcast(side), fits)
    salted = rows.withColumn("__s", F.pmod(F.hash("c"), F.lit(salts)))
    every = side.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(every, fits & (F.col("__s") == F.col("__t"))).drop("__s", "__t")


def summarize(df: DataFrame, group: str, value: str, bits: int = 7) -> DataFrame:
    """The mergeable form: (group, bin, n, least, most); a bin holds values that agree in sign, exponent and the first
    ``bits`` bits of the mantissa."""
    rows = df.select(group, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    return rows.groupBy(group, F.shiftright(order_code(F.col("v")), 52 - bits).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


def merge(summaries: DataFrame, group: str) -> DataFrame:
    """One summary from those of several parts, children or days, given as a union."""
    return summaries.groupBy(group, "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def bounds(summary: DataFrame, group: str, percentiles: list[float]) -> DataFrame:
    """(group, p, least, most, n): the percentile lies between least and most, both values of the data."""
    bins = summary.groupBy(group).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bin", "n", "least", "most"))).alias("bins"))
    each = bins.select(group, "total", "bins", F.explode(_ranks(percentiles, F.col("total"))).alias("t"))
    walk = F.expr(
        "aggregate(bins, named_struct('left', t.rank, 'least', cast(null as double), 'most', cast(null as double)),"
        " (s, x) -> if(s.left <= 0, s, named_struct('left', s.left - x.n, 'least', x.least, 'most', x.most)))"
    )
    return each.withColumn("s", walk).select(group, F.col("t.p").alias("p"), "s.least", "s.most", F.col("total").alias("n"))


def outlying_entries(entries: DataFrame, factor: float = 4.0, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(i, j, seq) of entries whose value is more than ``factor`` times the high percentile of its j, or less than the
    low one over ``factor``.  Values count when j is not null and v is finite and above zero, each (i, j, seq) once."""
    usable = entries.where("j is not null and v > 0 and v < double('infinity')")
    # The code is written with the value, as every pass asks for it several times.
    once = usable.groupBy("i", "j", "seq").agg(F.min(F.col("v").cast("double")).alias("v"))
    once = materialize(once.withColumn("c", order_code(F.col("v"))), "entries_once")
    limits = bisected(once.select(F.col("j").alias("g"), "v", "c"), [low, high]).withColumnRenamed("g", "j").groupBy("j").agg(F.min("percentile").alias("floor"), F.max("percentile").alias("ceiling"))
    beyond = (F.col("v") > F.col("ceiling") * factor) | (F.col("v") * factor < F.col("floor"))
    return once.join(limits, "j").where(beyond).select("i", "j", "seq")
