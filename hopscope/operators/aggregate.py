"""Counts, histograms, quantiles and summaries of traffic and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.latency import bin_of
from ..scratch import cut, few


#: Ranges of a key's values between which running counts are carried, and rows of a key up to which one task puts them in order.
BUCKETS, PLAIN = 64, 1 << 20
#: Selection of ranks: accuracy of the sketch that brackets them, and values of a key up to which a task puts those inside a bracket in order.
ACCURACY, INSIDE = 2_000, 1 << 18


def _joined(rows: DataFrame, table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with ``columns`` of their keys' row in a small written table."""
    if not keys:
        return rows.crossJoin(F.broadcast(table.select(*columns)))  # one row
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return rows.alias("l").join(few(table).alias("r"), same).select("l.*", *[F.col(f"r.{c}") for c in columns])


def _dealt(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``_b``: the part of its key's range that a value lies in, by approximate quantiles of the rows."""
    edges = cut(rows.groupBy(*keys).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 1_000).alias("_edges")))
    return _joined(rows, edges, keys, ["_edges"]).select(*rows.columns, F.size(F.filter("_edges", lambda e: e < F.col(value))).alias("_b"))


def running(rows: DataFrame, keys: list[str], value: str, order: list[str] | None = None, count: str | None = None, name: str = "upto") -> DataFrame:
    """Add ``name``: how many rows of the same keys (or their sum of ``count``) come up to this one in order of ``value``, then ``order``.

    Keys of up to ``PLAIN`` rows each are put in order by a task a key. Beyond, it is a two-level prefix sum: values are
    dealt into ranges, whose totals are added up first, so that no key's rows meet in one task. Without
    ``order`` values should be distinct within their keys.
    """

    def upto(by: list) -> Column:
        own = Window.partitionBy(*by).orderBy(value, *(order or []))
        return (F.sum(count).over(own) if count else F.row_number().over(own)).cast("bigint")

    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= PLAIN:
        return rows.select("*", upto(keys or [F.lit(0)]).alias(name))
    dealt = _dealt(rows, keys, value)
    totals = dealt.groupBy(*keys, "_b").agg((F.sum(count) if count else F.count("*")).alias("_n"))
    before = cut(totals.select(*keys, "_b", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).alias("_before")))  # BUCKETS rows a key
    out = _joined(dealt.withColumn("_within", upto([*keys, "_b"])), before, [*keys, "_b"], ["_before"])
    return out.select(*rows.columns, (F.col("_within") + F.col("_before")).cast("bigint").alias(name))


def _value_counts(rows: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """Distinct values of each key with their counts, and with the counts up to each and in all: v, c, upto, n."""
    counts = cut(rows.select(*keys, value.alias("v")).where("v IS NOT NULL").groupBy(*keys, "v").agg(F.count("*").alias("c")))
    total = cut(counts.groupBy(*keys).agg(F.sum("c").alias("n")))
    return _joined(running(counts, keys, "v", count="c"), total, keys, ["n"])


def _narrowed(found: DataFrame, by: list[str], asked: DataFrame) -> DataFrame:
    """Counts of values (``by``, v, c; a null v stands for all that lie below) without those that can't be at the ranks asked for."""
    dealt = _dealt(found.where("v IS NOT NULL"), by, "v")
    totals = dealt.groupBy(*by, "_b").agg(F.sum("c").alias("_n")).unionByName(found.where("v IS NULL").select(*by, F.lit(-1).alias("_b"), F.col("c").alias("_n")))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b"))  # BUCKETS rows a key
    spans = _joined(totals.withColumn("_upto", upto), asked, by, ["r0", "r1"]).where("_upto > r0 AND _upto - _n <= r1 AND _b >= 0")
    spans = cut(spans.select(*by, "_b", (F.col("_upto") - F.col("_n")).alias("_before")))
    below = spans.groupBy(*by).agg(F.min("_before").alias("c")).select(*by, F.lit(None).cast(found.schema["v"].dataType).alias("v"), "c")
    return _joined(dealt, spans, [*by, "_b"], []).select(*by, "v", "c").unionByName(below)


def _selected(rows: DataFrame, keys: list[str], at: dict[str, float], extra: list[Column]) -> DataFrame:
    """For each key: n, ``extra``, and the interpolated percentiles of ``v`` under their names.

    A sketch brackets each rank, with some thousandths of the rows between. The rows are read once more: those below a bracket are
    counted, those inside are counted by value. Where there are many values inside, they are dealt into ranges, and the range of the rank is
    kept, until a task can put them in order. Only counts are shuffled.
    """
    off, by = 3.0 / ACCURACY, [*keys, "place"]
    marks = [min(1.0, max(0.0, p + d)) for p in at.values() for d in (-off, off)]
    sketch = cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", marks, ACCURACY).alias("_marks"), *extra))
    most = sketch.agg(F.max("n")).first()[0] or 0
    wide = F.col("n") > INSIDE
    places = F.array(*[
        F.struct(F.lit(name).alias("place"), F.when(wide & F.lit(p > off), F.col("_marks")[2 * i]).alias("lo"), F.when(wide & F.lit(p < 1 - off), F.col("_marks")[2 * i + 1]).alias("hi"),
                 F.floor(F.lit(p) * (F.col("n") - 1)).alias("r0"), F.ceil(F.lit(p) * (F.col("n") - 1)).alias("r1"), (F.lit(p) * (F.col("n") - 1)).alias("r"))
        for i, (name, p) in enumerate(at.items())
    ])
    sketch = sketch.withColumn("_places", places).drop("_marks")
    asked = sketch.select(*keys, F.explode("_places").alias("p")).select(*keys, "p.*")
    near = _joined(rows, sketch, keys, ["_places"]).select(*keys, "v", F.explode(F.filter("_places", lambda p: p["hi"].isNull() | (F.col("v") <= p["hi"]))).alias("p"))
    found = near.groupBy(*keys, F.col("p.place").alias("place"), F.when(F.col("p.lo").isNull() | (F.col("v") >= F.col("p.lo")), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    while most > INSIDE:
        found = cut(found)
        most = found.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if most > INSIDE + 1:
            found = _narrowed(found, by, asked)
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(F.col("v").asc_nulls_first()))
    ranked = _joined(found.withColumn("upto", upto), asked, by, ["r0", "r1", "r"])
    holds = lambda r: (F.col("upto") - F.col("c") <= F.col(r)) & (F.col(r) < F.col("upto"))
    value = lambda name, r: F.max(F.when((F.col("place") == name) & holds(r), F.col("v")))
    part = lambda name: F.max(F.when(F.col("place") == name, F.col("r") - F.col("r0")))
    got = ranked.where(holds("r0") | holds("r1")).groupBy(*keys).agg(*[(value(name, "r0") + part(name) * (value(name, "r1") - value(name, "r0"))).alias(name) for name in at])
    return _joined(got, sketch.drop("_places"), keys, [c for c in sketch.columns if c not in (*keys, "_places")])


def percentiles(rows: DataFrame, value: Column, keys: list[str], at: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of each key, a column for each of a few."""
    kept = rows.select(*keys, value.cast("double").alias("v")).where("v IS NOT NULL")
    return _selected(kept, keys, at, []).select(*keys, *at)


def quantiles(rows: DataFrame, value: Column, keys: list[str], points: int) -> DataFrame:
    """Exact quantiles at ``points`` equal steps from 0 to 1, a row each (pos from 0).

    Values are counted first; each distinct value then tells which quantiles' ranks fall on it, so no task sees all values.
    """
    v = _value_counts(rows, value, keys)
    m, last = F.col("n") - 1, points - 1
    lo = F.col("upto") - F.col("c")
    # rank of quantile i: i * m / last, between the whole ranks (i * m) DIV last and the next
    first = F.when(m > 0, F.greatest(F.lit(0), F.floor((lo - 1) * last / F.greatest(m, F.lit(1))))).otherwise(F.lit(0))
    end = F.when(m > 0, F.least(F.lit(last), F.ceil(F.col("upto") * last / F.greatest(m, F.lit(1))))).otherwise(F.lit(last))
    each = v.withColumn("lo", lo).withColumn("pos", F.explode(F.sequence(first.cast("bigint"), end.cast("bigint"))))
    rank, part = F.expr(f"(pos * (n - 1)) DIV {last}"), F.expr(f"(pos * (n - 1)) % {last}")
    holds = lambda r: (F.col("lo") <= r) & (r < F.col("upto"))
    low = F.when(holds(rank), F.col("v"))
    high = F.when(holds(F.when(part > 0, rank + 1).otherwise(rank)), F.col("v"))
    out = each.groupBy(*keys, "pos").agg(F.max(low).alias("a"), F.max(high).alias("b"), F.max(part / F.lit(last)).alias("t"))
    return out.select(*keys, F.col("pos").cast("int").alias("pos"), (F.col("a") + F.col("t") * (F.col("b") - F.col("a"))).alias("q"))


def summary(rows: DataFrame, value: Column, key: str) -> DataFrame:
    """count, min, max, mean, median of ``value`` for each ``key`` and for all rows (key ALL). The rows are worked out once."""
    kept = cut(rows.select(F.col(key).alias("k"), value.alias("v")).where("v IS NOT NULL"))
    levels = kept.select(F.explode(F.array("k", F.lit("ALL"))).alias("k"), "v")
    out = _selected(levels, ["k"], {"median": 0.5}, [F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean")])
    return out.select(F.col("k").alias(key), "n", "least", "most", "mean", "median")


def histogram(rows: DataFrame, latency: Column, width_us: int, top_us: int, keys: list[str]) -> DataFrame:
    """Counts in bins of ``width_us`` from 0 to ``top_us``; the last bin holds its upper edge too."""
    last = top_us // width_us - 1
    b = F.when(F.floor(F.round(latency * 1e6, 3)) == top_us, F.lit(last)).otherwise(bin_of(latency, width_us)).cast("bigint")
    return rows.select(*keys, b.alias("bin")).where(F.col("bin").between(0, last)).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def pmf(rows: DataFrame, latency: Column, width_us: int, top_us: int, keys: list[str], inside: bool = False) -> DataFrame:
    """Shares of the bins: of all rows, or only of those inside the range."""
    counts = histogram(rows, latency, width_us, top_us, keys)
    if inside:
        totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    else:
        totals = rows.where(latency.isNotNull()).groupBy(*keys).agg(F.count("*").alias("total"))
    out = counts.join(totals, keys) if keys else counts.crossJoin(totals)  # a single row of totals
    return out.select(*keys, "bin", ((F.col("bin") + 0.5) * (width_us / 1e6)).alias("center"), "n", (F.col("n") / F.col("total")).alias("p"))


def ecdf(rows: DataFrame, latency: str, keys: list[str], cap: float) -> DataFrame:
    """Each value up to ``cap`` with the share of such values at or below it, from counts of distinct values."""
    counts = _value_counts(rows.where(F.col(latency) <= cap), F.col(latency), keys)
    return counts.select(*keys, F.col("v").alias(latency), (F.col("upto") / F.col("n")).alias("share"))


def length_statistics(rows: DataFrame, size: str, keys: list[str] | None = None) -> DataFrame:
    """count, min, max, mean, median and total of sizes."""
    keys = keys or []
    stats = rows.where(F.col(size).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.avg(size).alias("mean"), F.sum(size).alias("total"))
    median = percentiles(rows, F.col(size), keys, {"median": 0.5})
    return stats.join(median, keys) if keys else stats.crossJoin(F.broadcast(median))  # one row


def auto_bins(rows: DataFrame, value: str) -> DataFrame:
    """Number of bins (bins), first edge (low) and width of a histogram by the greater of Sturges' and Freedman and Diaconis' counts; one row."""
    q = percentiles(rows, F.col(value), [], {"q1": 0.25, "q3": 0.75})
    span = rows.agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    width = F.col("high") - F.col("low")
    sturges = width / (F.log2("n") + 1)
    diaconis = 2 * (F.col("q3") - F.col("q1")) / F.pow("n", F.lit(1 / 3))
    step = F.when(diaconis > 0, F.least(sturges, diaconis)).otherwise(sturges)
    bins = F.when(width > 0, F.ceil(F.round(width / step, 9))).otherwise(F.lit(1)).cast("bigint")
    return span.crossJoin(F.broadcast(q)).select(bins.alias("bins"), "low", F.when(width > 0, width / bins).otherwise(F.lit(1.0)).alias("width"))  # single rows


def accounts(frames: DataFrame, src: str, dst: str, size: Column) -> DataFrame:
    """Packets and bytes of each address as source, destination and in total; a frame to itself counts twice."""
    sides = F.explode(F.array(F.struct(F.col(src).alias("addr"), F.lit(1).alias("s")), F.struct(F.col(dst).alias("addr"), F.lit(0).alias("s")))).alias("e")
    ends = frames.select(sides, size.cast("bigint").alias("b")).select("e.addr", "e.s", "b")
    return ends.groupBy("addr").agg(
        F.count_if(F.col("s") == 1).alias("src_pkts"), F.sum(F.when(F.col("s") == 1, F.col("b")).otherwise(0)).alias("src_bytes"),
        F.count_if(F.col("s") == 0).alias("dst_pkts"), F.sum(F.when(F.col("s") == 0, F.col("b")).otherwise(0)).alias("dst_bytes"),
        F.count("*").alias("total_pkts"), F.sum("b").alias("total_bytes"),
    )


def counted(rows: DataFrame, key: Column, name: str, example: str | None = None, order: str | None = None) -> DataFrame:
    """Count of each key, with the example of the least ``order``."""
    extra = [F.min_by(example, order).alias("example")] if example else []
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"), *extra)


def top(counts: DataFrame, n: int, by: str, ties: str) -> DataFrame:
    return counts.orderBy(F.desc(by), ties).limit(n)


def share(count: Column, total: Column) -> Column:
    """Per cent; 0 where there is nothing."""
    return F.coalesce(F.try_divide(100.0 * count, total), F.lit(0.0))
