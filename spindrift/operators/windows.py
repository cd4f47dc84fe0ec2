"""Sequence operators of a series.

Operators that look a bounded time to both sides (`halo`) work on time buckets of each series, with the
neighbouring buckets' rows sent along: a series of any length is spread over many tasks. Positional
operators use plain windows, which spill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.params import DEFAULTS, Params


def in_order(by: Sequence[str] = ("entity",)):
    return Window.partitionBy(*by).orderBy("t", "pos")


def positions(rows: DataFrame, by: Sequence[str] = ("entity",)) -> DataFrame:
    """Adds p (from 0) and n (rows of the series)."""
    return rows.withColumn("p", F.row_number().over(in_order(by)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))


def smooth3(rows: DataFrame, column: str, out: str = "smooth") -> DataFrame:
    """Mean of three where a row has both neighbours and its series more than three rows, else the value."""
    w = in_order()
    a, b = F.lag(column).over(w), F.lead(column).over(w)
    n = F.count("*").over(Window.partitionBy("entity"))
    return rows.withColumn(out, F.when((n > 3) & a.isNotNull() & b.isNotNull(), (a + F.col(column) + b) / 3.0).otherwise(F.col(column)))


def moving_average(rows: DataFrame, column: str, radius: int, out: str = "smooth") -> DataFrame:
    """Mean over 2 x radius + 1 positions; positions outside the series repeat its first or last value."""
    if radius <= 0:
        return rows.withColumn(out, F.col(column))
    w, whole = in_order(), in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.col(column)
    for k in range(1, radius + 1):
        total = total + F.coalesce(F.lag(column, k).over(w), F.first(column).over(whole)) + F.coalesce(F.lead(column, k).over(w), F.last(column).over(whole))
    return rows.withColumn(out, total / F.lit(float(2 * radius + 1)))


def peaks_by_rows(rows: DataFrame, column: str, p: Params = DEFAULTS) -> DataFrame:
    """Rows at the maximum of +-peak_radius positions and above at least one neighbour."""
    near = in_order().rowsBetween(-p.peak_radius, p.peak_radius)
    w, v = in_order(), F.col(column)
    out = rows.withColumn("__top", F.max(column).over(near)).withColumn("__a", F.lag(column).over(w)).withColumn("__b", F.lead(column).over(w))
    above = F.coalesce(v > F.col("__a") + 1e-6, F.lit(False)) | F.coalesce(v > F.col("__b") + 1e-6, F.lit(False)) | (F.col("__a").isNull() & F.col("__b").isNull())
    return out.where((v >= F.col("__top") - 1e-6) & above).drop("__top", "__a", "__b")


def halo(rows: DataFrame, width: float, bucket: float) -> DataFrame:
    """Rows by time bucket, repeated in the neighbouring bucket if within `width`; own marks the originals."""
    if bucket < width:
        raise ValueError("a bucket is at least as long as the halo")
    first, last = F.floor((F.col("t") - width) / bucket), F.floor((F.col("t") + width) / bucket)
    out = rows.withColumn("bucket", F.explode(F.sequence(first, last)))
    return out.withColumn("own", F.col("bucket") == F.floor(F.col("t") / bucket))


def range_max(rows: DataFrame, column: str, width: float, out: str, bucket: float | None = None) -> DataFrame:
    """The maximum over rows of the series within `width` seconds."""
    micros = round(width * 1e6)
    near = Window.partitionBy("entity", "bucket").orderBy(F.round(F.col("t") * 1e6).cast("long")).rangeBetween(-micros, micros)
    spread = halo(rows, width, bucket or 16 * width)
    return spread.withColumn(out, F.max(column).over(near)).where("own").drop("bucket", "own")


def peaks_by_time(rows: DataFrame, peak: str, norm: str, width: float, floor: float) -> DataFrame:
    """Rows with no greater score within `width` seconds, and a norm of at least `floor`."""
    return range_max(rows, peak, width, "__top").where((F.col(peak) >= F.col("__top")) & (F.col(norm) >= floor)).drop("__top")


def peaks_with_blur(rows: DataFrame, peak: str, norm: str, blur: str, width: float, floor: float, eps: float, blur_min: float, factor: float, bucket: float | None = None) -> DataFrame:
    """As `peaks_by_time`, but near-equal scores (within eps) yield to a far sharper row.

    x falls to y within the width if y scores higher, unless x is the far sharper of a near tie; or if y
    scores lower in a near tie and is the far sharper. A band self-join on time buckets.
    """
    span = bucket or 4 * width
    x = rows.where(F.col(norm) >= floor).select("entity", "pos", "t", F.col(peak).alias("px"), F.col(blur).alias("bx"))
    x = x.withColumn("bucket", F.floor(F.col("t") / span))
    y = halo(rows, width, span).select(F.col("entity").alias("ey"), F.col("pos").alias("qy"), F.col("t").alias("ty"), F.col(peak).alias("py"), F.col(blur).alias("by"), F.col("bucket").alias("ky"))
    sharper = lambda a, b: (F.col(a) >= blur_min) & (F.col(a) > F.col(b) * factor)
    loses = ((F.col("py") > F.col("px")) & ~((F.col("py") - F.col("px") <= eps) & sharper("bx", "by"))) | ((F.col("py") < F.col("px")) & (F.col("px") - F.col("py") <= eps) & sharper("by", "bx"))
    near = (F.col("entity") == F.col("ey")) & (F.col("bucket") == F.col("ky")) & (F.abs(F.col("ty") - F.col("t")) <= width) & (F.col("pos") != F.col("qy"))
    kept = x.join(y, near & loses, "left_anti").select("entity", "pos")
    return rows.join(kept, ["entity", "pos"])


def lags(rows: DataFrame, columns: Sequence[str], found: Column | None = None) -> DataFrame:
    """Adds prev_<column> of the row before, and, given `found`, seen_<column> of the last row it holds for."""
    w = in_order()
    out = rows
    for x in columns:
        out = out.withColumn(f"prev_{x}", F.lag(x).over(w))
        if found is not None:
            out = out.withColumn(f"seen_{x}", F.last(F.when(found, F.col(x)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return out


def slot_by_position(rows: DataFrame, slots: int) -> DataFrame:
    """Adds slot: `slots` runs of equal count; needs p and n."""
    return rows.withColumn("slot", F.least(F.lit(slots - 1), F.floor(F.col("p") / (F.col("n") / F.lit(float(slots)))).cast("int")))


def top_per(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def best_per_time_slot(rows: DataFrame, score: str, slots: int) -> DataFrame:
    """entity, slot and pos of the best row of each of `slots` equal spans of time, closed at both ends: a
    row on a boundary belongs to both."""
    ends = rows.groupBy("entity").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    width = (F.col("t1") - F.col("t0")) / F.lit(float(slots))
    at = (F.col("t") - F.col("t0")) / width
    low = F.greatest(F.lit(0), F.ceil(at).cast("int") - 1)
    high = F.least(F.lit(slots - 1), F.floor(at).cast("int"))
    spread = rows.join(ends, "entity").where("t1 > t0").withColumn("slot", F.explode(F.sequence(F.least(low, high), high)))
    return spread.groupBy("entity", "slot").agg(F.max_by("pos", F.struct(score, -F.col("pos"))).alias("pos"), F.max(score).alias("score"))


def gaps(rows: DataFrame, anchors: bool = True) -> DataFrame:
    """entity, start, stop, gap between consecutive rows marked `chosen`, and from the series' ends."""
    marked = rows.where("chosen").select("entity", "t", "pos")
    if anchors:
        ends = rows.groupBy("entity").agg(F.min("t").alias("a"), F.max("t").alias("b"))
        marked = marked.union(ends.select("entity", F.col("a").alias("t"), F.lit(-1).cast("long"))).union(ends.select("entity", F.col("b").alias("t"), F.lit(2**62).cast("long")))
    return marked.withColumn("stop", F.lead("t").over(in_order())).where("stop is not null").select("entity", F.col("t").alias("start"), "stop", (F.col("stop") - F.col("t")).alias("gap"))


def upper_median_gap(rows: DataFrame) -> DataFrame:
    """Per entity the element at size div 2 of the sorted gaps between chosen rows (not a mean of two)."""
    g = gaps(rows, anchors=False)
    ranked = g.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy("gap", "start")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("entity")))
    return ranked.where(F.col("k") == F.floor(F.col("n") / 2)).select("entity", F.col("gap").alias("typical"))


def wide_gaps(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """entity, start, stop, gap and typical of the gaps, ends included, that are wide for the series.

    Typical is half a second at least: the upper median gap between chosen rows (the whole span, with one of
    them), and gaps over `gap_multiple` times that count in series that have one of gap_min_sec. With an
    expected count it is the span over the count, and inner gaps count from 1.6 times, ends from 1.4 times it.
    """
    ends = rows.groupBy("entity").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count_if("chosen").alias("chosen_n")).where("chosen_n > 0")
    g = gaps(rows).join(ends, "entity")
    if p.expected > 0:
        g = g.withColumn("typical", F.greatest(F.lit(0.5), (F.col("t1") - F.col("t0")) / F.lit(float(p.expected))))
        outer = (F.col("start") == F.col("t0")) | (F.col("stop") == F.col("t1"))
        found = g.where(F.col("gap") > F.col("typical") * F.when(outer, 1.4).otherwise(1.6))
    else:
        g = g.join(upper_median_gap(rows), "entity", "left").withColumn("typical", F.greatest(F.lit(0.5), F.coalesce("typical", F.col("t1") - F.col("t0"))))
        over = g.where(F.col("gap") > F.col("typical") * p.gap_multiple)
        found = over.join(over.groupBy("entity").agg(F.max("gap").alias("__most")).where(F.col("__most") >= p.gap_min_sec).select("entity"), "entity", "left_semi")
    return found.select("entity", "start", "stop", "gap", "typical")


def centrality(t: Column, start: Column, stop: Column) -> Column:
    half = (stop - start) / 2.0
    return 1.0 - F.abs(t - (start + stop) / 2.0) / F.greatest(half, F.lit(1e-6))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds page: place in time order, from 1."""
    return rows.withColumn("page", F.row_number().over(in_order()))
