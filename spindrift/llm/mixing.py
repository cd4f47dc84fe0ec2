"""Operator 9: mix sources to target weights by entropy balancing, in DataFrame functions only.

Within a source, document i gets a rate r_i in (0, cap): of all rates whose tokens add up to the
source's target, the ones nearest in relative entropy to taking every document once. They have the
form cap / (1 + (cap - 1) exp(-lambda z_i)), an exponential tilt of the odds by the document's share
z_i of tokens, and lambda minimises a convex dual whose gradient is the miss in tokens. Newton's
method solves it for all sources at once: every step is one aggregation over (source, size) cells,
and the state is a table of one row per source, never a driver-side list.

Rates become whole copies by a threshold: copies = floor(r_i + u_i + shift) within [0, ceil(cap)],
with u_i in [0, 1) drawn from the document's id and text. The shift of each source is found by repeated
sixteen-way section on the tokens really taken, so rounding leaves a miss of about one document.

Sources are ranked by sorted ranges, and the level that caps share out is found by rounds of sums over
them, so sources may be as many as documents.

A null text has size 0; a null source is a source of its own, last in order. Rows with one id and text
share their u and so their copies. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import pinned, release, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
NEWTON_STEPS = 8
SECTION_STEPS = 4
SECTIONS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(per: DataFrame) -> DataFrame:
    """`per` (one row a source) with place, from 1, in the order of code points, null last."""
    order = F.col("source").asc_nulls_last()
    ranged = pinned(per.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    within = ranged.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(order)))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    # One row a range: as many as shuffle partitions, whatever the sources.
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return within.join(before, "range").select(*per.columns, (F.col("before") + F.col("place")).cast("long").alias("place"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size and target of each source of `sizes` (source, size).

    Sources in code point order, null last, take the weights in turn. A target stops at `cap` times
    the source's size, and the excess goes to the others by weight until none is above: a source that is
    capped at one level of tokens a weight stays so at the next, which is higher.
    """
    per = ranked_sources(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    per = pinned(per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap))))
    all_ = per.agg((F.sum("source_size") * share).alias("total"), F.sum("weight").alias("weight")).first()
    level, capped = (all_.total / all_.weight if all_.weight else 0.0), 0
    while all_.weight:
        over = F.col("weight") * F.lit(level) > F.col("limit")
        now = per.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("limit"))), F.lit(0.0)).alias("spent"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if now.n == capped or not now.open:
            break
        level, capped = max(0.0, all_.total - now.spent) / now.open, now.n
    return per.select("source", "source_size", F.least(F.col("limit"), F.col("weight") * F.lit(float(level))).alias("target"))


def _rate(lam: Column, z: Column, cap: float) -> Column:
    return F.lit(cap) / (F.lit(1.0) + F.lit(cap - 1.0) * F.exp(-F.greatest(F.least(lam * z, F.lit(500.0)), F.lit(-500.0))))


def _copies(cap: float) -> Column:
    """Whole copies from free, rate, u and shift."""
    moved = F.floor(F.col("rate") + F.col("u") + F.col("shift"))
    return F.when(F.col("free"), F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), moved))).otherwise(F.col("rate"))


def _rated(rows: DataFrame, fitted: DataFrame, cap: float) -> DataFrame:
    """`rows` (source, size, ...) with the columns of their source in `fitted` and the rate."""
    names = [F.col(f"b.{c}") for c in rows.columns]
    per_source = [F.col(f"s.{c}") for c in fitted.columns if c != "source"]
    joined = rows.alias("b").join(fitted.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(*names, *per_source)
    free_rate = _rate(F.col("lam"), F.col("size") / F.col("scale"), cap)
    return joined.withColumn("rate", F.when(F.col("free"), free_rate).when(F.col("target") > 0, F.lit(float(cap))).otherwise(F.lit(0.0)))


def _sized(documents: DataFrame) -> DataFrame:
    u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), 11) * F.lit(2.0**-53)
    return documents.withColumn("size", word_count(F.col("text"))).withColumn("u", u)


def fit(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source of `sized` (source, size, u): source_size, target, scale, lam, free and shift."""
    if not float(cap).is_integer() or cap < 2:
        raise ValueError("cap is a whole number from 2")
    base = pinned(sized.select("source", "size", "u"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    cells = pinned(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    scale = base.groupBy("source").agg(F.greatest(F.avg("size"), F.lit(1.0)).alias("scale"))
    state = source_targets(base.select("source", "size"), weights, share, cap).alias("t").join(scale.alias("s"), same("t", "s")).select("t.*", "s.scale")
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap)
    state = pinned(state.select("*", F.lit(0.0).alias("lam"), free.alias("free")))
    for _ in range(NEWTON_STEPS):
        tilted = cells.alias("c").join(state.alias("s"), same("c", "s")).where("s.free")
        tilted = tilted.select("s.source", "s.lam", "c.n", "c.size", (F.col("c.size") / F.col("s.scale")).alias("z"))
        r = _rate(F.col("lam"), F.col("z"), cap)
        step = tilted.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("got"),
            F.sum(F.col("n") * F.col("size") * F.col("z") * r * (1 - r / cap)).alias("slope"),
        )
        # The dual's curvature falls off far from the solution, so a step moves lambda by 2 at most.
        move = F.greatest(F.least((F.col("s.target") - F.col("g.got")) / F.greatest(F.col("g.slope"), F.lit(1e-9)), F.lit(2.0)), F.lit(-2.0))
        after = state.alias("s").join(step.alias("g"), same("s", "g"), "left")
        after = pinned(after.select("s.source", "s.source_size", "s.target", "s.scale", (F.col("s.lam") + F.coalesce(move, F.lit(0.0))).alias("lam"), "s.free"))
        release(state)
        state = after

    rated = pinned(_rated(base, state, cap).where("free").select("source", "size", "u", "rate", "free"))
    shifts = pinned(state.select("source", "target", F.lit(-1.0).alias("low"), F.lit(2.0).alias("width")))
    for _ in range(SECTION_STEPS):
        tried = rated.alias("r").join(shifts.alias("h"), same("r", "h")).select("r.*", "h.low", "h.width")
        sums = []
        for k in range(SECTIONS):
            moved = F.floor(F.col("rate") + F.col("u") + F.col("low") + F.col("width") * (k / SECTIONS))
            sums.append(F.sum(F.col("size") * F.greatest(F.lit(0), F.least(F.lit(int(cap)), moved))))
        counted = tried.groupBy("source").agg(F.array(*sums).alias("sums"))
        joined = shifts.alias("h").join(counted.alias("c"), same("h", "c"), "left")
        # What is taken rises with the shift: the last section that starts at or below the target.
        part = F.greatest(F.coalesce(F.size(F.filter("c.sums", lambda x: x <= F.col("h.target"))), F.lit(1)) - 1, F.lit(0))
        after = pinned(joined.select("h.source", "h.target", (F.col("h.low") + F.col("h.width") * part / SECTIONS).alias("low"), (F.col("h.width") / SECTIONS).alias("width")))
        release(shifts)
        shifts = after
    return pinned(state.alias("s").join(shifts.alias("h"), same("s", "h")).select("s.*", F.col("h.low").alias("shift")))


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies of each document."""
    sized = pinned(_sized(documents.select("doc_id", "source", "text")).drop("text"))
    rated = _rated(sized, fit(sized, weights, share, cap), cap)
    return rated.select("doc_id", "source", "size", "source_size", "target", "rate", _copies(cap).cast("int").alias("copies"))


def mixed_documents(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """`documents` with each row repeated as often as the mix takes it.

    The texts meet only the per-source table, so they are not shuffled while that table is small.
    """
    names = [F.col(f"d.{c}") for c in documents.columns]
    fitted = fit(_sized(documents.select("doc_id", "source", "text")).drop("text"), weights, share, cap)
    keyed = documents.select(F.struct("*").alias("d"), F.col("doc_id"), F.col("source"), F.col("text"))
    rated = _rated(_sized(keyed).drop("text", "doc_id"), fitted, cap).withColumn("copies", _copies(cap).cast("int"))
    return rated.where("copies > 0").select("d", F.explode(F.expr("sequence(1, copies)")).alias("copy_no")).select(*names)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
