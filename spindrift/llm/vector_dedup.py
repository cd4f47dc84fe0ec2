"""Operator 5: near-duplicate vectors by a forest of random-projection trees.

Equal vectors of one label are one representative with a multiplicity. Each of `TREES` trees splits
the representatives of a label by random directions, at the median of a sample of at most
`SAMPLE_ROWS` vectors; vectors within `SPILL` of a split go to both sides. The depth follows from the
label's count, and leaves above `LEAF_ROWS` are split again while that saves comparisons (the others,
of near copies, are compared in pairs of chunks). Within a leaf all cosines are computed in double
precision. A pair is counted in the first leaf that its members share and nowhere else, so a leaf
returns a link count and one edge per member, never its pairs; components come from the edges.

Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do
rows with a null label; vectors of different lengths are not compared. Rows with one vec_id get one
row each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import pinned, release, table
from spindrift.llm.components import components
from spindrift.llm.vector_search import matrix, usable

COSINE = 0.98
TREES = 6
SPILL = 0.012
LEAF_ROWS = 768
SAMPLE_ROWS = 4096
FEWEST = 16
RESPLITS = 16
#: A split is no use with more than this share of the sample within SPILL of it; other places for it.
AMID, QUANTILES = 0.5, (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8, 0.1, 0.9)
#: A leaf is split again if that leaves at most this share of its pairs to compare.
WORTHWHILE = 0.6
CODE_BITS = 56


class Tree:
    """Splits of one tree, made when first needed; the same for every worker."""

    def __init__(self, number: int, sample: np.ndarray) -> None:
        self.number, self.sample = number, sample
        self.members = {1: np.arange(len(sample))}
        self.splits: dict[int, tuple[np.ndarray, float, bool]] = {}

    def _members(self, code: int) -> np.ndarray:
        if code not in self.members:
            parent = self._members(code >> 1)
            direction, middle, _ = self.split(code >> 1)
            own = parent[(self.sample[parent] @ direction > middle) == bool(code & 1)]
            self.members[code] = own if len(own) >= FEWEST else parent
        return self.members[code]

    def split(self, code: int) -> tuple[np.ndarray, float, bool]:
        """Direction, threshold, and whether it divides the sample: else nearly all would go to both sides.
        The threshold is the median, or if that is amid near copies the quantile of the fewest around it."""
        if code not in self.splits:
            draw = np.random.default_rng([self.number, code & 0xFFFFFFFF, code >> 32, 77])
            direction = draw.standard_normal(self.sample.shape[1])
            direction /= np.linalg.norm(direction)
            at = self.sample[self._members(code)] @ direction
            middle, around = (float(np.median(at)), lambda x: float((np.abs(at - x) <= SPILL).mean())) if len(at) else (0.0, lambda _: 0.0)
            if around(middle) > AMID:
                middle = min(np.quantile(at, QUANTILES).tolist(), key=around)
            self.splits[code] = direction, middle, around(middle) <= AMID
        return self.splits[code]

    def descend(self, unit: np.ndarray, codes: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaf codes after so many more levels for each row."""
        rows, codes, left = np.arange(len(unit)), codes.copy(), levels.copy()
        done = [(rows[:0], codes[:0])]  # a batch may have no row of this tree
        while len(rows):
            over = left <= 0
            done.append((rows[over], codes[over]))
            rows, codes, left = rows[~over], codes[~over], left[~over]
            sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for code in np.unique(codes):
                own = np.flatnonzero(codes == code)
                direction, middle, divides = self.split(int(code))
                if not divides:
                    done.append((rows[own], codes[own]))
                    continue
                at = unit[rows[own]] @ direction - middle
                for side, go in ((0, at <= SPILL), (1, at > -SPILL)):
                    take = own[go]
                    sides.append((rows[take], np.full(len(take), code * 2 + side), left[take] - 1))
            if not sides:
                break
            rows, codes, left = (np.concatenate(x) for x in zip(*sides))
        return np.concatenate([r for r, _ in done]), np.concatenate([c for _, c in done])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of large components overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n elements' component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _leaves(rows: DataFrame, shared, split_from: str) -> DataFrame:
    """rep, label, width, mult, vec, leaf (tree and code) and the leaf it was for rows with `levels`; `split_from` is "root"
    (all trees) or "leaf"."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests: dict[int, list[Tree]] = {}
        samples = shared.value
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                unit = _unit(matrix(part.column("vec"), int(width)))
                if width not in forests:
                    sample = samples.get(int(width), np.zeros((0, int(width))))
                    forests[width] = [Tree(t, sample) for t in range(TREES)]
                levels = part.column("levels").to_numpy()
                found, was = [], part.column("leaf").to_numpy() if split_from == "leaf" else np.zeros(len(unit), np.int64)
                if split_from == "root":
                    for t, tree in enumerate(forests[width]):
                        r, c = tree.descend(unit, np.ones(len(unit), np.int64), levels)
                        found.append((r, (t << CODE_BITS) | c))
                else:
                    for t, tree in enumerate(forests[width]):
                        own = np.flatnonzero(was >> CODE_BITS == t)
                        r, c = tree.descend(unit[own], was[own] & ((1 << CODE_BITS) - 1), levels[own])
                        found.append((own[r], (t << CODE_BITS) | c))
                at, leaf = (np.concatenate(x) for x in zip(*found))
                yield part.select(["rep", "label", "width", "mult", "vec"]).take(pa.array(at)).append_column("leaf", pa.array(leaf.astype(np.int64))).append_column("was", pa.array(was[at]))

    return rows.mapInArrow(split, "rep long, label long, width int, mult long, vec array<double>, leaf long, was long")


def _met_before(homes: pa.ListArray, leaf: int):
    """Of rows from one number to another, and all rows: whether they share a leaf that comes before `leaf`."""
    flat, owner = homes.flatten().to_numpy(), np.repeat(np.arange(len(homes)), np.diff(homes.offsets.to_numpy()))
    go = flat < leaf
    names, column = np.unique(flat[go], return_inverse=True)
    inside = np.zeros((len(homes), len(names)), np.float32)
    inside[owner[go], column] = 1
    # Leaves that one row alone has are shared with none.
    inside = np.ascontiguousarray(inside[:, inside.sum(axis=0) > 1])
    return lambda a, b: inside[a:b] @ inside.T > 0


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `vectors` (vec_id, embedding, label).

    Labels of at most `leaf_rows` distinct vectors are not split."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    fit = usable(e) & F.exists(e, lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), e.cast("array<double>").alias("vec"), F.coalesce(fit, F.lit(False)).alias("fit"))
    reps = pinned(rows.where("fit").groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).withColumn("width", F.size("vec")))
    if reps.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    samples: dict[int, list] = {}
    for r in reps.orderBy(F.xxhash64("rep", "vec"), "rep").limit(SAMPLE_ROWS).select("width", "vec").collect():
        samples.setdefault(r.width, []).append(r.vec)
    shared = spark.sparkContext.broadcast({w: _unit(np.asarray(v, np.float64)) for w, v in samples.items()})

    keys = ["label", "width"]
    depth = reps.groupBy(*keys).agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / leaf_rows)).cast("int") + 1).alias("levels"))
    depth = depth.withColumn("levels", F.when(F.col("levels") <= 1, 0).otherwise(F.least("levels", F.lit(CODE_BITS - 10))))
    leaves = pinned(_leaves(reps.join(depth, keys), shared, "root"))
    code = F.col("leaf").bitwiseAND((1 << CODE_BITS) - 1)
    whole: list[DataFrame] = []
    for _ in range(RESPLITS):
        big = leaves.groupBy(*keys, "leaf").count().where(F.col("count") > leaf_rows).where(code < (1 << (CODE_BITS - 3)))
        for left in whole:
            big = big.join(left, [*keys, "leaf"], "left_anti")
        big = pinned(big.withColumn("levels", F.lit(2)))
        again = pinned(_leaves(leaves.join(big, [*keys, "leaf"]), shared, "leaf"))
        work = again.groupBy(*keys, "was", "leaf").count().groupBy(*keys, F.col("was").alias("leaf")).agg(F.sum(F.col("count").cast("double") ** 2).alias("work"))
        # Near copies lie within SPILL of any split between them: splits would only multiply them.
        judged = pinned(big.join(work, [*keys, "leaf"]).select(*keys, "leaf", (F.col("work") <= WORTHWHILE * F.col("count").cast("double") ** 2).alias("split")))
        divided, left = judged.where("split").drop("split"), judged.where("not split").drop("split")
        if divided.isEmpty():
            release(big, again, judged)
            break
        children = again.join(divided.withColumnRenamed("leaf", "was"), [*keys, "was"], "left_semi")
        before, leaves = leaves, pinned(leaves.join(divided, [*keys, "leaf"], "left_anti").select(*again.columns).union(children.select(*again.columns)))
        whole.append(left)
        release(before, big, again)

    sizes = leaves.groupBy(*keys, "leaf").agg(F.ceil(F.count("*") / (2 * leaf_rows)).cast("int").alias("chunks"), F.count("*").alias("size")).where("size > 1")
    homes = leaves.groupBy("rep").agg(F.sort_array(F.collect_set("leaf")).alias("homes"))
    placed = leaves.join(sizes, [*keys, "leaf"]).join(homes, "rep").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    # Chunk i meets every chunk j >= i: a member of chunk c goes to all (i, j) that have c in them.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        leaf, width = t.column("leaf")[0].as_py(), t.column("width")[0].as_py()
        unit = _unit(matrix(t.column("vec"), width))
        rep, mult, chunk = (t.column(c).to_numpy() for c in ("rep", "mult", "chunk"))
        before = _met_before(t.column("homes").combine_chunks(), leaf)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        links, ends = np.zeros(len(rep), np.int64), []
        for at in range(0, len(rep), 512):
            near = unit[at : at + 512] @ unit.T >= cosine
            np.fill_diagonal(near[:, at:], False)
            if i != j:
                near &= chunk[at : at + 512, None] != chunk
            a, b = np.nonzero(near)
            ends.append((a[a + at < b] + at, b[a + at < b]))
            links[at : at + 512] = (near & ~before(at, at + 512)) @ mult
        a, b = (np.concatenate(x) for x in zip(*ends))
        root = local_components(len(rep), a, b)
        some = np.zeros(len(rep), bool)
        some[a] = some[b] = True
        return pa.table({"rep": rep[some], "root": rep[root[some]], "links": links[some]})

    found = pinned(placed.groupBy(*keys, "leaf", "i", "j").applyInArrow(compare, "rep long, root long, links long"))
    release(leaves)
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = reps.join(links, "rep", "left").join(joined, reps["rep"] == joined["node"], "left")
    of_rep = of_rep.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # A component's smallest representative is its smallest vector.
    fitting = rows.where("fit").join(of_rep, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fitting.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
