"""Operator 7: near-duplicate documents by BagMinHash signatures and exact multiset overlap.

A document is the multiset of its five-word shingles (words with A to Z lowered; a shorter text is one
shingle of all its words). Its signature has `COMPONENTS` components, each the first of a Poisson
process of points: an element of weight w owns the levels [0, w), cut at powers of two; an interval of
levels sends points at the rate of its length, each with a random component and a random level, and a
point counts if its level is below w. So equal elements of two documents share the points below the
smaller weight, and components agree with the probability of the weighted Jaccard similarity. Points
are drawn in order of time up to a horizon that fills all components with high probability; documents
with a component left empty are drawn again with twice the horizon, so signatures are exact minima.

Texts of one word sequence are one class. Classes that share one of `BANDS` bands of `ROWS` components
are candidates. They are verified on their full shingle multisets in two steps. First every class of a
band is compared with the band's first, which joins most of a group of copies in work that grows with
its size. Bands that still hold classes of several components stay: their connected groups are
compared all with all, in chunks of at most about `CHUNK` classes and `CHUNK_BYTES` of shingles, where every
pair of chunks is one task that computes the overlaps exactly by matrix products. Pairs with weighted
Jaccard of at least 0.8 link, and the components of links are the result.

Null and empty texts, and texts without words, link with nothing. Every row is a document of its own:
rows that repeat an id, or have none, belong to the class of their own text. A class is known by its
smallest doc_id (null if it has none), and one row of it is kept: of that id the first by its text's
hash. A text of any length is one row's work. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import bitmap_filter, frugal, id_bitmap, in_bitmap, numbered_rows, pinned, release, slices, table, utf8
from spindrift.llm.components import components
from spindrift.llm.textkernel import mix, occurrence, words as find_words
from spindrift.llm.vector_dedup import local_components

SHINGLE = 5
#: The similarity as a fraction.
SAME, OF = 4, 5
BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS
CHUNK = 1024
CHUNK_BYTES = 16 << 20
COLUMNS = 2048
#: How many times the mean filling time of the last component a first horizon reaches beyond.
SLACK = 4.0


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every shingle; per row a hash of its word sequence and its number of words."""
    rows, _, _, keys = find_words(data, offsets)
    n_rows = len(offsets) - 1
    n = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(n) - n
    at = np.arange(len(rows)) - first[rows]
    sequence = np.zeros(n_rows, np.uint64)
    np.add.at(sequence, rows, mix(keys ^ mix(at.astype(np.uint64))))
    width = np.minimum(n, SHINGLE)
    heads = np.flatnonzero(at <= (n - width)[rows])
    h = np.zeros(len(heads), np.uint64)
    for j in range(SHINGLE):
        inside = j < width[rows[heads]]
        spot = heads[inside] + j
        h[inside] = h[inside] * np.uint64(0x9E3779B97F4A7C15) + mix(keys[spot] + np.uint64(j))
    return rows[heads], mix(h), sequence, n


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def bag_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n_owners: int, size: int = COMPONENTS) -> np.ndarray:
    """(n_owners, size) ids of the first point of each component; 0 where an owner has no element."""
    out = np.zeros((n_owners, size), np.uint64)
    total = np.bincount(owner, weight, n_owners)
    horizon = np.zeros(n_owners)
    horizon[total > 0] = size * (np.log(size) + SLACK) / total[total > 0]
    pending = total > 0
    while pending.any():
        use = pending[owner]
        o, e, w = owner[use], element[use], weight[use]
        found: list[tuple[np.ndarray, ...]] = []
        low, level = 0, 0
        while len(o):
            # Levels [low, high) of the elements that reach them.
            high = 1 if low == 0 else 2 * low
            rate = float(high - low)
            po, pw = o, w
            seed = mix(e ^ np.uint64(0xB5297A4D + level))
            time, j = np.zeros(len(po)), 0
            while len(po):
                j += 1
                draw = mix(seed + np.uint64(j * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
                time = time - np.log(_uniform(draw)) / rate
                go = time <= horizon[po]
                po, pw, seed, time, draw = po[go], pw[go], seed[go], time[go], draw[go]
                spot = mix(draw ^ np.uint64(0x2545F4914F6CDD1D))
                at = low + (_uniform(mix(spot + np.uint64(1))) * rate).clip(0, rate - 1).astype(np.int64) if rate > 1 else low
                count = pw > at
                found.append((po[count], (spot[count] % np.uint64(size)).astype(np.int64), time[count], draw[count] | np.uint64(1)))
            low, level = high, level + 1
            go = w > low
            o, e, w = o[go], e[go], w[go]
        po, component, time, draw = (np.concatenate(x) for x in zip(*found))
        cell = po * size + component
        order = np.lexsort((draw, time, cell))
        cell, draw = cell[order], draw[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        again = np.flatnonzero(pending)
        out[again] = 0
        out.reshape(-1)[cell[first]] = draw[first]
        pending = pending & (out == 0).any(axis=1)
        horizon *= 2
    return out


def weights(owner: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, element) and how often each occurs."""
    order = np.lexsort((element, owner))
    o, e = owner[order], element[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (e[1:] != e[:-1])
    at = np.flatnonzero(new)
    return o[at], e[at], np.diff(np.append(at, len(o)))


def signatures(documents: DataFrame) -> DataFrame:
    """node, cls (hash of the word sequence), n (words) and bands of `documents` (node, text) with words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(0x51ED27))
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                owner, element, sequence, n = shingles(data, offsets)
                points = bag_minhash(*weights(owner, element), len(n)).reshape(len(n), BANDS, ROWS)
                band = np.zeros((len(n), BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + points[:, :, r])
                band = mix(band ^ salt)
                some = np.flatnonzero(n > 0)
                bounds = np.arange(len(some) + 1, dtype=np.int32) * BANDS
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(some)), pa.array(sequence[some].view(np.int64)), pa.array(n[some]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(band[some].ravel().view(np.int64)))], names=["node", "cls", "n", "bands"])

    return documents.select("node", "text").mapInArrow(frugal(sign), "node long, cls long, n long, bands array<long>")


def _bags(documents: DataFrame, wanted) -> DataFrame:
    """node and bag (packed hashes in order, one for each shingle occurrence) of nodes in a bitmap."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(wanted.value, batch.column("node").to_numpy())))
            for part in slices(batch):
                owner, element, _, n = shingles(*utf8(part.column("text")))
                # The c-th occurrence of a shingle is an element of its own: multisets become sets.
                element = mix(element + occurrence(owner, element).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                edge = np.searchsorted(owner, np.arange(len(n) + 1))
                bags = [np.sort(element[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(bags, pa.binary())], names=["node", "bag"])

    return documents.select("node", "text").mapInArrow(frugal(emit), "node long, bag binary")


def _alike(edges: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs a, b of `edges` whose bags have an overlap / union of at least SAME / OF."""

    def compare(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y):
            both = np.sort(np.concatenate([np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)]))
            common = int((both[1:] == both[:-1]).sum())
            out.append(common * OF >= (len(both) - common) * SAME)
        return pa.array(out, pa.bool_())

    side = lambda x: bags.select(F.col("node").alias(x), F.col("bag").alias(f"bag_{x}"))
    # Bags far apart in size cannot be alike and are not sent to Python.
    n, m = F.length("bag_a"), F.length("bag_b")
    both = edges.join(side("a"), "a").join(side("b"), "b").where((F.least(n, m) * OF >= F.greatest(n, m) * SAME))
    return both.where(F.arrow_udf(compare, "boolean")("bag_a", "bag_b")).select("a", "b")


def linked_pairs(bags: list[np.ndarray], chunk: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of bags with overlap / union of at least SAME / OF; `across`: of two chunks only."""
    k = len(bags)
    size = np.array([len(x) for x in bags], np.int64)
    owner = np.repeat(np.arange(k), size)
    _, column, n = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    shared = n[column] > 1
    owner, column = owner[shared], column[shared]
    number = np.cumsum(n > 1) - 1
    column = number[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    overlap = np.zeros((k, k), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    edge = np.searchsorted(column, np.arange(0, last + COLUMNS, COLUMNS))
    for i in range(len(edge) - 1):
        a, b = edge[i], edge[i + 1]
        m = np.zeros((k, min(COLUMNS, last - i * COLUMNS)), np.float32)
        m[owner[a:b], column[a:b] - i * COLUMNS] = 1
        overlap += m @ m.T
    found = []
    for at in range(0, k, 256):  # overlaps are counts below 2^24, so they are whole in single precision
        common = overlap[at : at + 256].astype(np.int64)
        union = size[at : at + 256, None] + size[None, :] - common
        a, b = np.nonzero(common * OF >= union * SAME)
        found.append((a[a + at < b] + at, b[a + at < b]))
    a, b = (np.concatenate(x) for x in zip(*found))
    if across:
        go = chunk[a] != chunk[b]
        a, b = a[go], b[go]
    return a, b


def _banded_edges(banded: DataFrame) -> DataFrame:
    """a, b: every class of a band of several with the band's first."""
    shared = banded.groupBy("band").agg(F.min("rep").alias("lead"), F.count("*").alias("k")).where("k > 1")
    return banded.join(shared, "band").where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()


def _all_links(edges: DataFrame, bags: DataFrame) -> DataFrame:
    """Links a, b among the classes of each component of `edges`, all compared with all; of links that join
    the same classes only some are given."""
    coarse = pinned(components(edges))
    reps = coarse.join(bags, "node")
    size = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.length("bag")) / CHUNK_BYTES)).cast("int")
    chunks = reps.groupBy("component").agg(size.alias("chunks"))
    placed = reps.join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("component", "node", "bag", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))

    def verify(key: tuple, t: pa.Table) -> pa.Table:
        node, chunk = t.column("node").to_numpy(), t.column("chunk").to_numpy()
        bags = [np.frombuffer(x, np.uint64) for x in t.column("bag").to_pylist()]
        a, b = linked_pairs(bags, chunk, key[1] != key[2]) if len(bags) > 1 else (np.zeros(0, int),) * 2
        root = local_components(len(node), a, b)
        some = root != np.arange(len(node))
        return pa.table({"a": node[some], "b": node[root[some]]})

    return placed.groupBy("component", "i", "j").applyInArrow(verify, "a long, b long")


def linked_classes(documents: DataFrame) -> DataFrame:
    """node and component (the group's smallest node) of every row of `documents` (node, text) with words."""
    context = documents.sparkSession.sparkContext
    signed = pinned(signatures(documents))
    classes = pinned(signed.groupBy("cls", "n").agg(F.min("node").alias("rep"), F.first("bands").alias("bands")))
    banded = classes.select("rep", F.explode("bands").alias("band"))
    edges = pinned(_banded_edges(banded))
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    wanted = context.broadcast(id_bitmap(ends, "node"))
    bags = pinned(_bags(documents, wanted).join(ends, "node"))
    first = pinned(_alike(edges, bags))
    group = pinned(components(first))

    # What bands still hold of several components, compared all with all.
    touched = banded.where(bitmap_filter(wanted, "rep")).join(group, F.col("rep") == F.col("node"), "left")
    labelled = touched.select("rep", "band", F.coalesce("component", "rep").alias("label"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    rest = pinned(_banded_edges(labelled.join(mixed, "band").select("rep", "band")))
    links = pinned(first.union(_all_links(rest, bags)))
    joined = components(links)
    by_class = classes.join(joined, classes["rep"] == joined["node"], "left").select("cls", "n", F.coalesce("component", "rep").alias("component"))
    out = pinned(signed.select("node", "cls", "n").join(by_class, ["cls", "n"]).select("node", "component"))
    release(signed, classes, edges, bags, first, group, rest, links)
    return out


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the group) and kept, one row per row of `documents`."""
    rows = numbered_rows(documents.select("doc_id", "text"))
    groups = linked_classes(rows.select(F.col("__node").alias("node"), "text"))
    ids = rows.select(F.col("doc_id").cast("long"), F.col("__node").alias("node"))
    # Ids of the table are below all others, so a component's smallest node is its smallest id if it has one.
    highest = rows.agg(F.max("doc_id").cast("long").alias("id")).first().id
    out = ids.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    class_id = F.when(F.col("component") <= F.lit(highest).cast("long"), F.col("component"))
    return out.select("doc_id", class_id.alias("class_id"), (F.col("node") == F.col("component")).alias("kept"))


def keep_one(documents: DataFrame) -> DataFrame:
    """`documents` without rows that are near duplicates of another that stays: one of each group does.

    Only texts whose row may be in question (a bitmap of ids) are shuffled, to be joined exactly."""
    names = documents.columns
    rows = numbered_rows(documents)
    groups = linked_classes(rows.select(F.col("__node").alias("node"), "text"))
    gone = pinned(groups.where("node <> component").select(F.col("node").alias("__node")))
    touched = documents.sparkSession.sparkContext.broadcast(id_bitmap(gone, "__node"))
    rest = rows.where(bitmap_filter(touched, "__node")).join(gone, "__node", "left_anti").select(*names)
    return rows.where(~bitmap_filter(touched, "__node")).select(*names).union(rest)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
