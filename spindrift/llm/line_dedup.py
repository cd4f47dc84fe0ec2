"""Operator 6: remove lines that match an earlier line, by an exact set-similarity join.

A line is the set of its words (A to Z lowered). A line of at least `fewest` distinct words (1 unless
given) goes if some earlier line (in order of doc_id, then line number) has a Jaccard similarity of at
least 0.8 with it; lines without words stay. Equal sets are one class, so copies cost nothing more.

Between classes: words are ordered by rarity (by the counts of all distinct lines, in a table of fixed
size), and each class is listed under the words of its prefix, unless no other class has them. A word
that more than about `HOT_LINES` lines have is listed only together with a second such word, of a
prefix longer by one: two lines whose first common word is that frequent share a second one there.
Classes under one word are compared in order of length. Three filters come before any verification,
none of which can lose a pair: length, position of the common word, and the number of differing bits
between parity sketches of the sets, which the symmetric difference cannot be below. Of a class's
remaining earlier partners the nearest by sketch is verified on the full word sets, if it fails some
next ones; a class that had more and none held is searched again among all its partners, so the
result is exact.

Words are known by 52-bit, sets by 64-bit hashes; under one word a class is told apart by its length,
its sketch and 32 bits of its hash. A null text is empty; a null doc_id comes before all
others. Every row is a document of its own: rows with one id, or with none, come in order of their
texts' hashes. The result has the rows of the input. A text of any length is one row's work; columns
beside doc_id and text pass through. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import NO_ID, bitmap_filter, frugal, id_bitmap, in_bitmap, own_rows, pinned, release, slices, table, tidy, utf8
from spindrift.llm.textkernel import mix, span_hashes, word_bounds

FEWEST = 1
#: The similarity as a fraction.
SAME, OF = 4, 5
#: Lines below this many distinct words match none but equal sets.
JOINED = 4
#: Partners that are passed on to verification: few where the nearest is surely one, else more.
NEAREST, IF_NEAR = 64, 16
CELL_BITS, BLOCK_BITS = 24, 18
SALTS = 16
WORD_BITS = 52
WORD = np.uint64((1 << WORD_BITS) - 1)
#: Kinds of postings by number of words: from, to, words of the parity sketch. A pair within the length
#: filter is always in one kind together.
KINDS = ((JOINED, 60, 1), (48, 130, 2), (104, 400, 4), (320, 1 << 31, 16))
SIZES = ("u1", "u1", "<u2", "<u4")
HOT_LINES = 1 << 16
POSTINGS_A_BUCKET = 250_000
FLUSH_BYTES = 12 << 20
RECENT = 1 << 18
#: Lines sorted at once: a line's number within such a block takes twelve bits of a sort key.
SORTED = 1 << 12
#: Pairs of postings compared at once.
COMPARED = 1 << 18


def rank_of(count: np.ndarray | int) -> np.ndarray:
    """0, 1, or a rank that grows with the count, in one byte."""
    return np.where(np.asarray(count) < 2, count, np.minimum(255, 2 + np.log2(np.maximum(count, 2)) * 6)).astype(np.uint8)


def _posting(kind: int) -> np.dtype:
    return np.dtype([("token", "<u4"), ("n", SIZES[kind]), ("at", SIZES[kind]), ("id", "<u8"), ("sketch", "<u8", (KINDS[kind][2],))])


class Lines:
    """The lines with at least `fewest` distinct words of a batch, and their sorted distinct words.

    `line` is the number of the row among those with its key, times 2^32, plus the line's number.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, rows: np.ndarray, fewest: int = 1) -> None:
        starts, ends = word_bounds(data, offsets)
        words = span_hashes(data, starts, ends) >> np.uint64(64 - WORD_BITS)
        bounds = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
        bounds = bounds[bounds < max(1, len(data))]
        first = np.searchsorted(starts, bounds)
        line = np.repeat(np.arange(len(bounds)), np.diff(np.append(first, len(starts))))
        words = _sorted(line, words)
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (words[1:] != words[:-1])
        line, words = line[new], words[new]
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(line)))
        sets = mix(np.add.reduceat(mix(words), first) + n.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
        wide = n >= fewest
        self.words, self.n, self.sets = words[np.repeat(wide, n)], n[wide], sets[wide]
        own = line[first[wide]]
        # A text's first line starts at its offset; empty texts share offsets with the next one.
        row = np.searchsorted(offsets, bounds[own], side="right") - 1
        head = np.searchsorted(bounds, offsets[row], side="left")
        self.doc, self.seq, self.number = docs[row], rows[row], (own - head).astype(np.int64)
        self._start()

    def _start(self) -> None:
        self.first = np.cumsum(self.n) - self.n
        self.owner = np.repeat(np.arange(len(self.n)), self.n)

    @property
    def line(self) -> np.ndarray:
        return (self.seq << 32) + self.number

    def take(self, which: np.ndarray) -> Lines:
        """Only the lines at `which` (a mask)."""
        out = object.__new__(Lines)
        out.words, out.n, out.sets = self.words[np.repeat(which, self.n)], self.n[which], self.sets[which]
        out.doc, out.seq, out.number = self.doc[which], self.seq[which], self.number[which]
        out._start()
        return out

    def distinct(self) -> Lines:
        """The earliest line of each set."""
        order = np.lexsort((self.line, self.doc, self.sets))
        first = np.ones(len(order), bool)
        first[1:] = self.sets[order][1:] != self.sets[order][:-1]
        which = np.zeros(len(order), bool)
        which[order[first]] = True
        return self.take(which)

    def prefix(self, rank: np.ndarray, hot_rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, or hashes of two, of the prefixes that more than one class may have: word, owner, position."""
        key = rank[self.words >> np.uint64(WORD_BITS - CELL_BITS)].astype(np.uint64) << np.uint64(44) | np.arange(len(self.words), dtype=np.uint64)
        key = _sorted(self.owner, key)
        words, ranks = self.words[key & np.uint64((1 << 44) - 1)], key >> np.uint64(44)
        at = np.arange(len(words)) - np.repeat(self.first, self.n)
        length = (self.n - -(-SAME * self.n // OF) + 1)[self.owner]
        single = np.flatnonzero((at < length) & (ranks > 1) & (ranks < hot_rank))
        found = [(words[single], self.owner[single], at[single])]
        hot = np.flatnonzero((at <= length) & (ranks >= hot_rank))
        step = 1
        while step < len(hot):
            a, b = hot[:-step], hot[step:]
            same = self.owner[a] == self.owner[b]
            if not same.any():
                break
            a, b = a[same], b[same]
            # With two common words known, one more may be in common than lie from the second on.
            found.append((mix(words[a] * np.uint64(0x9E3779B97F4A7C15) + words[b]) >> np.uint64(64 - WORD_BITS), self.owner[b], at[b] - 1))
            step += 1
        return tuple(np.concatenate(x) for x in zip(*found))

    def sketches(self, words: int) -> np.ndarray:
        """Parity of how many of a line's words fall on each of 64 x words bits."""
        spot = mix(self.words ^ np.uint64(0x5CE7C4))
        bit = np.uint64(1) << (spot & np.uint64(63))
        out = np.empty((len(self.n), words), np.uint64)
        column = (spot >> np.uint64(6)) % np.uint64(words) if words > 1 else None
        for w in range(words):
            own = bit if column is None else np.where(column == w, bit, np.uint64(0))
            out[:, w] = np.bitwise_xor.reduceat(own, self.first) if len(self.n) else 0
        return out


def _sorted(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """`value` (below 2^52) in order within each group; `group` ascends."""
    key = (group.astype(np.uint64) & np.uint64(SORTED - 1)) << np.uint64(WORD_BITS) | value
    edge = np.searchsorted(group, np.arange(0, (int(group[-1]) if len(group) else 0) + SORTED, SORTED))
    for a, b in zip(edge[:-1], edge[1:]):
        key[a:b].sort()
    key[edge[-1] :].sort()
    return key & WORD


class Recent:
    """Whether a set was met lately, in a document not after the one at hand: a table of fixed size that
    forgets, so a class may pass again, but its first line always does."""

    def __init__(self) -> None:
        self.sets, self.orders = np.zeros(RECENT, np.uint64), np.zeros(RECENT, np.uint64)

    def new(self, sets: np.ndarray, order: np.ndarray) -> np.ndarray:
        place = (sets % np.uint64(RECENT)).astype(np.int64)
        out = (self.sets[place] != sets) | (order < self.orders[place])
        self.sets[place[out]], self.orders[place[out]] = sets[out], order[out]
        return out


def _batches(batches: Iterator[pa.RecordBatch], fewest: int, docs=None):
    for batch in batches:
        if docs is not None:
            batch = batch.filter(pa.array(docs(batch.column("key").to_numpy())))
        for part in slices(batch):
            yield Lines(*utf8(part.column("text")), part.column("key").to_numpy(), part.column("seq").to_numpy(), fewest)


def _survey(documents: DataFrame, fewest: int) -> DataFrame:
    """block null: set, key, line of every line; else counts of distinct lines' words by hash block."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.uint8)  # saturating: ranks are logarithmic
        recent = Recent()
        for lines in _batches(batches, fewest):
            k = len(lines.n)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.array(lines.sets.view(np.int64)), pa.array(lines.doc), pa.array(lines.line), pa.nulls(k, pa.binary())], names=["block", "set", "key", "line", "counts"])
            own = lines.take(lines.n >= JOINED).distinct()
            cells = np.sort((own.words[np.repeat(recent.new(own.sets, np.zeros(len(own.sets), np.uint64)), own.n)] >> np.uint64(WORD_BITS - CELL_BITS)).astype(np.uint32))
            edge = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
            at = cells[edge]
            counts[at] = np.minimum(255, counts[at] + np.diff(np.append(edge, len(cells))))
        some = [(i, _packed(x)) for i, x in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)) if x.any()]
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), none, none, none, pa.array([x for _, x in some], pa.binary())], names=["block", "set", "key", "line", "counts"])

    return documents.mapInArrow(frugal(survey), "block int, set long, key long, line long, counts binary")


def _packed(counts: np.ndarray) -> bytes:
    """Counts below 256 of a block: as they are, or the places and values of few that are not 0."""
    some = np.flatnonzero(counts)
    if 5 * len(some) >= len(counts):
        return counts.tobytes()
    return some.astype("<u4").tobytes() + counts[some].tobytes()


def _add(total: np.ndarray, packed: bytes) -> None:
    if len(packed) == len(total):
        total += np.frombuffer(packed, np.uint8)
    else:
        k = len(packed) // 5
        total[np.frombuffer(packed, "<u4", k)] += np.frombuffer(packed, np.uint8, k, 4 * k)


def _word_ranks(survey: DataFrame) -> np.ndarray:
    """By the top CELL_BITS bits of a word's hash: `rank_of` its count (16 MB).

    Tables of counts are added by block in two steps, so no task meets those of all tasks at once."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for x in t.column("counts").to_pylist():
            _add(total, x)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.astype("<u4").tobytes(), 1)], pa.binary())})

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), "<u4")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([rank_of(total).tobytes()], pa.binary())})

    parts = survey.where("block is not null").select("block", "counts", (F.spark_partition_id() % SALTS).alias("salt"))
    found = parts.groupBy("block", "salt").applyInArrow(add, "block int, counts binary").groupBy("block").applyInArrow(merge, "block int, counts binary")
    out = np.zeros((1 << (CELL_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for r in found.collect():
        out[r.block] = np.frombuffer(r.counts, np.uint8)
    return out.ravel()


class Order:
    """32-bit codes of documents that never fall from one to a later one; equal codes may belong to either order."""

    def __init__(self, low: int, high: int) -> None:
        self.low, self.shift = low, max(0, (high - low + 1).bit_length() - 31)

    def doc(self, key: np.ndarray) -> np.ndarray:
        code = (key.view(np.uint64) - np.uint64(self.low & (2**64 - 1)) >> np.uint64(self.shift)) + np.uint64(1)
        return np.where(key == NO_ID, np.uint64(0), code)

    def id(self, lines: Lines) -> np.ndarray:
        """The code of its document, and 32 bits of the set's hash: what a posting names a class by."""
        return self.doc(lines.doc) << np.uint64(32) | lines.sets & np.uint64(0xFFFFFFFF)


def _postings(documents: DataFrame, shared, buckets: int, fewest: int, wanted=None) -> DataFrame:
    """bucket and kind with packed postings; `wanted`, if given, is a bitmap of the words to list under."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hot_rank, order = shared.value
        bitmap = wanted.value if wanted is not None else None
        recent = Recent()
        lists: list[list[np.ndarray]] = [[] for _ in KINDS]
        places: list[list[np.ndarray]] = [[] for _ in KINDS]

        def rows() -> Iterator[pa.RecordBatch]:
            for kind in range(len(KINDS)):
                if lists[kind]:
                    bucket = np.concatenate(places[kind])
                    by = np.argsort(bucket, kind="stable")
                    bucket, p = bucket[by], np.concatenate(lists[kind])[by]
                    lists[kind].clear()
                    places[kind].clear()
                    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                    ends = np.append(edge, len(p)).astype(np.int32) * p.itemsize
                    packed = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(p.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array(np.full(len(edge), kind, np.int32)), packed], names=["bucket", "kind", "postings"])

        size = 0
        for every in _batches(batches, fewest):
            every = every.take(every.n >= JOINED).distinct()
            every = every.take(recent.new(every.sets, order.doc(every.doc)))
            for kind, (least, most, width) in enumerate(KINDS):
                lines = every.take((every.n >= least) & (every.n <= most))
                word, owner, at = lines.prefix(rank, hot_rank)
                if bitmap is not None:
                    go = in_bitmap(bitmap, word)
                    word, owner, at = word[go], owner[go], at[go]
                if not len(word):
                    continue
                p = np.empty(len(word), _posting(kind))
                p["token"], p["n"], p["at"] = word & np.uint64(0xFFFFFFFF), lines.n[owner], at
                p["id"], p["sketch"] = order.id(lines)[owner], lines.sketches(width)[owner]
                lists[kind].append(p)
                # The bits above the token's: bucket and token together tell words apart as well as their hash.
                places[kind].append((mix(word >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32))
                size += p.nbytes
            if size > FLUSH_BYTES:
                yield from rows()
                size = 0
        yield from rows()

    return documents.mapInArrow(frugal(post), "bucket int, kind int, postings binary")


PAIRS = "later long, earlier long, far int, more boolean, sure boolean"


def nearest_earlier(p: np.ndarray, nearest: tuple[int, int] | None, later_in: np.ndarray | None) -> list[np.ndarray]:
    """The columns PAIRS of sets and an earlier partner that passes all filters. `more`: the set has others
    still; not `sure`: both are of one document code, and the reverse is given, too. `nearest`: how many
    partners a set gets where the nearest is near, and else; None gives all. `later_in` limits the later sets to a bitmap."""
    # One posting for each word and class: the earliest line's.
    same = mix(p["id"] << np.uint64(32) | p["token"].astype(np.uint64)) ^ mix(p["sketch"][:, 0] + p["n"])
    by = np.argsort(same)
    if (same[by][1:] == same[by][:-1]).any():
        by = np.lexsort((p["id"], same))
        same = same[by]
        p = p[by[np.append(True, same[1:] != same[:-1])]]
    p = p[np.argsort(p["token"].astype(np.uint64) << np.uint64(32) | p["n"].astype(np.uint64))]
    token, sketch, ids = (np.ascontiguousarray(p[x]) for x in ("token", "sketch", "id"))
    order = ids >> np.uint64(32)
    n, at = p["n"].astype(np.int64), p["at"].astype(np.int64)
    found: list[list[np.ndarray]] = []
    kept, bound = 0, 400_000

    def reduce(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
        rows = [np.concatenate(x) for x in zip(*rows)]
        by = np.lexsort((rows[1], rows[2], rows[0]))
        later, earlier = rows[0][by], rows[1][by]
        rows = [x[by[np.append(True, (later[1:] != later[:-1]) | (earlier[1:] != earlier[:-1]))]] for x in rows]
        if nearest is None or not len(rows[0]):
            return rows
        later, near, more = rows[0], rows[5], rows[3]
        first = np.flatnonzero(np.append(True, later[1:] != later[:-1]))
        count = np.diff(np.append(first, len(later)))
        most = np.where(near[first], *nearest)
        place = np.arange(len(later)) - np.repeat(first, count)
        rows[3] = np.repeat(np.logical_or.reduceat(more, first) | (count > most), count)
        go = place < np.repeat(most, count)
        return [x[go] for x in rows]

    # Of two classes in order of length, the words of the shorter one from the common word on bound the other's
    # length: with `least` words in common, SAME * (its n + the other's) <= (SAME + OF) * those words.
    own = n - at
    longest = np.minimum(OF * n // SAME, (SAME + OF) * own // SAME - n)
    listed = token.astype(np.int64) << 31
    ends = np.searchsorted(listed | n, listed | np.maximum(longest, 0), side="right")
    left = np.flatnonzero(ends > np.arange(len(p)) + 1)
    count = ends[left] - left - 1
    # The most bits that sketches of a pair within the bounds can differ by.
    limit = ((n + longest) * (OF - SAME) // (SAME + OF)).astype(np.int32)
    total = np.cumsum(count)
    start = 0
    while start < len(left):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + COMPARED, side="right")))
        some, k = left[start:stop], count[start:stop]
        right = np.arange(total[stop - 1] - before) + np.repeat(some + 1 - (total[start:stop] - k - before), k)
        far = np.bitwise_count(np.repeat(sketch[some, 0], k) ^ sketch[right, 0]).astype(np.int32 if sketch.shape[1] > 1 else np.uint8)
        for w in range(1, sketch.shape[1]):
            far += np.bitwise_count(np.repeat(sketch[some, w], k) ^ sketch[right, w])
        go = np.flatnonzero(far <= np.repeat(limit[some], k))
        a, b, far = np.repeat(some, k)[go], right[go], far[go].astype(np.int32)
        start = stop
        both = n[a] + n[b]
        least = -(-SAME * both // (SAME + OF))  # of common words
        most = both - 2 * least
        ok = (np.minimum(own[a], own[b]) >= least) & (far <= most)
        a, b, far, most = a[ok], b[ok], far[ok], most[ok]
        if len(a):
            swap = order[a] > order[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            sure = order[a] < order[b]
            u = np.flatnonzero(~sure)
            earlier, later = np.concatenate([a, b[u]]), np.concatenate([b, a[u]])
            far, most, sure = (np.concatenate([x, x[u]]) for x in (far, most, sure))
            if later_in is not None:
                go = in_bitmap(later_in, ids[later])
                earlier, later, far, most, sure = (x[go] for x in (earlier, later, far, most, sure))
            if len(far):
                found.append([ids[later], ids[earlier], far, np.zeros(len(far), bool), sure, sure & (4 * far <= most)])
            kept += len(far)
            if nearest is not None and kept > bound:
                found = [reduce(found)]
                kept = len(found[0][0])
                bound = max(bound, 2 * kept)
    if not found:
        return [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int32, bool, bool)]
    return reduce(found)[:5]


def _candidates(postings: DataFrame, nearest: tuple[int, int] | None, later_in=None) -> DataFrame:
    """PAIRS: distinct pairs of sets to verify."""

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        kind = key[1].as_py()
        p = np.concatenate([utf8(x)[0] for x in t.column("postings").chunks]).view(_posting(kind))
        later, earlier, far, more, sure = nearest_earlier(p, nearest, later_in.value if later_in is not None else None)
        return pa.table({"later": later.view(np.int64), "earlier": earlier.view(np.int64), "far": far, "more": more, "sure": sure})

    found = postings.groupBy("bucket", "kind").applyInArrow(compare, PAIRS)
    return found.groupBy("later", "earlier").agg(F.min("far").alias("far"), F.bool_or("more").alias("more"), F.bool_or("sure").alias("sure"))


def _word_sets(documents: DataFrame, pairs: DataFrame, order: Order, fewest: int) -> DataFrame:
    """id, set and words (array of hashes) of the classes in `pairs`; only documents that posted one are read."""
    context = documents.sparkSession.sparkContext
    ends = pairs.select(F.col("later").alias("id")).union(pairs.select(F.col("earlier").alias("id")))
    shared = context.broadcast((id_bitmap(ends, "id"), id_bitmap(ends.select(F.shiftrightunsigned("id", 32).alias("doc")), "doc"), order))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, docs, order = shared.value
        recent = Recent()
        for lines in _batches(batches, fewest, lambda key: in_bitmap(docs, order.doc(key))):
            lines = lines.take(lines.n >= JOINED)
            lines = lines.take(in_bitmap(ids, order.id(lines))).distinct()
            lines = lines.take(recent.new(lines.sets ^ order.id(lines), np.zeros(len(lines.sets), np.uint64)))
            bounds = np.append(0, np.cumsum(lines.n)).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(bounds), pa.array(lines.words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(order.id(lines).view(np.int64)), pa.array(lines.sets.view(np.int64)), words], names=["id", "set", "words"])

    return pinned(documents.mapInArrow(frugal(emit), "id long, set long, words array<long>").groupBy("id", "set").agg(F.first("words").alias("words")))


def _matched(sets: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """later and set of each later class of `pairs` that an earlier one matches, by their full word sets."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"{x}_set"), F.col("words").alias(f"{x}_words"))
    both = pairs.select("later", "earlier", "sure").join(side("later"), "later").join(side("earlier"), "earlier").where("later_set <> earlier_set")
    common = F.size(F.array_intersect("later_words", "earlier_words"))
    same = both.where(common * OF >= (F.size("later_words") + F.size("earlier_words") - common) * SAME)
    same = pinned(same.select("later", "later_set", "earlier_set", "sure"))
    # Which of two is the later one may only be told by the classes.
    unsure = same.where("not sure")
    few = pinned(unsure.select(F.col("later_set").alias("set")).union(unsure.select("earlier_set")).distinct().join(classes, "set").select("set", "first"))
    first = lambda x: few.select(F.col("set").alias(f"{x}_set"), F.col("first").alias(f"{x}_first"))
    known = unsure.join(first("later"), "later_set").join(first("earlier"), "earlier_set").where("earlier_first < later_first")
    out = pinned(same.where("sure").select("later", "later_set").union(known.select("later", "later_set")).distinct().withColumnRenamed("later_set", "set"))
    release(same, few)
    return out


def _matches(documents: DataFrame, survey: DataFrame, classes: DataFrame, fewest: int) -> DataFrame:
    """set of every class that an earlier class matches."""
    spark = documents.sparkSession
    context = spark.sparkContext
    ends = classes.where(F.col("first.key") != NO_ID).agg(F.min("first.key").alias("low"), F.max("first.key").alias("high")).first()
    order = Order(ends.low or 0, ends.high or 0)
    shared = context.broadcast((_word_ranks(survey), int(rank_of(HOT_LINES)), order))
    buckets = max(8, min(1 << 20, -(-classes.count() * 8 // POSTINGS_A_BUCKET)))

    found = _candidates(_postings(documents, shared, buckets, fewest), (IF_NEAR, NEAREST))
    pairs = pinned(found.withColumn("place", F.row_number().over(Window.partitionBy("later").orderBy("far", "earlier"))))
    tidy(spark)
    sets = _word_sets(documents, pairs, order, fewest)
    matched = _matched(sets, pairs.where("place = 1"), classes)
    rest = pairs.where("place > 1").join(matched.select("later"), "later", "left_anti")
    matched = matched.union(_matched(sets, rest, classes))
    open_sets = pinned(pairs.where("more").select("later").distinct().join(matched.select("later"), "later", "left_anti"))
    if not open_sets.isEmpty():
        open_bitmap = context.broadcast(id_bitmap(open_sets, "later"))
        again = _postings(documents, shared, buckets, fewest, context.broadcast(_prefix_words(sets, open_bitmap, shared)))
        again = pinned(_candidates(again, None, open_bitmap))
        matched = matched.union(_matched(_word_sets(documents, again, order, fewest), again, classes))
    out = pinned(matched.select("set").distinct())
    release(pairs, sets, open_sets)
    return out


def _prefix_words(sets: DataFrame, open_bitmap, shared) -> np.ndarray:
    """A bitmap of the words that the classes in `open_bitmap` are listed under."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hot_rank = shared.value[:2]
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(open_bitmap.value, batch.column("id").to_numpy())))
            own = object.__new__(Lines)
            own.n = np.diff(batch.column("words").offsets.to_numpy()).astype(np.int64)
            own.words = batch.column("words").flatten().to_numpy().view(np.uint64)
            own._start()
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(own.prefix(rank, hot_rank)[0]).view(np.int64))], names=["word"])

    return id_bitmap(sets.mapInArrow(frugal(prefixes), "word long"), "word")


def removed_lines(documents: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """key, seq and line, from 0, of every line of `documents` (key and seq as in `own_rows`, text) that goes."""
    survey = pinned(_survey(documents, fewest))
    lines = survey.where("block is null").select("set", "key", "line")
    classes = pinned(lines.groupBy("set").agg(F.min(F.struct("key", "line")).alias("first"), F.count("*").alias("n")))
    matched = _matches(documents, survey, classes, fewest)
    tidy(documents.sparkSession)
    # A class goes whole if it matches an earlier one, else all but its first line.
    judged = classes.join(matched.withColumn("matched", F.lit(True)), "set", "left")
    some = pinned(judged.where("n > 1 or matched").select("set", "first", F.coalesce("matched", F.lit(False)).alias("matched")))
    touched = documents.sparkSession.sparkContext.broadcast(id_bitmap(some, "set"))
    gone = lines.where(bitmap_filter(touched, "set")).join(some, "set").where("matched or struct(key, line) <> first")
    out = pinned(gone.select("key", F.shiftright("line", 32).alias("seq"), F.col("line").bitwiseAND(0xFFFFFFFF).alias("line")))
    release(survey, classes, matched, some)
    return out


def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Each text without the lines whose numbers are given."""
    out = []
    for own, numbers in zip(text.to_pylist(), gone.to_pylist()):
        if own and numbers:
            left = np.ones(own.count("\n") + 1, bool)
            left[numbers] = False
            own = "\n".join([x for x, stays in zip(own.split("\n"), left.tolist()) if stays])
        out.append(own)
    return pa.array(out, pa.string())


def dedup_lines(documents: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """The rows of `documents` (doc_id, text and any others) without removed lines in the text, with
    n_lines and n_removed. A line's end goes with it."""
    spark = documents.sparkSession
    names = documents.columns
    rows = own_rows(documents)
    removed = removed_lines(rows.select(F.col("__key").alias("key"), F.col("__seq").alias("seq"), "text"), fewest)
    gone = pinned(removed.groupBy(F.col("key").alias("__key"), F.col("seq").alias("__seq")).agg(F.collect_list("line").alias("__gone")))
    release(removed)
    tidy(spark)
    touched = spark.sparkContext.broadcast(id_bitmap(gone, "__key"))

    n_lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    as_is = rows.where(~bitmap_filter(touched, "__key")).select(*names, n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    # A merge join at every size: what is removed grows with the table.
    joined = rows.where(bitmap_filter(touched, "__key")).join(gone.hint("merge"), ["__key", "__seq"], "left")
    # Marked as if it were not deterministic, so that no filter above evaluates it a second time.
    without = F.arrow_udf(_without, "string").asNondeterministic()
    kept = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(without("text", "__gone"))
    n_removed = F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    changed = joined.select(*[kept.alias("text") if c == "text" else F.col(c) for c in names], n_lines.alias("n_lines"), n_removed.alias("n_removed"))
    return as_is.union(changed)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.crc32("text").alias("text_crc32"))
