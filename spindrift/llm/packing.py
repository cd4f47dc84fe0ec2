"""Operator 8: pack documents into sequences by shortest-pack-first over the length histogram.

A document's ids, an end id after them, are cut at multiples of the sequence length; each whole
stretch is a sequence, and the remainders are packed. Packing sees only how many pieces there are of
each length: lengths are placed longest first, each time into the pattern that has the least tokens
yet still has room, and a pattern's count falls or rises as pieces join it. The histogram and the
patterns have at most one entry per length and are handled on the driver. A piece then finds its
sequence from its rank among the pieces of its length: its number within its partition, counted as the
pieces are written, plus how many the partitions before have. So no length is sorted or gathered, however
many pieces share it.

A special token of the vocabulary that a text spells out becomes its one id. Null and empty texts hold the end id alone. Rows with one id give pieces of their own, also alike.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import pinned, slices, table
from spindrift.llm.textkernel import occurrence

SEQUENCE = 1024
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, number long"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(documents: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; with_ids adds the ids themselves as bytes. `number` counts the pieces
    of one length in a partition, `part`."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from spindrift.llm.bpe import encoder

        end = np.asarray([end_id], "<u4").tobytes()
        encode = encoder(path).encode
        part_no, seen = TaskContext.get().partitionId(), np.zeros(sequence + 1, np.int64)
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = encode(text or "") + end
                    n = len(ids) // 4
                    for start in range(0, n, sequence):
                        piece = ids[4 * start : 4 * (start + sequence)]
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, piece)[: 5 + with_ids])
                kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
                length = columns[2].to_numpy()
                number = occurrence(np.zeros(len(length), np.int64), length) + seen[length]
                seen += np.bincount(length, minlength=sequence + 1)
                columns[5:5] = [pa.array(np.full(len(length), part_no, np.int64)), pa.array(number)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number", "ids"][: 7 + with_ids])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def pack_histogram(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of offset) and how many sequences have each."""
    by_fill: dict[int, dict[tuple[int, ...], int]] = {0: {}}
    for length in range(sequence, 0, -1):
        left = counts.get(length, 0)
        fills = sorted(f for f in by_fill if f and f + length <= sequence and by_fill[f])
        grown: dict[int, dict[tuple[int, ...], int]] = {}
        for fill in fills:
            for pattern in list(by_fill[fill]):
                if not left:
                    break
                some = min(left, by_fill[fill][pattern])
                left -= some
                if some == by_fill[fill][pattern]:
                    del by_fill[fill][pattern]
                else:
                    by_fill[fill][pattern] -= some
                to = grown.setdefault(fill + length, {})
                to[(*pattern, length)] = to.get((*pattern, length), 0) + some
        # A length may repeat within a pattern: what has just grown takes more of it, else new packs.
        while left:
            again = sorted(f for f in grown if f + length <= sequence and grown[f])
            if not again:
                per = sequence // length
                whole, rest = divmod(left, per)
                for k, n in ((per, whole), (rest, 1 if rest else 0)):
                    if n:
                        to = grown.setdefault(k * length, {})
                        to[(length,) * k] = to.get((length,) * k, 0) + n
                left = 0
                break
            fill = again[0]
            pattern, have = next(iter(grown[fill].items()))
            some = min(left, have)
            left -= some
            grown[fill][pattern] -= some
            if not grown[fill][pattern]:
                del grown[fill][pattern]
            to = grown.setdefault(fill + length, {})
            to[(*pattern, length)] = to.get((*pattern, length), 0) + some
        for fill, patterns in grown.items():
            for pattern, n in patterns.items():
                to = by_fill.setdefault(fill, {})
                to[pattern] = to.get(pattern, 0) + n
    return [(p, n) for f in sorted(by_fill, reverse=True) for p, n in by_fill[f].items() if n]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank of each run of slots, the sequence of that rank, and the offset."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence_id = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            found.setdefault(length, []).append((ranks.get(length, 0), sequence_id, offset))
            ranks[length] = ranks.get(length, 0) + n
            offset += length
        sequence_id += n
    return {k: tuple(np.asarray(x, np.int64) for x in zip(*v)) for k, v in found.items()}


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """`pieces` as `cut_pieces` gives them, without part and number, with sequence_id and offset."""
    numbered = pinned(pieces)
    counts = pinned(numbered.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `sequence` rows
    at = pieces.sparkSession.sparkContext.broadcast(slots(pack_histogram(histogram, sequence)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = numbered.join(counts.select("length", "part", before.alias("before")), ["length", "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = at.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("number").to_numpy() + batch.column("before").to_numpy()
            sequence_id, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                starts, sequences, offsets = runs[int(length[own[0]])]
                run = np.searchsorted(starts, rank[own], side="right") - 1
                sequence_id[own], offset[own] = sequences[run] + rank[own] - starts[run], offsets[run]
            kept = batch.select(names)
            yield kept.append_column("sequence_id", pa.array(sequence_id)).append_column("offset", pa.array(offset))

    names = [x for x in pieces.columns if x not in ("part", "number")]
    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.select(names).dtypes)
    return ranked.select(*names, "number", "before").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(table(spark, sf_dir, "documents"), vocabulary_path()))
