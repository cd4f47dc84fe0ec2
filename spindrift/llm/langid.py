"""Operator 4: language identification by unigrams with the segmentation summed out.

For each language every piece of a fixed public vocabulary has a probability, learned from counts of
pieces over all training texts. A word's probability in a language is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words and the
language's share of training documents. Words are runs of letters, in lower case.

A text that is null or has no letter is `und` with score 0, as is every text when nothing could be
learned. The broadcast model has at most (pieces of the vocabulary) x (languages) numbers. Workers
keep scores of at most `HELD_WORDS` words.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import fold, held, slices, table
from spindrift.llm.pieces import pieces_path, processor

MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
HELD_WORDS = 300_000
FLUSH_WORDS = 300_000
#: Pseudo-count of every piece in every language.
SMOOTHING = 0.05
#: Probability, in any language, of a character that no learned piece covers.
STRANGE = 1e-7
UNKNOWN = "und"


def letter_words(text: str | None) -> list[str]:
    found = LETTERS.findall((text or "").lower())
    return found if all(map(str.isalpha, found)) else [x for x in found if any(map(str.isalpha, x))]


def piece_counts(labelled: DataFrame, path: str) -> DataFrame:
    """lang, piece_id, n over all rows of `labelled`; piece_id -1 counts the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = processor(path)
        size = segment.get_piece_size()
        totals: dict[str, np.ndarray] = {}
        words_of: dict[str, Counter] = {}

        def flush() -> None:
            for lang, words in words_of.items():
                ids = segment.encode(list(words), num_threads=1)
                n = np.fromiter(words.values(), np.int64, len(words))
                flat = np.fromiter((i for x in ids for i in x), np.int64)
                own = totals.setdefault(lang, np.zeros(size + 1, np.int64))
                own[:size] += np.bincount(flat, np.repeat(n, [len(x) for x in ids]), size).astype(np.int64)
            words_of.clear()

        for batch in batches:
            for part in slices(batch, most=2 << 20):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    words_of.setdefault(lang, Counter()).update(letter_words(text))
                    totals.setdefault(lang, np.zeros(size + 1, np.int64))[size] += 1
                if sum(map(len, words_of.values())) > FLUSH_WORDS:
                    flush()
        flush()
        for lang, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == size, -1, at), pa.int64()), pa.array(own[at], pa.int64())], names=["lang", "piece_id", "n"])

    parts = labelled.select("text", "lang").mapInArrow(count, "lang string, piece_id long, n long")
    return parts.groupBy("lang", "piece_id").agg(F.sum("n").alias("n"))


class Languages:
    """Piece probabilities of each language, as numbers per piece in the order of `names`."""

    def __init__(self, counts: list[tuple[str, int, int]], path: str) -> None:
        segment = processor(path)
        self.names = sorted({lang for lang, _, _ in counts})
        at = {x: i for i, x in enumerate(self.names)}
        docs = np.ones(len(self.names))
        table: dict[str, np.ndarray] = {}
        for lang, piece, n in counts:
            if piece < 0:
                docs[at[lang]] += n
            elif not (segment.is_byte(piece) or segment.is_unknown(piece)):
                table.setdefault(segment.id_to_piece(piece), np.zeros(len(self.names)))[at[lang]] += n
        total = sum(table.values(), np.zeros(len(self.names))) + SMOOTHING * max(1, len(table))
        self.pieces = {x: ((n + SMOOTHING) / total).tolist() for x, n in table.items()}
        self.prior = np.log(docs / docs.sum())
        self.key = uuid.uuid4().hex


class Marginal(dict):
    """Maps a word to the row of `table` with its log probability in each language."""

    def __init__(self, model: Languages) -> None:
        self.n = len(model.names)
        self.trie: dict = {}
        for piece, probabilities in model.pieces.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = probabilities
        self.table = np.zeros((1024, self.n))

    def logs(self, word: str) -> np.ndarray:
        text, trie, zero = MARK + word, self.trie, [0.0] * self.n
        end, shift = len(text), 0.0
        ahead: dict[int, list[float]] = {0: [1.0] * self.n}
        for i in range(end):
            here = ahead.pop(i)
            top = max(here)
            if top < 1e-150:
                # A common factor of all states still open: long words stay within range.
                here = [x / top for x in here]
                ahead = {k: [x / top for x in v] for k, v in ahead.items()}
                shift += np.log(top)
            node, j, single = trie, i, False
            while j < end:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                p = node.get("")
                if p is not None:
                    single |= j == i + 1
                    old = ahead.get(j)
                    ahead[j] = [a * b for a, b in zip(here, p)] if old is None else [o + a * b for o, a, b in zip(old, here, p)]
            if not single:
                ahead[i + 1] = [o + a * STRANGE for o, a in zip(ahead.get(i + 1, zero), here)]
        return np.log(np.maximum(ahead[end], 1e-300)) + shift

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[row] = self.logs(word)
        self[word] = row
        return row


def learn(labelled: DataFrame, path: str | None = None) -> Languages:
    """From all rows with a language; the counts that reach the driver are one per language and piece."""
    path = path or pieces_path()
    return Languages([tuple(x) for x in piece_counts(labelled.where(F.col("lang").isNotNull()), path).collect()], path)


def identify(documents: DataFrame, model: Languages, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred and score (the language's posterior probability). Of equally probable
    languages the first by name is given. Only the text goes through Python."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        model = shared.value
        known: Marginal = held(("languages", model.key), lambda: Marginal(model))
        names, scores = [], []
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), most=1 << 20):
            if len(known) > HELD_WORDS:
                known.clear()
            for text in part.column("text").to_pylist():
                words = letter_words(text)
                if not words or not model.names:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                rows = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                logs = known.table[rows].sum(axis=0) + model.prior
                best = int(logs.argmax())
                names.append(model.names[best])
                scores.append(float(1.0 / np.exp(logs - logs[best]).sum()))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    # Marked as if it were not deterministic, so that no filter above evaluates it a second time.
    found = F.arrow_udf(predict, "lang_pred string, score double").asNondeterministic()
    return documents.select(*keep, found(F.col("text")).alias("__found")).select(*keep, "__found.lang_pred", "__found.score")


def held_out(modulus: int = 3, remainder: int = 1) -> Column:
    return fold(modulus) == remainder


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = learn(documents.where(~F.col("held_out")))
    return identify(documents, model, ("doc_id", "held_out"))
