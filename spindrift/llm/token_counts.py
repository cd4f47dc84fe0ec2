"""Operator 1: token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a run of characters other than U+0020 and U+0009 to U+000D, with the word mark U+2581
before it. Its segmentation
into pieces of a fixed vocabulary is the one of highest total log10 probability (of equal ones, that
of fewest tokens). The forward score of a prefix does not depend on what follows, so pre-tokens go
into a trie and each node is scored once; the node where a pre-token ends holds its token count. Each
worker keeps its own trie and starts it anew beyond `TRIE_NODES` nodes, so nothing is shuffled and
memory is bounded; counts are the same however texts are dealt.

Null and empty texts have no words and no tokens; an empty table gives an empty result. Repeated rows are
counted each. Characters that no piece covers count one token per
UTF-8 byte. Pre-tokens over `LONGEST` characters are scored in a rolling window instead of the trie.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import held, slices, table
from spindrift.llm.pieces import pieces_path, zipf_scores

TRIE_NODES = 1_000_000
LONGEST = 128
MARK = "▁"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class PrefixTrie(dict):
    """Maps a pre-token to its place in `tokens` and `scores`; unseen ones are inserted."""

    def __init__(self, path: str, most_nodes: int = TRIE_NODES) -> None:
        self.logp, self.byte_logp = zipf_scores(path)
        self.longest = max(map(len, self.logp))
        self.most_nodes = most_nodes
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.children: dict[int, int] = {}
        self.best, self.count = array("d", [0.0]), array("q", [0])
        self.tokens, self.scores = array("q"), array("d")

    def _step(self, text: str, end: int, best, count) -> tuple[float, int]:
        """Best score and token count of text[:end]; best(i) and count(i) give those of text[:i]."""
        width = len(text[end - 1].encode("utf-8", "replace"))
        top = (best(end - 1) + width * self.byte_logp, -(count(end - 1) + width))
        get = self.logp.get
        for start in range(max(0, end - self.longest), end):
            p = get(text[start:end])
            if p is not None:
                found = (best(start) + p, -(count(start) + 1))
                if found > top:
                    top = found
        return top[0], -top[1]

    def _insert(self, text: str) -> tuple[float, int]:
        node, path = 0, [0]
        children, best, count = self.children, self.best, self.count
        for end in range(1, len(text) + 1):
            key = node << 21 | ord(text[end - 1])
            child = children.get(key)
            if child is None:
                score, tokens = self._step(text, end, lambda i: best[path[i]], lambda i: count[path[i]])
                child = children[key] = len(best)
                best.append(score)
                count.append(tokens)
            node = child
            path.append(node)
        return best[node], count[node]

    def _roll(self, text: str) -> tuple[float, int]:
        recent = {0: (0.0, 0)}
        for end in range(1, len(text) + 1):
            recent[end] = self._step(text, end, lambda i: recent[i][0], lambda i: recent[i][1])
            recent.pop(end - self.longest - 1, None)
        return recent[len(text)]

    def __missing__(self, word: str) -> int:
        text = MARK + word
        score, tokens = self._insert(text) if len(text) <= LONGEST else self._roll(text)
        self.tokens.append(tokens)
        self.scores.append(score)
        self[word] = len(self.tokens) - 1
        return self[word]

    def totals(self, text: str | None) -> tuple[int, int, float]:
        """Words, tokens and log10 probability of a text."""
        words = WORD.findall(text or "")
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        tokens, scores = np.frombuffer(self.tokens, np.int64) if self.tokens else np.zeros(0, np.int64), np.frombuffer(self.scores) if self.scores else np.zeros(0)
        result = len(words), int(tokens[at].sum()), float(scores[at].sum())
        del tokens, scores  # the arrays cannot grow while a view of them is alive
        if len(self.best) > self.most_nodes or len(self) > self.most_nodes:
            self.restart()
        return result


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens and log10_score (of the best segmentations) of every document."""
    path = path or pieces_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: PrefixTrie = held(("trie", path), lambda: PrefixTrie(path))
        for batch in batches:
            for part in slices(batch, most=8 << 20):
                rows = [trie.totals(x) for x in part.column("text").to_pylist()]
                words, tokens, scores = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "n_tokens", "log10_score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long, log10_score double")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
