"""Byte-level BPE ids of whole texts, with the ids of frequent stretches between spaces kept at hand.

The public vocabulary's pre-tokeniser never joins characters across a single space that stands between
two other non-space characters: the space goes to the stretch after it. So " stretch" has the same ids
wherever it stands, and so has a single line feed between non-space characters. A text with any other
white space at such a place (runs, tabs, edges), or with a special token of the vocabulary written out,
is encoded whole instead; such a token becomes its one id, as in `tokenizers`.
"""

from __future__ import annotations

import base64
import json
import os
import struct
from collections.abc import Callable

import numpy as np

from spindrift.llm.common import held

#: Entries kept in a worker before the cache starts anew: a bound on memory, not on what is encoded.
CACHE_ENTRIES = 150_000


class _Held(dict):
    """Ids of each stretch asked for, with `before` in front of it."""

    def __init__(self, ids: Callable[[str], bytes], before: str) -> None:
        self.ids, self.before = ids, before

    def __missing__(self, stretch: str) -> bytes:
        found = self.ids(self.before + stretch)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[stretch] = found
        return found


class Encoder:
    """Ids of the `tokenizers` file `path` as little-endian unsigned 32-bit integers.

    Where the public package also has the vocabulary as ranks, new stretches go through `tiktoken`,
    whose call costs a tenth; the tests hold its ids against those of `tokenizers`.
    """

    def __init__(self, path: str) -> None:
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        self.special = {x["content"]: x["id"] for x in whole.get("added_tokens", ())}
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            bpe = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=self.special)
            self._plain = bpe.encode_ordinary
            self._ids = lambda text: bpe.encode(text, allowed_special="all")
            lengths = {i: len(x) for x, i in merges.items()}
        else:
            from tokenizers import Tokenizer

            tokenizer, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
            plain.encode_special_tokens = True
            self._ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
            self._plain = lambda text: plain.encode(text, add_special_tokens=False).ids
            # A character of a byte-level piece stands for one byte.
            lengths = {i: len(x) for x, i in whole["model"]["vocab"].items()}
        #: Bytes of text that each id stands for.
        self.sizes = np.zeros(max([*lengths, *self.special.values()]) + 1, np.int64)
        self.sizes[list(lengths)] = list(lengths.values())
        self.first, self.later = _Held(self.ids, ""), _Held(self.ids, " ")
        self.feed = self.ids("\n")

    def array(self, text: str) -> np.ndarray:
        """Ids of a text in which special tokens are characters like others."""
        return np.asarray(self._plain(text), np.int64)

    def ids(self, text: str) -> bytes:
        found = self._ids(text)
        return struct.pack(f"<{len(found)}I", *found)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        lines = text.split("\n")
        if len(text.split()) != text.count(" ") + len(lines) or any(x in text for x in self.special):
            return self.ids(text)
        out, later = [], self.later.__getitem__
        for line in lines:
            first, *rest = line.split(" ")
            out.append(self.first[first] + b"".join(map(later, rest)))
        return self.feed.join(out)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return held(("encoder", path), lambda: Encoder(path))
