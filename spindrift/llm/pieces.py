"""The fixed public vocabulary of word pieces that operators 1 and 4 segment with."""

from __future__ import annotations

import functools
import math


def pieces_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def zipf_scores(path: str) -> tuple[dict[str, float], float]:
    """log10 probability of each piece, and of one byte of a character that no piece covers.

    The file orders pieces by merge rank, not probability; rank r (from 1) gets a share
    proportional to 1 / (r + 2), bytes the share of the last rank.
    """
    p = processor(path)
    ranked = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
    # Single characters stand at the end of the file, but bind nothing; they rank first.
    ranked.sort(key=lambda x: len(x) > 1)
    weights = [1.0 / (r + 3) for r in range(len(ranked))]
    total = math.log10(sum(weights) + 256 * weights[-1])
    return {x: math.log10(w) - total for x, w in zip(ranked, weights)}, math.log10(weights[-1]) - total
