"""Counts over one whole text, shared by the quality operators."""

from __future__ import annotations

import numpy as np

from .common import window_hashes

SPACES = np.array([9, 10, 11, 12, 13, 32])
SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
WINDOW = 8  # words


def words_of(raw: bytes) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D: what bytes.split() gives."""
    return raw.split()


def local_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes that hold within this process."""
    return np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)


def repeat_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that stand in the text twice or more; a word in several such windows counts once."""
    if len(hashes) <= window:
        return 0
    _, inverse, counts = np.unique(window_hashes(hashes, window), return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    edges[: len(again)] += again
    edges[window : window + len(again)] -= again
    return int((np.cumsum(edges) > 0).sum())


def counts_of(text: str | None) -> dict[str, int]:
    """The counts of a text; all zero for a null or empty one."""
    raw = (text or "").encode()
    at = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = words_of(raw)
    hashes = local_hashes(words)
    lines = raw.split(b"\n")
    filled = [x for x in lines if x and not x.isspace()]
    return {
        "n_words": len(words),
        "word_chars": len(raw) - int(at[128:192].sum()) - int(at[SPACES].sum()),
        "n_symbols": int(at[SYMBOLS].sum()),
        "n_dup_lines": len(filled) - len(set(filled)),
        "n_repeat_words": repeat_words(hashes),
        "n_lines": len(filled),
        "n_upper": int(at[65:91].sum()),
        "n_lower": int(at[97:123].sum()),
        "n_digits": int(at[48:58].sum()),
        "n_bangs": int(at[33]),
        "n_pipes": int(at[124]),
        "n_stops": int(at[[46, 33, 63]].sum()),
        "n_commas": int(at[44]),
        "n_distinct": len(set(words)),
        "n_stutters": int((hashes[1:] == hashes[:-1]).sum()),
    }
