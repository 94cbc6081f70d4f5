"""A fixed-length description of a text: byte rates and word, line and repetition shape."""

from __future__ import annotations

import math
from itertools import islice

import numpy as np

#: Byte rates, then the shape numbers below.
N_SHAPE = 14
N_FEATURES = 256 + N_SHAPE

_SYMBOLS = np.frombuffer(b"#*$%&|<>{}[]\\^~_=+@", dtype=np.uint8)
_STOPS = np.frombuffer(b".,;:!?", dtype=np.uint8)


def describe(text: str | None) -> np.ndarray:
    """Features of one whole text; an empty text has only its last feature set."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    data = (text or "").encode()
    words = data.split()
    if not words:
        out[-1] = 1.0
        return out
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n, n_words = len(data), len(words)
    np.log1p(counts * (100.0 / n), out=out[:256], casting="unsafe")
    lower, upper = int(counts[97:123].sum()), int(counts[65:91].sum())
    lines = [line for line in data.split(b"\n") if line.strip()]
    triples = set(zip(words, islice(words, 1, None), islice(words, 2, None), strict=False))
    repeats = sum(map(bytes.__eq__, words, islice(words, 1, None)))
    out[256:] = (
        math.log1p(n_words) / 10,
        n / n_words / 10,
        len(set(words)) / n_words,
        repeats / n_words,
        1 - len(triples) / max(1, n_words - 2) if n_words > 2 else 0.0,
        upper / max(1, upper + lower),
        int(counts[_SYMBOLS].sum()) / n * 10,
        int(counts[_STOPS].sum()) / n_words,
        int(counts[48:58].sum()) / n * 10,
        int(counts[128:].sum()) / n,
        1 - len(set(lines)) / len(lines),
        math.log1p(len(lines)) / 10,
        math.log1p(max(map(len, words))) / 10,
        0.0,
    )
    return out


def describe_all(texts: list[str | None]) -> np.ndarray:
    return np.stack([describe(t) for t in texts]) if texts else np.zeros((0, N_FEATURES), dtype=np.float32)
