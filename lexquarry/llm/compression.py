"""Classification by the lengths that zstandard gives texts with different dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard as zstd

#: zstandard level where callers name none.
LEVEL = 3


class Compressors:
    """Compressed lengths of byte strings under several dictionaries. Pickled as the dictionaries' bytes."""

    def __init__(self, dictionaries: list[bytes], raw: bool, level: int = LEVEL):
        self.dictionaries, self.raw, self.level = dictionaries, raw, level
        self._made: list[zstd.ZstdCompressor] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def lengths(self, piece: bytes) -> list[int]:
        if self._made is None:
            self._made = []
            for d in self.dictionaries:
                own = zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT if self.raw else zstd.DICT_TYPE_AUTO)
                own.precompute_compress(level=self.level)
                self._made.append(zstd.ZstdCompressor(dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False))
        return [len(c.compress(piece)) for c in self._made]


def windows(text: bytes, size: int) -> Iterator[bytes]:
    """The whole text in consecutive windows of about size bytes, cut after white space where there is some near."""
    at, n = 0, len(text)
    while at < n:
        end = at + size
        if end < n:
            space = text.rfind(b" ", at + size // 2, end)
            end = space + 1 if space >= 0 else end
        yield text[at:end]
        at = end


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    keep = ridge * np.eye(len(w)) * len(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + keep
        step = np.linalg.solve(h, a.T @ (p - y) + keep @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w
