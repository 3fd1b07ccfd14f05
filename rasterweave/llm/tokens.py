"""Per-worker tables that compute something once for each distinct token and look it up ever after."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable

import numpy as np


class _Ids(dict):
    """Numbers keys in the order in which they first come."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        i = len(self)
        self[key] = i
        self.fresh.append(key)
        return i


class TokenTable:
    """A row of numbers for each distinct token.

    compute(tokens) gives the rows of tokens it has not yet seen, all at once. Between
    texts the table is emptied when it holds more than limit tokens, so memory is bounded
    by limit and the largest text; what it returns does not depend on when that happens.
    """

    def __init__(self, compute: Callable[[list], np.ndarray], limit: int = 120_000):
        self.compute, self.limit = compute, limit
        self._clear()

    def _clear(self) -> None:
        self.ids = _Ids()
        self.rows: np.ndarray | None = None
        self.filled = 0

    def __call__(self, tokens: list) -> np.ndarray:
        """Numbers of the tokens; they index self.rows until the next call."""
        if len(self.ids) > self.limit:
            self._clear()
        out = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        if self.ids.fresh:
            new = self.compute(self.ids.fresh)
            need = self.filled + len(new)
            if self.rows is None:
                self.rows = np.zeros((max(4096, need), *new.shape[1:]), new.dtype)
            elif need > len(self.rows):
                grown = np.zeros((max(need, 2 * len(self.rows)), *new.shape[1:]), new.dtype)
                grown[: self.filled] = self.rows[: self.filled]
                self.rows = grown
            self.rows[self.filled : need] = new
            self.filled = need
            self.ids.fresh = []
        return out

    def done(self) -> None:
        """Empty the table at the end of a task."""
        self._clear()
        release()

    def of(self, tokens: list) -> np.ndarray:
        """The rows of the tokens; there has to be one."""
        ids = self(tokens)
        return self.rows[ids]


#: Rows of an Arrow batch that goes to a Python worker.
BATCH_ROWS = 1000


def bounded_batches(spark) -> None:
    """Lower the session's rows of an Arrow batch to BATCH_ROWS, unless they are fewer.

    Texts can be long: by default a worker and its executor hold 10,000 of them at once. The
    setting is read when a plan runs, so it stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh(frame, name: str) -> str:
    """A column name that frame does not have: name, with underscores before it where needed."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release() -> None:
    """Give freed memory back, so that a worker that is used again does not keep what its last task needed."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def hash64(tokens: Iterable[str], seed: int = 0) -> np.ndarray:
    """64-bit hashes of the UTF-8 bytes of tokens."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(t.encode("utf-8", "surrogatepass"), seed) for t in tokens), np.uint64)
