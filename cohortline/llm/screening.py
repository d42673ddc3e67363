"""Screening of singletons: a count-min sketch proves that most hashes occur once, so they need no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortline.llm.common import MULTIPLIER, mix

#: The sketch: rows, and bounds of a row's cells (powers of two). Two bits a cell: 64 MB at the most.
SKETCH_ROWS = 4
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 26
CHUNK = 1 << 16


def cells_for(hashes: int) -> int:
    """Cells of a row of the sketch for so many hashes: two to four for each, within the bounds."""
    return min(max(1 << (2 * hashes).bit_length(), LEAST_CELLS), MOST_CELLS)


def paired(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes as rows of two numbers, the second made of the first."""
    own = hashes.astype(np.int64).view(np.uint64)
    return np.stack([own, mix(own * MULTIPLIER)], axis=1)


def numbers(hashes: pa.Array) -> np.ndarray:
    """Hashes of 16 bytes, or of 64 bits, as rows of two 64-bit numbers."""
    if pa.types.is_integer(hashes.type):
        return paired(hashes.to_numpy(zero_copy_only=False))
    return np.frombuffer(b"".join(hashes.to_pylist()), np.uint64).reshape(-1, 2)


class CountMin:
    """A count-min sketch that counts to two: a bit plane for cells met once, one for those met again."""

    def __init__(self, cells: int, planes: np.ndarray | None = None):
        self.cells = cells
        self.planes = np.zeros((2, SKETCH_ROWS * cells // 64), np.uint64) if planes is None else planes

    def places(self, digests: np.ndarray) -> np.ndarray:
        """A cell in each row of the sketch, for digests as rows of two 64-bit numbers."""
        rows = np.arange(SKETCH_ROWS, dtype=np.uint64)
        hashed = mix(digests[:, :1] + digests[:, 1:] * (rows * np.uint64(2) + np.uint64(1)))
        return (hashed & np.uint64(self.cells - 1)) + rows * np.uint64(self.cells)

    def add(self, digests: np.ndarray) -> None:
        places, counts = np.unique(self.places(digests), return_counts=True)
        words, first = np.unique((places >> np.uint64(6)).astype(np.int64), return_index=True)
        bits = np.uint64(1) << (places & np.uint64(63))
        once = np.bitwise_or.reduceat(bits, first)
        again = np.bitwise_or.reduceat(np.where(counts > 1, bits, np.uint64(0)), first)
        self.planes[1, words] |= again | (self.planes[0, words] & once)
        self.planes[0, words] |= once

    def merge(self, once: np.ndarray, again: np.ndarray) -> None:
        self.planes[1] |= again | (self.planes[0] & once)
        self.planes[0] |= once

    def single(self, digests: np.ndarray) -> np.ndarray:
        """Whether the estimate is one: the estimate is never too small, so these occur exactly once."""
        return ~self._set(1, digests)

    def seen(self, digests: np.ndarray) -> np.ndarray:
        """Whether the estimate is not zero: false only for what does not occur."""
        return self._set(0, digests)

    def _set(self, plane: int, digests: np.ndarray) -> np.ndarray:
        places = self.places(digests)
        bits = self.planes[plane][(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))
        return (bits & np.uint64(1) == 1).all(1)


def sketch(
    rows: DataFrame, cells: int, hashes_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]] = lambda batch: [numbers(batch.column(0))]
) -> CountMin:
    """The sketch of the one column of a frame (as in ``numbers``), or of the hashes found in its rows.

    As many tasks as there are cores fill one of their own each and give the chunks that hold something; chunks
    are merged where they meet. What comes to the driver has the size of a sketch, 64 MB at the most.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CountMin(cells)
        for batch in batches:
            for hashes in hashes_of(batch) if len(batch) else []:
                if len(hashes):
                    own.add(hashes)
        yield from _chunks({i: own.planes[:, at : at + CHUNK] for i, at in enumerate(range(0, own.planes.shape[1], CHUNK))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, CountMin] = {}
        for batch in batches:
            for chunk, once, again in zip(*(c.to_pylist() for c in batch.columns)):
                once, again = np.frombuffer(once, np.uint64), np.frombuffer(again, np.uint64)
                own = held.setdefault(chunk, CountMin(0, np.zeros((2, len(once)), np.uint64)))
                own.merge(once, again)
        yield from _chunks({chunk: own.planes for chunk, own in held.items()})

    kind = "chunk int, once binary, again binary"
    filled = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(fill, kind)
    full = CountMin(cells)
    for r in filled.repartition("chunk").mapInArrow(merge, kind).toLocalIterator():
        at = r["chunk"] * CHUNK
        once, again = np.frombuffer(r["once"], np.uint64), np.frombuffer(r["again"], np.uint64)
        full.planes[:, at : at + len(once)] = once, again
    return full


def _chunks(chunks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for chunk, planes in chunks.items():
        if planes[0].any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in planes)],
                names=["chunk", "once", "again"],
            )
