"""Helpers that the operators share: scratch tables, word buffers and slice hashes."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.session import scratch_path

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once per application.

    Python functions of an operator run on executors that may not have the package installed.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="cohortline-code-")  # on the driver, which serves it to executors
        context.addPyFile(shutil.make_archive(f"{folder}/cohortline", "zip", root, "cohortline"))
        _shipped.add(context.applicationId)


_shipped: set[str] = set()

BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the batches that Python functions of this session get, unless the session has a bound.

    By default only rows are bounded (10,000), so that a batch of texts is a whole task's input, held several
    times over: in the executor's Arrow buffers and in the Python worker.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as it takes to differ from the frame's columns."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def columns_of(df: DataFrame) -> list[Column]:
    """The frame's columns by their exact names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared scratch folder, read back.

    Cuts the lineage: what comes later never recomputes what lies before, and survives the
    loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slabs(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive items whose sizes add up to the limit at most (or one item)."""
    start, total, at = 0, 0, -1
    for at, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, at
            start, total = at, 0
        total += size
    if at >= 0:
        yield start, at + 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class SliceHash:
    """64-bit hashes of any slices of a byte buffer, in constant time each.

    A prefix sum of ``table[byte] * P**position`` (mod 2**64); the difference of two prefixes
    times a power of P's inverse does not depend on where the slice stands.
    """

    _TABLE = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)
    _P = 0x5851F42D4C957F2D
    _powers = _inverses = np.ones(1, dtype=np.uint64)

    @classmethod
    def _grow(cls, size: int) -> None:
        if len(cls._powers) < size:
            size = 1 << (size - 1).bit_length()
            cls._powers = cls._series(cls._P, size)
            cls._inverses = cls._series(pow(cls._P, -1, 1 << 64), size)

    @staticmethod
    def _series(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def __init__(self, data: np.ndarray):
        self._grow(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self._TABLE[data] * self._powers[: len(data)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = (self._sums[ends] - self._sums[starts]) * self._inverses[starts]
        return mix(found + (ends - starts).astype(np.uint64) * MULTIPLIER)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that has single spaces between words."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(data == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
