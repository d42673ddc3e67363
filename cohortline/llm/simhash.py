"""SimHash near-duplicates by a range join on segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm.common import table, written
from cohortline.llm.components import components
from cohortline.llm.registry import register

SHINGLE_WORDS = 3
SEED = 42
SEGMENTS = 16
DENSE_CELL = 256


def shingles(text: str, words: int) -> list[bytes]:
    """Word shingles of a text in lower case (A-Z), repeats included; all words if there are fewer."""
    found = text.encode().lower().split()
    joined = b" ".join(found)
    ends = [0]
    for word in found:
        ends.append(ends[-1] + len(word) + 1)
    last = max(1, len(found) - words + 1) if found else 0
    return [joined[ends[i] : ends[min(i + words, len(found))] - 1] for i in range(last)]


def simhash(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64 majority bits of the shingles' XXH64; 0 for a text without words (or null)."""
    parts = shingles(text or "", words)
    if not parts:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(parts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def with_fingerprint(
    docs: DataFrame, text: str = "text", name: str = "fingerprint", words: int = SHINGLE_WORDS
) -> DataFrame:
    """Adds the fingerprint of the whole text as a signed long (a null text has 0)."""

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.array([simhash(t, words) for t in texts], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))

    return docs.withColumn(name, fingerprint(F.col(text)))


def _bit_counts(value: Column) -> Column:
    """Bits per segment of four: sixteen counts from 0 to 4, one in each hex digit of a long."""
    lowest = F.lit(0x1111111111111111)
    first, *others = [F.shiftrightunsigned(value, i).bitwiseAND(lowest) for i in range(4)]
    return sum(others, first)


def _cells(counts: Column) -> Column:
    """Grid points at Manhattan distance 0 or 1 from a vector of segment counts.

    A step below 0 or above 4 leads outside the embedding, where no midpoint can lie.
    """
    steps = [F.array(counts)]
    for segment in range(SEGMENTS):
        digit = F.shiftrightunsigned(counts, 4 * segment).bitwiseAND(F.lit(15))
        step = F.shiftleft(F.lit(1).cast("long"), 4 * segment)
        steps += [
            F.when(digit < 4, F.array(counts + step)).otherwise(F.array().cast("array<long>")),
            F.when(digit > 0, F.array(counts - step)).otherwise(F.array().cast("array<long>")),
        ]
    return F.concat(*steps)


def _ball(value: Column) -> Column:
    """A fingerprint and the 64 others that differ from it in one bit."""
    return F.array(value, *[value.bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)])


def near_pairs(prints: DataFrame, dense_cell: int = DENSE_CELL) -> DataFrame:
    """Edges ``a, b`` that connect exactly the distinct ``fp`` (long) within two bits of each other.

    Each fingerprint is embedded as its sixteen segment bit counts. The Manhattan distance of
    two such vectors never exceeds the Hamming distance, so fingerprints within two bits have
    vectors within distance two, and such vectors share a grid point at distance one or less
    from both: an equi-join on these points (33 at most each) finds every candidate, and the
    Hamming distance is verified in the join. Candidates in different cells repeat a pair.

    Fingerprints that meet in a cell of more than ``dense_cell`` would pair up quadratically.
    Their links come from the points themselves instead: two fingerprints are within two bits
    exactly if some 64-bit value is within one bit of both, so linking all fingerprints around
    a value to the smallest of them connects the same groups with 65 rows a fingerprint.
    """
    cells = prints.select("fp", F.explode(_cells(_bit_counts(F.col("fp")))).alias("cell"))
    cells = written(cells, "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes, "cell-sizes")
    sparse = cells.join(sizes.where(F.col("n") <= dense_cell), "cell")
    left = sparse.select("cell", F.col("fp").alias("a"))
    right = sparse.select(F.col("cell").alias("cell_b"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = left.join(right, (F.col("cell") == F.col("cell_b")) & (F.col("a") < F.col("b")) & near)
    pairs = pairs.select("a", "b").distinct()

    dense = cells.join(sizes.where(F.col("n") > dense_cell), "cell", "left_semi").select("fp").distinct()
    around = dense.select("fp", F.explode(_ball(F.col("fp"))).alias("point"))
    least = around.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def near_duplicate_groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS
) -> DataFrame:
    """``id, fingerprint (long), component_id`` per row of the documents.

    Documents whose SimHash fingerprints (of shingles of ``words`` words) differ in two bits or fewer are linked; component_id
    is the smallest id reachable over links. Exact copies, texts without words and null texts
    (fingerprint 0) share a fingerprint and are one node of the graph. A null id stays in the
    result and counts only if no other id is in its group. Repeated rows stay repeated; other
    columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    rows = written(with_fingerprint(rows, words=words).select("id", "fingerprint"), "fingerprints")
    prints = rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("least"))
    groups = components(near_pairs(prints.select("fp")))
    grouped = prints.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "component").select("fp", "component_id")
    return rows.join(named, rows["fingerprint"] == named["fp"]).select("id", "fingerprint", "component_id")


def hex_fingerprint(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


@register()
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicate_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), hex_fingerprint(F.col("fingerprint")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each_group(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest id.

    Where the smallest id repeats, all rows with it stay; rows without an id stay.
    """
    groups = near_duplicate_groups(docs, id_column).where("id <> component_id").select(
        F.col("id").alias(id_column)
    ).distinct()
    return docs.join(groups, id_column, "left_anti")
