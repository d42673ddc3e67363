"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortline.llm.common import MULTIPLIER, mix, slabs, table, written
from cohortline.llm.registry import register

LEVELS = 4
#: Phrases of these levels (about 10, 35 and 110 characters long) make the fingerprint.
SIGNED_LEVELS = (2, 3, 4)
BINS = 64
SLAB = 1 << 19
EMPTY = 0xFFFF


def _coin(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One round of deterministic coin tossing.

    A symbol that differs from its left neighbour becomes the place of the lowest bit in which
    they differ, doubled, plus its own bit there; results of neighbours differ again. The
    first symbol of a text is compared with its complement.
    """
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[starts] = ~symbols[starts]
    apart = symbols ^ left
    lowest = apart & (~apart + symbols.dtype.type(1))
    place = np.bitwise_count(lowest - symbols.dtype.type(1)).astype(np.uint8)
    return place << np.uint8(1) | ((symbols & lowest) != 0).astype(np.uint8)


def _phrases(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names and their texts' numbers: one level of the parse of many texts at once.

    Runs of a symbol become one symbol; three coin tosses leave labels below 6 that depend on
    four symbols only; a phrase starts at each local minimum of the labels, but not at a text's
    last symbol, so its borders depend on nearby symbols alone, wherever the text stands. A name hashes the phrase.
    """
    first = np.ones(len(symbols), bool)
    first[1:] = (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    lengths = np.diff(at, append=len(symbols)).astype(np.uint64)
    owner = owner[at]
    symbols = np.where(lengths > 1, mix(symbols[at] + lengths * MULTIPLIER), symbols[at])
    opening = np.ones(len(symbols), bool)
    opening[1:] = owner[1:] != owner[:-1]
    starts = np.flatnonzero(opening)
    label = _coin(_coin(_coin(symbols, starts), starts), starts)
    border = opening.copy()
    border[1:-1] |= (label[1:-1] < label[:-2]) & (label[1:-1] <= label[2:]) & ~opening[2:]
    begin = np.flatnonzero(border)
    size = np.diff(begin, append=len(symbols))
    inside = np.arange(len(symbols)) - np.repeat(begin, size)
    keyed = mix(symbols + (inside.astype(np.uint64) + np.uint64(1)) * MULTIPLIER)
    names = mix(np.add.reduceat(keyed, begin) ^ (size.astype(np.uint64) * MULTIPLIER))
    return names, owner[begin]


def fingerprints(texts: list[str]) -> list[bytes]:
    """Sketches of texts: per bin, the least hash of the phrase names that fall into it, 16 bits each.

    Names of the signed levels and of the whole text are hashed into ``BINS`` bins, so shared
    substrings leave shared minima, and the share of equal bins estimates how much of two
    texts' phrases is common. An empty text has empty bins only.
    """
    out: list[bytes] = []
    for low, high in slabs(map(len, texts), SLAB):
        part = texts[low:high]
        sizes = np.array([len(text) for text in part], np.int64)
        symbols = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        bins = np.full(len(part) * BINS, EMPTY, np.uint16)
        if len(symbols):
            owner = np.repeat(np.arange(len(part)), sizes)
            whole = np.add.reduceat(
                mix(symbols + (np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64) * MULTIPLIER),
                (np.cumsum(sizes) - sizes)[sizes > 0],
            )
            _sign(bins, mix(whole), np.flatnonzero(sizes))
            symbols = mix(symbols * MULTIPLIER)
            for level in range(1, LEVELS + 1):
                symbols, owner = _phrases(symbols, owner)
                if level in SIGNED_LEVELS:
                    _sign(bins, symbols ^ np.uint64(level), owner)
        out += [row.tobytes() for row in bins.reshape(-1, BINS)]
    return out


def _sign(bins: np.ndarray, names: np.ndarray, owner: np.ndarray) -> None:
    spread = mix(names + MULTIPLIER)
    place = owner * BINS + (spread >> np.uint64(58)).astype(np.int64)
    value = np.minimum((spread & np.uint64(0xFFFF)).astype(np.uint16), EMPTY - 1)
    np.minimum.at(bins, place, value.astype(np.uint16))


def likeness(one: bytes, other: bytes) -> float:
    """Share of equal bins among those that either text fills; 1 for equal, so for two empty, sketches."""
    return float(_likenesses([one], [other])[0])


def _likenesses(one: list[bytes], other: list[bytes]) -> np.ndarray:
    a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, BINS) for x in (one, other))
    filled = (a != EMPTY) | (b != EMPTY)
    size = filled.sum(1)
    return np.where(size > 0, ((a == b) & filled).sum(1) / np.maximum(size, 1), 1.0)


COMPARED = pa.schema(
    [
        ("kind", pa.string()),
        ("part", pa.int32()),
        ("id", pa.int64()),
        ("hash", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.binary()),
        ("sketch", pa.binary()),
        ("edited_sketch", pa.binary()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("text", pa.string()),
    ]
)
COMPARED_SPARK = (
    "kind string, part int, id long, hash long, n_chars long, edited_sha256 binary, sketch binary, "
    "edited_sketch binary, near_edited double, near_next double, text string"
)


def _against_next(rows: list[dict], following: list[tuple[str, bytes]]) -> list[dict]:
    """Rows with text and sketch, compared with the text and sketch of the document that follows each."""
    edited = []
    for row, (after, _) in zip(rows, following):
        third = len(row["text"]) // 3
        edited.append(row["text"][: len(row["text"]) - third] + after[:third])
    sketches = fingerprints(edited)
    own = [row["sketch"] for row in rows]
    near_edited, near_next = _likenesses(own, sketches), _likenesses(own, [sketch for _, sketch in following])
    return [
        {
            **row,
            "kind": "done",
            "text": None,
            "edited_sha256": hashlib.sha256(text.encode()).digest(),
            "edited_sketch": sketch,
            "near_edited": float(one),
            "near_next": float(two),
        }
        for row, text, sketch, one, two in zip(rows, edited, sketches, near_edited, near_next)
    ]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of documents in ascending order of id, then hash: each compared with the id before it.

    Rows of the range's first two ids stay ``open``: the id before the first lies in another
    range, and so may the first rows of the first. ``head`` rows, the first rows of the range's
    first and last two ids, are what such rows ask for.
    """
    first = before = current = None
    for batch in batches:
        sizes = pc.utf8_length(batch.column("text")).to_pylist()
        for start, end in slabs(sizes, SLAB):
            rows = batch.slice(start, end - start).to_pylist()
            for row, sketch in zip(rows, fingerprints([row["text"] for row in rows])):
                row |= {"sketch": sketch, "n_chars": len(row["text"])}
            opened, known, following = [], [], []
            for row in rows:
                if current is None or current["id"] != row["id"]:
                    before, current = current, row
                    first = first or row
                if before is None or before is first:
                    opened.append({**row, "kind": "open"})
                else:
                    known.append(row)
                    following.append((before["text"], before["sketch"]))
            yield pa.RecordBatch.from_pylist(opened + _against_next(known, following), COMPARED)
    heads = [{**row, "kind": "head"} for row in {id(r): r for r in (first, before, current) if r is not None}.values()]
    yield pa.RecordBatch.from_pylist(heads, COMPARED)


def _at_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.utf8_length(batch.column("text")).to_pylist()
        for start, end in slabs(sizes, SLAB):
            rows = batch.slice(start, end - start).to_pylist()
            following = [(row.pop("next_text"), row.pop("next_sketch")) for row in rows]
            yield pa.RecordBatch.from_pylist(_against_next(rows, following), COMPARED)


def compared(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next`` per row.

    The edited text is the document's with its last third (rounded down) replaced by as many
    first code points of the next document, or all of them if it has fewer; the next document
    has the next smaller id, a null id is the smallest, and after the last comes the first. A
    document alone is its own next. Where an id repeats, every row is compared, and the next
    document is the row with the smallest text hash. Null texts count as empty; an empty table
    gives an empty result.

    Texts are shuffled once, into ranges of ids. A task walks through its range in ascending
    order and keeps the texts of two ids; an id that many rows share runs over several ranges.
    Only the rows at the start of a range are compared in a second step, with the few texts
    that ranges leave for each other.
    """
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(whole).alias("hash"), whole.alias("text"))
    spread = own.withColumn("nth", F.monotonically_increasing_id())  # rows that are equal may be many
    ranged = spread.repartitionByRange(ranges, "id", "hash", "nth").sortWithinPartitions("id", "hash")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "id", "hash", "text")
    parsed = written(ranged.mapInArrow(_in_order, COMPARED_SPARK), "fingerprints")

    opened = parsed.where("kind = 'open'")
    heads = parsed.where("kind = 'head'").groupBy("id").agg(F.min_by(F.struct("text", "sketch"), "hash").alias("head"))
    # each range has two open ids and three heads at most, so these windows hold a few ids for each range
    ids = opened.select("id", F.lit(False).alias("head")).distinct().unionByName(heads.select("id", F.lit(True).alias("head")))
    ids = ids.groupBy("id").agg(F.max("head").alias("head"))
    ascending = W.orderBy(F.col("id").asc_nulls_first())
    latest = F.last(F.when(F.col("head"), F.struct("id")), ignorenulls=True)
    smaller = latest.over(ascending.rowsBetween(W.unboundedPreceding, -1))
    largest = latest.over(ascending.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    links = ids.select(F.col("id").alias("of"), F.coalesce(smaller, largest)["id"].alias("next_id"))
    asked = opened.select(F.col("part").alias("at"), "id").distinct().join(links, F.expr("id <=> of")).select("at", "of", "next_id")
    borders = asked.join(heads.withColumnRenamed("id", "head_id"), F.expr("next_id <=> head_id")).select(
        "at", "of", F.col("head.text").alias("next_text"), F.col("head.sketch").alias("next_sketch")
    )
    rest = opened.join(borders, F.expr("part = at AND id <=> of")).mapInArrow(_at_borders, COMPARED_SPARK)
    return parsed.where("kind = 'done'").unionByName(rest).select(
        "id",
        "n_chars",
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        "sketch",
        "edited_sketch",
        "near_edited",
        "near_next",
    )


@register()
def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    found = compared(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("sketch")).alias("fingerprint"),
        F.lower(F.hex("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
