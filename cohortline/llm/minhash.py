"""Near copies: SimHash groups and MinHash bands over word shingles, candidates verified by exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import MULTIPLIER, SliceHash, mix, slabs, unused, word_bounds, written
from cohortline.llm.components import components
from cohortline.llm.simhash import near_duplicate_groups

SHINGLE_WORDS = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.995
SLAB = 1 << 18
#: Members of a bucket that all others are compared with, beside the smallest.
PIVOTS = 3
#: Members of a bucket in one block, and shingles whose marks are held at a time.
BLOCK, COLUMNS = 256, 4096


def tuned_bands(similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL, most_rows: int = 5) -> tuple[int, int]:
    """Bands and rows: the most rows a band may have, and as few bands as reach the target recall.

    Texts of Jaccard similarity s share a band of r minima with probability s**r.
    """
    chance = similarity**most_rows
    return int(np.ceil(np.log(1 - target_recall) / np.log(1 - chance))), most_rows


def shingle_runs(texts: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts (words joined by single spaces), and each text's first place in them.

    A text of fewer words than a shingle has none.
    """
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = word_bounds(data)
    hashed = SliceHash(data)
    sizes = np.maximum(counts - SHINGLE_WORDS + 1, 0)
    firsts = np.cumsum(sizes) - sizes
    words = np.cumsum(counts) - counts
    at = np.arange(sizes.sum()) + np.repeat(words - firsts, sizes)
    return hashed(starts[at], ends[at + SHINGLE_WORDS - 1]), firsts


def band_keys(hashes: np.ndarray, firsts: np.ndarray, most_rows: int = 5) -> np.ndarray:
    """A row of band keys per run of shingle hashes; no run may be empty."""
    bands, rows = tuned_bands(most_rows=most_rows)
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)
    powers = mix(np.arange(1, rows + 1, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)
    minima = np.empty((len(firsts), bands * rows), np.uint64)
    for i, factor in enumerate(factors):
        scaled = hashes * factor
        scaled ^= scaled >> np.uint64(32)
        minima[:, i] = np.minimum.reduceat(scaled, firsts) if len(firsts) else 0
    sums = (minima.reshape(-1, bands, rows) * powers).sum(2) + np.arange(bands, dtype=np.uint64) * MULTIPLIER
    return mix(sums).view(np.int64)


def linked(sets: DataFrame, shingles_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """Edges ``a, b`` that connect distinct sets (``value, keys``) of enough Jaccard similarity.

    Sets that share a band are candidates; ``shingles_of`` gives ``value, shingles`` of the candidate
    values. First, every one is verified against a few pivots of its bucket, its smallest value and others by
    hash: pairs grow with the bucket, not with its square, and a large group of near copies, which are like
    many of the others, is connected by them. Buckets that still hold several groups are then compared
    whole, in bounded blocks (``_blockwise``): no candidate between groups is left out.
    """
    bands = sets.select("value", F.explode("keys").alias("key"))
    met = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = written(bands.join(met, "key"), "buckets")
    shingles = written(shingles_of(members.select("value").distinct()), "shingles")
    chosen = [F.min("value"), *[F.min_by("value", F.xxhash64("value", F.lit(i))) for i in range(PIVOTS)]]
    pivots = members.groupBy("key").agg(F.array_distinct(F.array(*chosen)).alias("pivots"))
    stars = members.join(pivots, "key").select("value", F.explode("pivots").alias("pivot")).where("value <> pivot").select(
        F.least("value", "pivot").alias("a"), F.greatest("value", "pivot").alias("b")
    )
    near = written(_verified(stars.distinct(), shingles, similarity), "stars")
    groups = components(near)
    grouped = members.join(groups.withColumnRenamed("node", "value"), "value", "left").select(
        "key", "value", F.coalesce("component", "value").alias("group")
    )
    open_keys = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    still = written(grouped.join(open_keys.select("key"), "key", "left_semi"), "open-buckets")
    return near.unionByName(_blockwise(still, shingles, similarity))


def _blockwise(members: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Edges that connect the members (``key, value, group``) of each key across its groups.

    A key's members are dealt into blocks of about ``BLOCK``, and every two blocks of it meet in one step, so what
    a step holds is bounded however many members a key has. Common shingles are counted for all pairs at
    once, as a product of matrices, and only a forest leaves the step: no pair becomes a row.
    """
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("value"), F.col("blocks")).cast("int"))
    met = dealt.join(shingles, "value").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "value", "group", "shingles"
    )
    step = ["key", "low", "high"]
    together = met.repartition(*step).sortWithinPartitions(*step)

    def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, groups, sets in _steps(batches):
            one, two = _forest(values, groups, sets, similarity)
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["a", "b"])

    return together.mapInArrow(connected, "a long, b long").distinct()


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Values, groups and shingles of each step, from rows in the order of the steps."""
    open_, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        names = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")], axis=1)
        first = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(1)))
        for at, end in zip(first, [*first[1:], len(batch)]):
            if open_ is not None and (names[at] != open_).any():
                yield _step(held)
                held = []
            open_ = names[at]
            held.append(batch.slice(at, end - at))
    if held:
        yield _step(held)


def _step(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    rows = pa.Table.from_batches(parts).combine_chunks()
    sets = [s for c in rows["shingles"].chunks for s in np.split(c.flatten().to_numpy(), np.cumsum(np.diff(c.offsets.to_numpy()))[:-1])]
    return rows["value"].to_numpy(), rows["group"].to_numpy(), sets


def _forest(
    values: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest value of what similar pairs of different groups connect to the others."""
    sizes = np.array([len(s) for s in sets])
    tokens, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    kept = counts[token] > 1
    place = np.cumsum(counts > 1) - 1
    token, owner = place[token[kept]], owner[kept]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    common = np.zeros((len(sets), len(sets)))
    for low in range(0, token[-1] + 1 if len(token) else 0, COLUMNS):
        some = slice(*np.searchsorted(token, [low, low + COLUMNS]))
        marks = np.zeros((len(sets), min(COLUMNS, int(token[-1]) + 1 - low)), np.float32)
        marks[owner[some], token[some] - low] = 1
        common += marks @ marks.T
    alike = common >= similarity * (sizes[:, None] + sizes[None, :] - common)
    alike &= groups[:, None] != groups[None, :]
    names = np.where(alike.any(1), values, np.iinfo(np.int64).max)
    label = np.where(alike.any(1), values, 0)
    while True:  # the smallest value along links
        least = np.minimum(label, np.where(alike, label[None, :], np.iinfo(np.int64).max).min(1))
        if (least == label).all():
            break
        label = least
    led = (names != np.iinfo(np.int64).max) & (label != values)
    return label[led], values[led]


def _verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    one = shingles.select(F.col("value").alias("a"), F.col("shingles").alias("set_a"))
    two = shingles.select(F.col("value").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(common / (F.size("set_a") + F.size("set_b") - common) >= similarity).select("a", "b")


def normal(text: Column) -> Column:
    """The words of a text in lower case, split at ASCII white space, joined by single spaces; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [text.encode() for text in batch["words"]]
        for low, high in slabs(map(len, texts), SLAB):
            some = texts[low:high]
            counts = np.array([text.count(b" ") + 1 for text in some])
            long = counts >= SHINGLE_WORDS
            keys = pd.Series([[]] * len(some), dtype=object)
            if long.any():
                found = band_keys(*shingle_runs([text for text, is_long in zip(some, long) if is_long], counts[long]))
                keys[long] = pd.Series(list(found), index=np.flatnonzero(long))
            yield pd.DataFrame(
                {"id": batch["id"].iloc[low:high].array, "value": batch["value"].to_numpy()[low:high], "keys": keys.array}
            )


def _shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for value, words in zip(batch["value"], batch["words"]):
            hashes, _ = shingle_runs([words.encode()], np.array([words.count(" ") + 1]))
            yield pd.DataFrame({"value": [value], "shingles": [np.unique(hashes).view(np.int64)]})


def near_copy_groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """``id, value, component_id`` per row of the documents.

    Documents whose sets of five-word shingles have at least this Jaccard similarity are linked. Candidates are
    those that SimHash groups (op10's operator, over the same shingles with their repeats) and those that share a
    MinHash band: fingerprints two bits apart find what differs little, or only beside what a text repeats,
    bands find the rest down to this similarity. component_id is the smallest id reachable over links. ``value`` is the hash of a text's words
    in lower case: equal ones are one node of the graph, as are all texts without words. Texts of fewer
    than five words are linked to equal ones only. A null id counts only if no other id is in its group.
    """
    rows = docs.select(F.col(id_column).alias("id"), normal(F.col(text)).alias("words"))
    rows = rows.withColumn("value", F.xxhash64("words"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, value long, keys array<long>"
    parsed = written(rows.mapInPandas(_keys, schema), "document-bands")
    sets = parsed.groupBy("value").agg(F.min("id").alias("least"), F.first("keys").alias("keys"))
    sets = written(sets, "documents-by-value")

    def shingles_of(values: DataFrame) -> DataFrame:
        one = rows.join(values, "value", "left_semi").groupBy("value").agg(F.first("words").alias("words"))
        return one.mapInPandas(_shingles, "value long, shingles array<long>")

    alike = near_duplicate_groups(rows.select("value", "words"), "value", "words", SHINGLE_WORDS)
    alike = alike.select(F.col("id").alias("value"), F.xxhash64(F.lit("simhash"), "component_id").alias("alike")).distinct()
    keyed = sets.where("size(keys) > 0").join(alike, "value").select("value", F.concat("keys", F.array("alike")).alias("keys"))
    groups = components(linked(keyed, shingles_of, similarity))
    grouped = sets.join(groups.withColumnRenamed("node", "value"), "value", "left").select(
        "value", "least", F.coalesce("component", "value").alias("component")
    )
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "component").select("value", "component_id")
    return parsed.select("id", "value").join(named, "value").select("id", "value", "component_id")


def keep_one_near_copy(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: of each group the row with the smallest id.

    Where the smallest id repeats, all its rows in the group stay; rows without an id stay. A row is
    dropped by its id and text, so another text with the same id is not dropped with it.
    """
    left, value = unused(docs, "_id", "_value")
    dropped = near_copy_groups(docs, id_column, text).where("id <> component_id").select(
        F.col("id").alias(left), F.col("value").alias(value)
    ).distinct()
    same = (F.col(id_column) == F.col(left)) & (F.xxhash64(normal(F.col(text))) == F.col(value))
    return docs.join(dropped, same, "left_anti")
