"""Embedding near-duplicates over an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm.common import table, written
from cohortline.llm.components import components
from cohortline.llm.registry import register

THRESHOLD = 0.9
SAMPLE = 10_000
VECTORS_PER_CELL = 50
MOST_WORDS = 256
TARGET_RECALL = 0.97
BLOCK = 4096
ROUNDS = 12


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks, one per half of a vector, and how many cells of their grid a search visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def _distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _squared(vectors[:, :cut], self.first), _squared(vectors[:, cut:], self.second)

    def ranked(self, vectors: np.ndarray, visits: int) -> np.ndarray:
        """The nearest cells of every vector, nearest first, as ``first * words + second``.

        The multi-sequence traversal: with the words of both halves in order of distance, the
        pair at places (a, b) has at least (a + 1)(b + 1) - 1 pairs that are no farther, so
        the nearest ``visits`` cells are among the pairs with (a + 1)(b + 1) <= visits.
        """
        one, two = self._distances(vectors)
        order_one, order_two = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
        words = one.shape[1]
        a, b = np.divmod(np.arange(words * two.shape[1]), two.shape[1])
        near = (a + 1) * (b + 1) <= visits
        a, b = a[near], b[near]
        sums = np.take_along_axis(one, order_one, 1)[:, a] + np.take_along_axis(two, order_two, 1)[:, b]
        best = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        return order_one[np.arange(len(vectors))[:, None], a[best]] * two.shape[1] + order_two[
            np.arange(len(vectors))[:, None], b[best]
        ]


def _squared(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ words.T + (words**2).sum(1)


def _codebook(points: np.ndarray, words: int, seed: int) -> np.ndarray:
    """Words of k-means (Lloyd) from a fixed seed; a word without points stays where it is."""
    found = points[np.random.default_rng(seed).choice(len(points), words, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = _squared(points, found).argmin(1)
        counts = np.bincount(nearest, minlength=words)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, points)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def build_index(sample: np.ndarray, vectors: int, threshold: float, target_recall: float) -> MultiIndex:
    """Codebooks of a sample, and the visits that reach the target recall at the threshold.

    The hardest links are those at the threshold itself: each sample vector gets a partner at
    exactly this cosine in a random direction, and the visits are those after which the target
    share of partners' cells is reached. Closer pairs are found more often than that.
    """
    cut = sample.shape[1] // 2
    words = int(np.clip(np.sqrt(vectors / VECTORS_PER_CELL), 1, min(MOST_WORDS, len(sample))))
    index = MultiIndex(_codebook(sample[:, :cut], words, 1), _codebook(sample[:, cut:], words, 2), words * words)
    some = sample[:1000]
    away = np.random.default_rng(3).normal(size=some.shape)
    away -= (away * some).sum(1, keepdims=True) * some
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    partner = threshold * some + np.sqrt(1 - threshold**2) * away
    own = index.ranked(partner, 1)[:, 0]
    one, two = index._distances(some)
    rows = np.arange(len(some))
    reached = one[rows, own // words] + two[rows, own % words]
    sums = (one[:, :, None] + two[:, None, :]).reshape(len(some), -1)
    ranks = (sums < reached[:, None]).sum(1) + 1
    return MultiIndex(index.first, index.second, int(np.quantile(ranks, target_recall, method="higher")))


def near_duplicate_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    target_recall: float = TARGET_RECALL,
    sample: int = SAMPLE,
) -> DataFrame:
    """``id, n_links, component_id`` per row: links of cosine >= threshold, and what they connect.

    Vectors that are null, empty, zero, hold null or non-finite components, or have another
    length than most link with nothing. Equal vectors are linked; they are one node of the
    graph with a weight, so copies are never paired. The index is fitted on the ``sample``
    distinct vectors with the smallest hash and holds all. Every vector visits its nearest
    cells; a pair is found if either visits the other's cell, so a link at the threshold
    stays hidden with the square of the one-sided miss rate. Found pairs are verified in
    double precision and counted where they are found; only what connects a block (a forest)
    leaves its task. Blocks of members and of visitors are bounded, hot cells are split.
    Repeated rows count as vectors of their own; a row without an id is not linked to others
    unless they are copies. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    good = rows.where(
        F.expr("id IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    ).where(F.expr("exists(vector, x -> x <> 0)"))
    nodes = good.groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("length", F.size("vector")), "vectors")
    lengths = nodes.groupBy("length").agg(F.sum("copies").alias("n"), F.count("*").alias("distinct"))
    most = lengths.orderBy(F.desc("n"), "length").first()
    base = rows.select("id")
    if most is None:
        return base.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    nodes = nodes.where(F.col("length") == most["length"])
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").toPandas()  # bounded by sample
    index = build_index(_unit(np.stack(chosen["vector"])), most["distinct"], threshold, target_recall)
    words = len(index.second)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                unit = _unit(np.stack(part["vector"]))
                cells = index.ranked(unit, max(index.visits, 1)).astype("<i4")
                yield pd.DataFrame(
                    {
                        "node": part["node"],
                        "copies": part["copies"],
                        "data": [v.tobytes() for v in unit],
                        "cell": cells[:, 0],
                        "visited": [v.tobytes() for v in cells],
                        "groups": [np.unique(v // words).tolist() for v in cells],
                    }
                )

    placed = nodes.mapInPandas(place, "node long, copies long, data binary, cell int, visited binary, groups array<int>")
    placed = written(placed, "placed-vectors")
    group = F.floor(F.col("cell") / words).cast("int")
    # at most as many groups as a codebook has words
    members = {r["g"]: r["n"] for r in placed.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()}
    visitors = {
        r["g"]: r["n"] for r in placed.select(F.explode("groups").alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()
    }
    parts = spark.createDataFrame(
        [(g, -(-n // BLOCK), -(-visitors.get(g, 1) // BLOCK)) for g, n in sorted(members.items())],
        "of int, member_parts int, visitor_parts int",
    )
    parts = F.broadcast(parts)  # one row per word
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    held = placed.join(parts, group == F.col("of")).select(
        "of",
        (share % F.col("member_parts")).alias("member_part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("visitor_parts").cast("long") - 1)).alias("visitor_part"),
        "node", "copies", "data", "cell", "visited",
    )
    visits = placed.withColumn("group", F.explode("groups")).join(parts, F.col("group") == F.col("of")).select(
        "of",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("member_parts").cast("long") - 1)).alias("member_part"),
        (share % F.col("visitor_parts")).alias("visitor_part"),
        "node", "copies", "data", "cell", "visited",
    )
    visits = visits.select(*[F.col(name).alias(name) for name in visits.columns])  # columns of its own
    key = ["of", "member_part", "visitor_part"]

    def verify(inside: pd.DataFrame, coming: pd.DataFrame) -> pd.DataFrame:
        return _verified(inside, coming, threshold, words)

    found = held.groupBy(*key).cogroup(visits.groupBy(*key)).applyInPandas(verify, "node long, links long, other long")
    found = written(found, "vector-links")
    linked = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        nodes.select("vector", "node", "copies")
        .join(links, "node", "left")
        .join(linked, "node", "left")
        .select(
            "vector",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    named = good.join(known, "vector").select("id", "n_links", "component_id")
    rest = rows.join(known.select("vector"), "vector", "left_anti").unionByName(rows.where("id IS NULL").join(known.select("vector"), "vector", "left_semi"))
    return named.unionByName(
        rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    )


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _verified(inside: pd.DataFrame, coming: pd.DataFrame, threshold: float, words: int) -> pd.DataFrame:
    """Links of visitors and members: counts per node, and edges of a forest.

    A pair whose both vectors visit each other's cell is met twice, once from either side, and
    each side counts its own. Where only one visits, it counts for both.
    """
    empty = pd.DataFrame({"node": [], "links": [], "other": []}).astype({"node": "int64", "links": "int64"})
    if inside.empty or coming.empty:
        return empty
    member, copies = inside["node"].to_numpy(), inside["copies"].to_numpy()
    cells = inside["cell"].to_numpy()
    data = np.stack([np.frombuffer(v) for v in inside["data"]])
    reach = np.stack([np.frombuffer(v, "<i4") for v in inside["visited"]])
    guest, guest_copies, guest_cell = coming["node"].to_numpy(), coming["copies"].to_numpy(), coming["cell"].to_numpy()
    guest_data = np.stack([np.frombuffer(v) for v in coming["data"]])
    guest_reach = np.stack([np.frombuffer(v, "<i4") for v in coming["visited"]])
    nodes, place = np.unique(np.concatenate((member, guest)), return_inverse=True)
    at_member, at_guest = place[: len(member)], place[len(member) :]
    links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for cell in np.unique(cells):
        inner = np.flatnonzero(cells == cell)
        outer_all = np.flatnonzero((guest_reach == cell).any(1))
        for start in range(0, len(outer_all), 512):
            outer = outer_all[start : start + 512]
            row, column = np.nonzero(guest_data[outer] @ data[inner].T >= threshold)
            row, column = outer[row], inner[column]
            other = guest[row] != member[column]
            row, column = row[other], column[other]
            if not len(row):
                continue
            np.add.at(links, at_guest[row], copies[column])
            one_sided = ~np.concatenate(
                [
                    (reach[column[i : i + 65536]] == guest_cell[row[i : i + 65536], None]).any(1)
                    for i in range(0, len(row), 65536)
                ]
            )
            np.add.at(links, at_member[column[one_sided]], guest_copies[row[one_sided]])
            a, b = at_guest[row], at_member[column]
            while True:  # smallest label along links
                least = np.minimum(label[a], label[b])
                if (label[a] == least).all() and (label[b] == least).all():
                    break
                np.minimum.at(label, label[a], least)
                np.minimum.at(label, label[b], least)
                np.minimum.at(label, a, least)
                np.minimum.at(label, b, least)
                label = label[label]
    while not (label[label] == label).all():
        label = label[label]
    seen = np.flatnonzero((links > 0) | (label != np.arange(len(nodes))))
    other = [nodes[label[i]] if label[i] != i else None for i in seen]
    return pd.DataFrame({"node": nodes[seen], "links": links[seen], "other": pd.array(other, "Int64")})


#: Brute force: the cosine of all pairs, and all that links reach.
LINKS_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scaled AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM scaled a JOIN scaled b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
),
reached(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
),
counted AS (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT a AS vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(b) AS component_id, a = min(b) AS kept
FROM reached LEFT JOIN counted USING (a) GROUP BY a
"""


@register(LINKS_SQL)
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    found = near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
