"""Product codes of vectors: Lloyd's algorithm over partition-local cover trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm.common import table, written
from cohortline.llm.registry import register

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components beyond this, after scaling, are taken as this, so that squared distances fit 64 bits.
LARGEST = 1 << 28
#: Vectors of one tree, and points below which a node of it is not divided any more.
BLOCK = 4096
LEAF = 24

FINITE = "forall({0}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Components as whole numbers: ``floor(scale * x)``, held within ``LARGEST``."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(vectors * scale, -LARGEST, LARGEST)).astype(np.int64)


def cuts(length: int, parts: int = PARTS) -> np.ndarray:
    """Borders of consecutive parts; where they can't be equal the first ones are longer by one."""
    size, longer = divmod(length, parts)
    return np.cumsum([0] + [size + (i < longer) for i in range(parts)])


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column per entry."""
    apart = points[:, None, :] - entries[None, :, :]
    return np.einsum("ijk,ijk->ij", apart, apart)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - firsts, sizes)


@dataclass(frozen=True)
class CoverTree:
    """Points in the order of a cover tree's leaves, so that each node holds a range of them.

    A node's centre is its first point and ``radius2`` the squared distance of its farthest. Its
    children are at most half its radius wide and their centres lie more than that apart.
    """

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius2: np.ndarray
    child: np.ndarray
    children: np.ndarray

    @classmethod
    def grow(cls, points: np.ndarray) -> CoverTree:
        order = np.arange(len(points))
        nodes = [[0, len(points), int(squared(points, points[:1]).max()), 0, 0]]
        at = 0
        while at < len(nodes):
            start, end, radius2 = nodes[at][:3]
            if radius2 and end - start > LEAF:
                nodes[at][3] = len(nodes)
                rest, done = order[start:end], []
                while len(rest):
                    apart = points[rest] - points[rest[0]]
                    distance = np.einsum("ij,ij->i", apart, apart)
                    near = 4 * distance <= radius2
                    done.append(rest[near])
                    size = len(done[-1])
                    nodes.append([start, start + size, int(distance[near].max()), 0, 0])
                    start += size
                    rest = rest[~near]
                order[nodes[at][0] : end] = np.concatenate(done)
                nodes[at][4] = len(done)
            at += 1
        return cls(points[order], order, *np.array(nodes, np.int64).T)

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges of points and the nearest entry of each; entries at equal distance: the first.

        A node whose centre lies nearer to one entry than to any other by more than twice its
        radius goes to it as a whole, by the triangle inequality, as does a node of equal points.
        Others descend with the entries that are left; only at the leaves are points compared.
        """
        usable = np.zeros(len(entries), bool)
        usable[np.unique(entries, axis=0, return_index=True)[1]] = True  # a repeated entry never wins
        level, left = np.zeros(1, np.int64), usable[None, :]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(level):
            distance = squared(self.points[self.start[level]], entries)
            distance[~left] = np.iinfo(np.int64).max
            nearest = distance.argmin(1)
            reach = np.sqrt(distance[np.arange(len(level)), nearest]) + 2 * np.sqrt(self.radius2[level])
            left = left & (np.sqrt(distance) <= reach[:, None] * (1 + 1e-9))
            settled = (self.radius2[level] == 0) | (left.sum(1) == 1)
            found.append((self.start[level[settled]], self.end[level[settled]], nearest[settled]))
            leaf = ~settled & (self.children[level] == 0)
            if leaf.any():
                some = level[leaf]
                points = _ranges(self.start[some], self.end[some])
                distance = squared(self.points[points], entries)
                distance[~np.repeat(left[leaf], self.end[some] - self.start[some], axis=0)] = np.iinfo(np.int64).max
                found.append((points, points + 1, distance.argmin(1)))
            inner = ~settled & ~leaf
            some = level[inner]
            level = _ranges(self.child[some], self.child[some] + self.children[some])
            left = np.repeat(left[inner], self.children[some], axis=0)
        return tuple(np.concatenate(x) for x in zip(*found))

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the points of every entry, and their numbers, from running sums over the order."""
        start, end, entry = self.assigned(entries)
        running = np.zeros((len(self.points) + 1, self.points.shape[1]), np.int64)
        np.cumsum(self.points, axis=0, out=running[1:])
        sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
        np.add.at(sums, entry, running[end] - running[start])
        np.add.at(counts, entry, end - start)
        return sums, counts

    def coded(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every point, in the order in which the points were given."""
        start, end, entry = self.assigned(entries)
        nearest = np.empty(len(self.points), np.int64)
        nearest[_ranges(start, end)] = np.repeat(entry, end - start)
        apart = self.points - entries[nearest]
        codes, errors = np.empty_like(nearest), np.empty_like(nearest)
        codes[self.order] = nearest
        errors[self.order] = np.einsum("ij,ij->i", apart, apart)
        return codes, errors

    def packed(self) -> tuple[bytes, bytes, bytes]:
        nodes = np.stack([self.start, self.end, self.radius2, self.child, self.children])
        return self.points.astype("<i4").tobytes(), self.order.astype("<i4").tobytes(), nodes.astype("<i8").tobytes()

    @classmethod
    def unpacked(cls, points: bytes, order: bytes, nodes: bytes) -> CoverTree:
        order = np.frombuffer(order, "<i4").astype(np.int64)
        points = np.frombuffer(points, "<i4").astype(np.int64).reshape(len(order), -1)
        return cls(points, order, *np.frombuffer(nodes, "<i8").reshape(5, -1))


def _trees(batches: Iterator[pa.RecordBatch], schema: pa.Schema, scale: int, parts: int) -> Iterator[pa.RecordBatch]:
    """A row of trees, one per part, for each block of vectors of one length."""
    for batch in batches:
        vectors = batch.column("vector")
        lengths = np.diff(vectors.offsets.to_numpy())
        for length in np.unique(lengths):
            of_length = np.flatnonzero(lengths == length)
            for low in range(0, len(of_length), BLOCK):
                some = batch.take(pa.array(of_length[low : low + BLOCK]))
                values = some.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(some), length)
                values, border = whole(values, scale), cuts(length, parts)
                trees = [CoverTree.grow(values[:, a:b]).packed() for a, b in zip(border, border[1:])]
                points, orders, nodes = map(list, zip(*trees))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([length], pa.int32()),
                        *(pa.ListArray.from_arrays([0, len(some)], some.column(c)) for c in ("id", "label")),
                        *(pa.array([x], pa.list_(pa.binary())) for x in (points, orders, nodes)),
                    ],
                    schema=schema,
                )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[CoverTree]]]:
    for batch in batches:
        for at in range(len(batch)):
            row = batch.slice(at, 1)
            trees = zip(*(row.column(c)[0].as_py() for c in ("points", "orders", "nodes")))
            yield row, row.column("length")[0].as_py(), [CoverTree.unpacked(*tree) for tree in trees]


Books = dict[int, list[np.ndarray]]


def codebooks(trees: DataFrame, books: Books, rounds: int = ROUNDS) -> Books:
    """Codebooks, by length and part, after so many rounds from the given ones.

    A round reads the trees, and each task gives one sum per component of an entry. Only these
    sums, as many numbers as the codebooks have, come to the driver.
    """
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: Books = books) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[list[np.ndarray]]] = {}
            for _, length, block in _blocks(batches):
                own = held.setdefault(length, [[np.zeros_like(b), np.zeros(len(b), np.int64)] for b in books[length]])
                for tree, book, kept in zip(block, books[length], own):
                    for total, more in zip(kept, tree.totals(book)):
                        total += more
            for length, own in held.items():
                for part, (total, counts) in enumerate(own):
                    entry, place = np.nonzero(np.repeat(counts[:, None] > 0, total.shape[1], axis=1))
                    names = ["length", "part", "entry", "place", "total", "n"]
                    columns = [np.full(len(entry), length), np.full(len(entry), part), entry, place, total[entry, place], counts[entry]]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

        partial = trees.select("length", "points", "orders", "nodes").mapInArrow(
            sums, "length long, part long, entry long, place long, total long, n long"
        )
        added = partial.groupBy("length", "part", "entry", "place").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
        )
        books = {length: [book.copy() for book in own] for length, own in books.items()}
        for r in added.collect():  # as many rows as the codebooks have numbers
            books[r["length"]][r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """``id, label, code, error, codebooks_sha256`` per vector.

    Components are made whole numbers (``floor(scale * x)``) and vectors cut into ``parts``
    consecutive parts, each with a codebook of its own. It starts as that part of the vectors with
    the smallest ids; in each round every part goes to the nearest entry (squared distance; the
    first of several) and an entry becomes the componentwise mean of its parts, rounded down, or
    stays where none came. ``code`` has two hex digits per part, ``error`` adds up the squared distances.

    Every task grows cover trees over blocks of its vectors once; they are written to the shared
    folder and each round reads them, so a lost executor costs its tasks of one round. No vector is
    shuffled; sums are exact, so the result does not depend on how rows are dealt out.

    Rows whose vector is null or holds null or non-finite components are dropped. Vectors of
    another length have codebooks of their own; parts that can't be equally long differ by one
    component, and a part without components has code 0. Fewer vectors than entries make smaller
    codebooks. Repeated rows count as vectors of their own, a null id is the largest, equal ids are
    ordered by vector. Components beyond 65,536 (at this scale) are taken as that. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    rows = rows.where(F.expr(f"vector IS NOT NULL AND {FINITE.format('vector')}"))
    kind = rows.schema["label"].dataType.simpleString()
    block = f"length int, id array<long>, label array<{kind}>, points array<binary>, orders array<binary>, nodes array<binary>"
    schema = spark.createDataFrame([], block)
    arrow = schema.toArrow().schema
    trees = written(rows.mapInArrow(lambda batches: _trees(batches, arrow, scale, parts), block), "cover-trees")
    books: Books = {}
    for r in trees.select("length").distinct().collect():  # usually one length, at most a few
        border = cuts(r["length"], parts)
        of_length = rows.where(F.size("vector") == r["length"]).orderBy(F.col("id").asc_nulls_last(), "vector")
        first = whole(np.array([x["vector"] for x in of_length.limit(entries).select("vector").collect()]), scale)
        books[r["length"]] = [first[:, a:b] for a, b in zip(border, border[1:])]
    books = codebooks(trees, books, rounds)
    digests = {length: digest(own) for length, own in books.items()}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, length, block in _blocks(batches):
            codes, errors = zip(*(tree.coded(book) for tree, book in zip(block, books[length])))
            text = [bytes(c).hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
            columns = [
                row.column("id").flatten(),
                row.column("label").flatten(),
                pa.array(text, pa.string()),
                pa.array(np.sum(errors, axis=0)),
                pa.array([digests[length]] * len(text), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error", "codebooks_sha256"])

    return trees.mapInArrow(coded, f"id long, label {kind}, code string, error long, codebooks_sha256 string")


def _oracle() -> str:
    """The same rounds as SQL, one group of subqueries for each."""
    assigned = """code{0} AS (
  SELECT p.row, p.part, arg_min(b.entry, (d, b.entry)) AS entry, min(d) AS d
  FROM parts p JOIN book{0} b USING (part),
       LATERAL (SELECT list_sum(list_transform(list_zip(p.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d) s
  GROUP BY p.row, p.part
)"""
    moved = """book{1} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x
  FROM book{0} b LEFT JOIN (
    SELECT part, entry, list(down ORDER BY place) AS x
    FROM (SELECT part, entry, place, (sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*) AS down
          FROM (SELECT c.part, c.entry, generate_subscripts(p.x, 1) AS place, unnest(p.x) AS v
                FROM code{0} c JOIN parts p ON p.row = c.row AND p.part = c.part)
          GROUP BY part, entry, place)
    GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry
)"""
    steps = []
    for i in range(ROUNDS):
        steps += [assigned.format(i), moved.format(i, i + 1)]
    steps.append(assigned.format(ROUNDS))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v,
         row_number() OVER (ORDER BY vec_id NULLS LAST) AS row
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT row, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x
  FROM kept, range({PARTS}) r(part)
), book0 AS (
  SELECT part, row - 1 AS entry, x FROM parts WHERE row <= {ENTRIES}
), {", ".join(steps)}, coded AS (
  SELECT k.vec_id, k.label, string_agg(format('{{:02x}}', c.entry), '' ORDER BY c.part) AS code, sum(c.d)::BIGINT AS error
  FROM kept k JOIN code{ROUNDS} c ON c.row = k.row GROUP BY k.row, k.vec_id, k.label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded
"""


@register(_oracle())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors and the codebooks' digest."""
    coded = written(vector_codes(table(spark, sf_dir, "embeddings")), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256"
    )
