"""A trie of conversation prefixes: singletons are screened out, what may be shared is grouped exactly."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.llm.common import table, written
from cohortline.llm.registry import register
from cohortline.llm.screening import cells_for, numbers, sketch

WORD = r"[^\x20\x09-\x0D]+"
SHARED_FROM = 20
MOST_SHARED_TURNS = 4
ROOT = bytes(16)
#: Ids joined into one row on their way to a digest.
IDS_IN_A_ROW = 10_000

PREFIX = "digest binary, parent binary, conv_id long, depth int, words long, ends boolean"
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps role and text apart."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def turn_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, turn_digest, words`` per row of conversations: texts stay where they are read."""
    return rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        turn_digest(F.col("role"), F.col("text")).alias("turn_digest"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
    )


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of rebuilt conversations; rows come by group, conversation and turn, the group's first one ahead."""
    of_group: int | None = None
    head: list[tuple[bytes, int]] = []
    conv: int | None = None
    place = take = 0
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])

        def emit(at: int | None, digest: bytes | None = None, words: int | None = None) -> None:
            for column, value in zip(out, (conv, at, digest, words)):
                column.append(value)

        for group, own, digest, words in zip(*(batch.column(c).to_pylist() for c in ("group", "conv_id", "turn_digest", "words"))):
            if group != of_group:
                of_group, head = group, []
            if own != conv:
                conv, place, take = own, 0, zlib.crc32(str(own).encode()) % MOST_SHARED_TURNS
                emit(None)  # there may be no turn at all
                if own != group:
                    for at, turn in enumerate(head[:take]):
                        emit(at, *turn)
            if own == group and place < MOST_SHARED_TURNS - 1:
                head.append((digest, words))
            if own == group or place >= take:
                emit(place if own == group else place - take + min(take, len(head)), digest, words)
            place += 1
        if out[0]:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["conv_id", "place", "turn_digest", "words"])


def rebuilt(rows: DataFrame, group: int = SHARED_FROM) -> DataFrame:
    """``conv_id, place, turn_digest, words``: every conversation with its first turns taken from another one.

    The first h turns of conversation c become those of the conversation c - c % group (fewer if it has
    fewer, none if it is absent), with h = crc32(c) % 4; ids below zero take the multiple below them. Turns
    are ordered by ``turn`` (null first), equal ones by their digest. One more row per conversation, with a
    null place, stands for the conversation itself. Rows without conv_id are left out.
    """
    own = turn_rows(rows).withColumn("group", F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(group)))
    together = own.repartition("group").sortWithinPartitions("group", "conv_id", "turn", "turn_digest")
    return together.mapInArrow(_rebuild, "conv_id long, place long, turn_digest binary, words long")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per prefix, the root included; rows come by conversation and place (null first)."""
    conv: int | None = None
    depth, last = 0, ROOT
    held: list | None = None  # the newest prefix, of which it is not known whether it is the last
    names = ["digest", "parent", "conv_id", "depth", "words", "ends"]
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        rows = []
        for own, digest, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_digest", "words"))):
            if own == conv and digest is None:
                continue
            if held is not None:
                held[5] = own != conv
                rows.append(held)
                held = None
            if own != conv:
                conv, depth, last = own, 0, ROOT
                held = [ROOT, None, conv, 0, 0, True]
            if digest is not None:
                if held is not None:
                    held[5] = False
                    rows.append(held)
                new = hashlib.blake2b(last + digest, digest_size=16).digest()
                depth += 1
                held = [new, last, conv, depth, words, True]
                last = new
        if rows:
            yield batch_of(rows)
    if held is not None:
        yield batch_of([held])


def prefixes(turns: DataFrame) -> DataFrame:
    """``digest, parent, conv_id, depth, words, ends`` per conversation and prefix, by conversation and depth.

    ``turns`` has ``conv_id, place, turn_digest, words``; a row without a digest adds no turn. A prefix's
    128-bit digest hashes its parent's and the turn's, so equal digests mean equal sequences of turns.
    """
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_chained, PREFIX)


def _screened(single: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Splits prefixes, in order of conversation and depth, into those that may be shared and tails."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: int | None = None
        in_tail = False
        for batch in batches:
            if not len(batch):
                continue
            depth = batch.column("depth").to_numpy()
            alone = single(numbers(batch.column("digest"))) & (depth > 0)
            owner = batch.column("conv_id").to_numpy()
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            # after the first singleton of a conversation all prefixes are singletons
            seen = np.cumsum(alone)
            before = np.repeat(seen[first] - alone[first], np.diff(np.append(first, len(owner))))
            tail = seen > before
            if in_tail and owner[0] == conv:
                tail[: first[1] if len(first) > 1 else None] = True
            opens = tail.copy()
            opens[1:] &= ~(tail[:-1] & (owner[1:] == owner[:-1]))
            opens[0] &= not (in_tail and owner[0] == conv)
            conv, in_tail = owner[-1], bool(tail[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tail), pa.array(opens)], names=[*batch.schema.names, "tail", "opens"]
            )

    return split


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal digests as comma-joined ids, so many at most in a row."""
    digest, first, ids = None, None, []
    for batch in batches:
        rows = []
        for own, conv in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (own != digest or len(ids) == IDS_IN_A_ROW):
                rows.append((digest, first, ",".join(ids)))
                ids = []
            if not ids:
                digest, first = own, conv
            ids.append(str(conv))
        if rows:
            yield _id_rows(rows)
    if ids:
        yield _id_rows([(digest, first, ",".join(ids))])


def _id_rows(rows: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string()))], names=["digest", "first", "ids"]
    )


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, running = None, hashlib.sha256()
    names = ["of", "ends_sha256"]
    for batch in batches:
        done = []
        for own, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
            if own == digest:
                running.update(b",")
            else:
                if digest is not None:
                    done.append((digest, running.hexdigest()))
                digest, running = own, hashlib.sha256()
            running.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([running.hexdigest()])], names=names)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``of, ends_sha256``: for each digest the SHA-256 of its ids, ascending, with commas between.

    A node at which very many conversations end is spread over ranges of ids; each range joins its
    ids, and only these long rows meet in one task, which hashes them one after the other.
    """
    ranges = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = ends.repartitionByRange(ranges, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    joined = spread.mapInArrow(_joined_ids, "digest binary, first long, ids string")
    met = joined.repartition("digest").sortWithinPartitions("digest", "first")
    return met.mapInArrow(_hashed_ids, "of binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, cells: int | None = None) -> DataFrame:
    """The nodes of the trie over conversations given as ``conv_id, place, turn_digest, words``.

    A node is a distinct sequence of first turns; the root has none. Its members are the conversations
    that start with it. ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` per node: the smallest member, the number of turns, the parent's smallest member, members,
    children, childless nodes of the subtree (itself included), the words of last turns of the subtree that
    n_convs - 1 members need not repeat, and the SHA-256 of the ids of conversations that end here.

    A count-min sketch of all prefixes is broadcast (64 MB at the most). An estimate of one proves that a
    prefix belongs to one conversation, and so do all that go on from it: such tails become nodes where they
    are. Other prefixes, the really shared ones and the few that share cells with others, are grouped by
    digest with map-side sums. ``cells`` (a power of two; by default about four for each prefix, within bounds)
    is the length of the sketch's rows: if it is too small, fewer tails are found, and nothing else changes.

    Sums over subtrees need no walk up the trie: each node is counted by its smallest member, which is
    a member of all ancestors, so its running sum from the last turn upwards, added up over a node's
    members, is the sum over the node's subtree.

    Rows are ordered by place; repeated rows are turns of their own. Rows without conv_id are left out. A
    conversation without turns is a member of the root. An empty table has no node.
    """
    links = written(prefixes(turns.where("conv_id IS NOT NULL")), "prefixes")
    cells = cells or cells_for(links.count())
    counted = links.sparkSession.sparkContext.broadcast(sketch(links.where("depth > 0").select("digest"), cells))
    ordered = links.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    split = _screened(lambda digests: counted.value.single(digests))
    screened = written(ordered.mapInArrow(split, f"{PREFIX}, tail boolean, opens boolean"), "screened-prefixes")
    counted.destroy()
    return nodes(screened)


def nodes(screened: DataFrame) -> DataFrame:
    """The trie of prefixes of which ``tail`` marks known singletons, and ``opens`` the first of a conversation's tail."""
    shared = screened.where("NOT tail")
    met = shared.groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.first("words").alias("words"),
    )
    met = written(met, "shared-nodes")
    below = met.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n"))
    first_of_tail = screened.where("opens").select("conv_id", "parent")
    tails = first_of_tail.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n"))
    children = below.unionByName(tails).groupBy("of").agg(F.sum("n").alias("n_children"))
    met = met.join(children, F.col("digest") == F.col("of"), "left").drop("of").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    met = written(met, "counted-nodes")

    # what each node brings, at its smallest member's prefix; a tail ends in a leaf of its own
    brought = met.select(
        "conv_id", "depth", F.lit(None).cast("binary").alias("digest"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"),
    )
    leaves = first_of_tail.select(
        "conv_id", F.lit((1 << 31) - 1).alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("saved"), F.lit(1).alias("leaf")
    )
    asked = shared.select("conv_id", "depth", "digest", F.lit(0).cast("long").alias("saved"), F.lit(0).alias("leaf"))
    upwards = W.partitionBy("conv_id").orderBy(F.col("depth").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    along = brought.unionByName(leaves).unionByName(asked).select(
        "digest", F.sum("saved").over(upwards).alias("saved"), F.sum("leaf").over(upwards).alias("leaf")
    )
    along = along.where("digest IS NOT NULL AND (saved > 0 OR leaf > 0)")
    sums = along.groupBy(F.col("digest").alias("of")).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    # the ids of a node's last members; most nodes have none
    ended = ends_digests(written(shared.where("ends").select("digest", "conv_id"), "ends"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = (
        met.join(sums, F.col("digest") == F.col("of"), "left").drop("of")
        .join(ended, F.col("digest") == F.col("of"), "left").drop("of")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    )
    own = screened.where("tail").select(
        "conv_id",
        "depth",
        F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("ends"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"),
        F.when(F.col("opens"), F.col("parent")).alias("parent"),
        F.when(~F.col("opens"), F.col("conv_id")).alias("within"),
    )
    columns = [c.split()[0] for c in NODE.split(", ")]
    inner = own.where("within IS NOT NULL").withColumn("parent_conv_id", F.col("within"))
    outer = whole.withColumn("within", F.lit(None).cast("long")).select(*own.columns).unionByName(own.where("within IS NULL"))
    parents = met.select(F.col("digest").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    outer = outer.join(parents, F.col("parent") == F.col("of"), "left")
    found = inner.select(*columns).unionByName(outer.select(*columns))
    return found.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in NODE.split(", ")])


ORACLE = r"""
WITH polynomial AS (
  SELECT list(v ORDER BY n) AS steps
  FROM (SELECT n, list_reduce(list_prepend(n, range(8)),
                              lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) t(n))
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), polynomial
), rebuilt AS (
  SELECT c.conv_id, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h
), prefixes AS (
  SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS words FROM convs
  UNION ALL
  SELECT conv_id, row_number() OVER own, string_agg(sha256(length(role) || ':' || role || text), '') OVER own,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
  FROM rebuilt WINDOW own AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), links AS (
  SELECT *, lag(prefix) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM prefixes
), nodes AS (
  SELECT prefix, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, min(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM links GROUP BY prefix
), children AS (
  SELECT parent AS prefix, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), leaves AS (
  SELECT l.prefix, count(*) AS n_leaves
  FROM nodes n JOIN links l ON l.conv_id = n.conv_id AND l.depth <= n.depth
  WHERE n.prefix NOT IN (SELECT prefix FROM children) GROUP BY l.prefix
), saved AS (
  SELECT l.prefix, sum((n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n JOIN links l ON l.conv_id = n.conv_id AND l.depth <= n.depth GROUP BY l.prefix
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN leaves USING (prefix) JOIN saved USING (prefix) LEFT JOIN children USING (prefix)
     LEFT JOIN nodes p ON p.prefix = n.parent
"""


@register(ORACLE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie over all conversations, rebuilt."""
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))
