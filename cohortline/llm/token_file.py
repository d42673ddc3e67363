"""Token ids in patched frame-of-reference blocks, written and read back in document order."""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from cohortline.llm.common import slabs, table
from cohortline.llm.registry import register
from cohortline.session import scratch_path

VOCABULARY_FILE = "word_bpe_49k.json"
END_ID = 1
BLOCK = 1024
SEGMENT_BLOCKS = 64
SEGMENT_IDS = BLOCK * SEGMENT_BLOCKS
PERCENTILE = 95
REMEMBERED_WORDS = 300_000
LONGEST_REMEMBERED = 48
#: Words that are encoded in one call.
CALL_WORDS = 1024
SLAB = 1 << 23

HEADER = np.dtype([("ids", "<u4"), ("blocks", "<u4")])
BLOCK_HEADER = np.dtype([("least", "<u4"), ("ids", "<u2"), ("width", "u1"), ("exceptions", "<u2")])


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block: header, differences to the minimum at a common width, then the exceptions.

    The width holds the given percentile of the differences; those that need more bits keep
    their low bits in place, and their positions and full values follow.
    """
    least = ids.min()
    rest = (ids - least).astype(np.uint32)
    at = min(len(rest) - 1, int(len(rest) * percentile / 100))
    width = int(np.partition(rest, at)[at]).bit_length()
    wide = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    held = 16 if width <= 16 else 32  # bits of the numbers that are taken apart
    low = rest.astype(np.uint16).byteswap() if held == 16 else rest.byteswap()
    bits = np.unpackbits(low.view(np.uint8)).reshape(-1, held)[:, held - width :]
    header = np.array([(least, len(ids), width, len(wide))], BLOCK_HEADER)
    return b"".join(
        [header.tobytes(), np.packbits(bits).tobytes(), wide.astype("<u2").tobytes(), rest[wide].astype("<u4").tobytes()]
    )


def unpack_block(data: bytes, at: int) -> np.ndarray:
    """The ids of the block that starts at a byte of the data."""
    header = np.frombuffer(data, BLOCK_HEADER, 1, at)[0]
    count, width, exceptions = int(header["ids"]), int(header["width"]), int(header["exceptions"])
    at += BLOCK_HEADER.itemsize
    size = (count * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count * width).reshape(count, width)
    held = 16 if width <= 16 else 32
    full = np.zeros((count, held), np.uint8)
    full[:, held - width :] = bits
    rest = np.packbits(full.ravel()).view(f">u{held // 8}").astype(np.uint32)
    at += size
    places = np.frombuffer(data, "<u2", exceptions, at)
    rest[places] = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
    return rest + header["least"]


def pack_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Counts, the byte offset of every block's start, then the blocks."""
    blocks = [pack_block(ids[i : i + block]) for i in range(0, len(ids), block)]
    header = np.array([(len(ids), len(blocks))], HEADER)
    first = HEADER.itemsize + 4 * len(blocks)
    starts = first + np.cumsum([0, *map(len, blocks)])[:-1]
    return b"".join([header.tobytes(), starts.astype("<u4").tobytes(), *blocks])


def unpack_segment(data: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks, found through the index of starts."""
    count = int(np.frombuffer(data, HEADER, 1)[0]["blocks"])
    starts = np.frombuffer(data, "<u4", count, HEADER.itemsize)[first_block:last_block]
    return np.concatenate([np.empty(0, np.uint32), *[unpack_block(data, int(at)) for at in starts]])


class WordTokenizer:
    """The ids of a vocabulary of the tokenizers library, words remembered.

    The vocabulary drops white space and merges within words only, so a text's ids are those
    of the words between its spaces and line breaks, one after the other. As in the library, special
    tokens are found by their exact strings before anything else, whatever stands next to them.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are spread by Spark; threads would spin beside them
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # exact ones are cut out before; lowering may make others
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {token.content: np.array([i], "<u4").tobytes() for i, token in added.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None  # whether an id ends a piece, where every piece of bytes has an end of its own
        if suffix and all(byte + suffix in vocabulary for byte in pre_tokenizers.ByteLevel.alphabet()):
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit integers."""
        pieces = [self.cut.split(text) if any(name in text for name in self.special) else [text] for text in texts]
        found = iter(self._ordinary([piece for cut in pieces for piece in cut[::2]]))
        # ordinary text and special tokens take turns
        return [b"".join(self.special[piece] if i % 2 else next(found) for i, piece in enumerate(cut)) for cut in pieces]

    def _ordinary(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens.

        Looks each distinct word up once and puts the ids in the order of the texts. The
        vocabulary is in lower case and never joins a letter or digit with the mark after it, so
        A-Z are lowered and marks at the end of words become words of their own.
        """
        lines = pc.ascii_lower(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "))
        lists = pc.split_pattern(pc.replace_substring_regex(lines, "([a-z0-9])([,.]) ", r"\1 \2 "), " ")
        words = lists.values.dictionary_encode()
        packed = self._packed(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        table = np.frombuffer(b"".join(packed), "<u4")
        places = words.indices.to_numpy()
        taken = sizes[places]
        ends = np.concatenate(([0], np.cumsum(taken)))
        first = (np.cumsum(sizes) - sizes)[places] - ends[:-1]
        data = table[np.repeat(first, taken) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[lists.offsets.to_numpy()]).tolist()
        return [data[low:high] for low, high in zip(cuts, cuts[1:])]

    def _packed(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) >= REMEMBERED_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = list(map(known.get, words))
        gaps = [i for i, packed in enumerate(found) if packed is None]
        missing = []
        for i in gaps:
            packed = found[i] = older.get(words[i])
            if packed is None:
                missing.append(i)
        letters, others = [], []
        for i in missing:
            (letters if words[i].isalpha() else others).append(i)
        for places, encoded in ((letters, self._whole), (others, self._cut)):
            for at in range(0, len(places), CALL_WORDS):
                some = places[at : at + CALL_WORDS]
                ids, cuts = encoded([words[i] for i in some])
                packed = ids.tobytes()
                for i, low, high in zip(some, [0, *cuts], cuts):
                    found[i] = packed[4 * low : 4 * high]
        known.update((words[i], found[i]) for i in gaps if len(words[i]) <= LONGEST_REMEMBERED)
        return found

    def _whole(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of words of letters, and where each word ends in them.

        The library may split a word into several pieces, never into none: if there are as many ends of pieces as words,
        each word is one piece, and no offsets are needed. If not, offsets tell.
        """
        if self.ends is not None:
            encoded = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
            ids = np.array(encoded.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(words):
                return ids, cuts.tolist()
        return self._cut(words)

    def _cut(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of words, and where each word ends in them: an id belongs to the word in which it starts."""
        collects = gc.isenabled()
        gc.disable()  # offsets come as millions of pairs, none of them in a cycle
        try:
            encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            starts = np.array([start for start, _ in encoded.offsets], np.int64)
        finally:
            if collects:
                gc.enable()
        ends = np.cumsum([len(word) + 1 for word in words])
        return np.array(encoded.ids, "<u4"), np.searchsorted(starts, ends).tolist()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def word_ids(text: Column, path: str, end_id: int = END_ID) -> Column:
    """Ids of a text column and the end id, as binary; a null text counts as empty."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_encoded(texts, path, end_id)), dtype=object)

    return encode(text)


def _encoded(texts: pd.Series, path: str, end_id: int = END_ID) -> Iterator[bytes]:
    end, values = int(end_id).to_bytes(4, "little"), texts.fillna("").tolist()
    for low, high in slabs(map(len, values), SLAB):
        for ids in tokenizer(path).encode(values[low:high]):
            yield ids + end


FILE_SCHEMA = (
    "shard int, segment int, segment_ids long, payload binary, docs array<struct<doc_id: long, first: long, ids: long>>"
)


def write_token_file(docs: DataFrame, path: str, vocabulary: str | None = None, shards: int | None = None) -> None:
    """Writes ``doc_id, ids`` (binary, 32-bit little-endian) as a token file, ascending doc_id.

    With a vocabulary, ``doc_id, text`` are given and texts are encoded after they are put in
    order: they are smaller than their ids, and finding the ranges does not encode them as well.

    The file is a folder of shards, each a range of doc_id (null first) in order; a shard is a
    sequence of segments. A segment's payload holds blocks packed by ``pack_segment``; its
    ``docs`` list the documents that start in it or run into it: where they start, counted in the
    shard's ids, and how many ids. A document may run over any number of segments. Rows with the same doc_id are
    ordered by the hash of their content. Shards come from a range partitioning, so no task holds more
    than one shard's current segment, and Spark writes them: any store that it can write works.
    """
    count = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    content = "text" if vocabulary else "ids"
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(content).alias("content"))
    keyed = keyed.withColumn("tie", F.xxhash64("content"))
    ranged = keyed.repartitionByRange(count, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ranged = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "content")
    ranged.mapInPandas(lambda batches: _segments(batches, vocabulary), FILE_SCHEMA).write.parquet(path)


def _segments(batches: Iterator[pd.DataFrame], vocabulary: str | None) -> Iterator[pd.DataFrame]:
    size = SEGMENT_IDS
    shard, segment, total = 0, 0, 0
    waiting, held, docs = [], 0, []

    def row(ids: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(
            {"shard": [shard], "segment": [segment], "segment_ids": [len(ids)], "payload": [pack_segment(ids)], "docs": [docs]}
        )

    for batch in batches:
        contents = _encoded(batch["content"], vocabulary) if vocabulary else batch["content"]
        for shard, doc_id, data in zip(batch["shard"], batch["doc_id"], contents):
            ids = np.frombuffer(data or b"", "<u4")
            docs.append({"doc_id": None if pd.isna(doc_id) else int(doc_id), "first": total, "ids": len(ids)})
            total += len(ids)
            waiting.append(ids)
            held += len(ids)
            if held >= size:
                joined = np.concatenate(waiting)
                for at in range(0, held - size + 1, size):
                    yield row(joined[at : at + size])
                    segment += 1
                    docs = [doc for doc in docs[-1:] if doc["first"] + doc["ids"] > segment * size]
                waiting = [joined[held - held % size :]]
                held %= size
    if held or docs:
        yield row(np.concatenate(waiting))


READ_SCHEMA = "shard int, doc_id long, first long, n_tokens long, segment int, ids binary"


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a token file; start counts the ids of all documents before.

    Segments are read wherever they lie, each by itself. Only the parts of documents that run
    over a segment's end, found through the block index, are shuffled and put together.
    """
    stored = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = stored.groupBy("shard").agg(F.sum("segment_ids").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    offsets = F.broadcast(sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    segments = stored.select("shard", "segment", "segment_ids", "payload", "docs")
    whole = segments.mapInPandas(_documents, READ_SCHEMA)
    end = (F.col("segment").cast("long") + 1) * SEGMENT_IDS
    cut = F.filter("docs", lambda doc: (doc["first"] < end - SEGMENT_IDS) | (doc["first"] + doc["ids"] > end))
    parts = segments.withColumn("docs", cut).where("size(docs) > 0").mapInPandas(_parts, READ_SCHEMA)
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("segment", "ids"))),
        F.lit(b""),
        lambda ids, part: F.concat(ids, part["ids"]),
    )
    joined = parts.groupBy("shard", "doc_id", "first", "n_tokens").agg(joined.alias("ids"))
    read = whole.drop("segment").unionByName(joined)
    return read.join(offsets, "shard").select(
        "doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids"
    )


def _read(payloads: Iterator[pd.DataFrame], parts: bool) -> Iterator[pd.DataFrame]:
    """The documents that lie within a segment, or the parts of those that do not."""
    for batch in payloads:
        rows = zip(batch["shard"], batch["segment"], batch["segment_ids"], batch["payload"], batch["docs"])
        for shard, segment, held, payload, docs in rows:
            begin = segment * SEGMENT_IDS
            places = [(doc, doc["first"] - begin, doc["first"] - begin + doc["ids"]) for doc in docs]
            found = [(doc, max(low, 0), min(high, held)) for doc, low, high in places if (low < 0 or high > held) == parts]
            if not found:
                continue
            # the first and last document may be far apart where only parts are wanted
            runs = [[piece] for piece in found] if parts else [found]
            data = [ids for run in runs for ids in _slices(payload, [(low, high) for _, low, high in run])]
            yield pd.DataFrame(
                {
                    "shard": [shard] * len(found),
                    "doc_id": pd.array([doc["doc_id"] for doc, _, _ in found], "Int64"),
                    "first": [doc["first"] for doc, _, _ in found],
                    "n_tokens": [doc["ids"] for doc, _, _ in found],
                    "segment": [segment] * len(found),
                    "ids": data,
                }
            )


def _slices(payload: bytes, places: list[tuple[int, int]]) -> list[bytes]:
    """Ids between ascending places of a segment; only the blocks from the first to the last are decoded."""
    first_block = places[0][0] // BLOCK
    ids, at = unpack_segment(payload, first_block, -(-places[-1][1] // BLOCK)), first_block * BLOCK
    return [ids[low - at : high - at].tobytes() for low, high in places]


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _read(batches, parts=False)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _read(batches, parts=True)


@register()
def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as a token file and read back from it, as digests."""
    vocabulary = public_tokenizers.path(VOCABULARY_FILE)
    documents = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-file")
    write_token_file(documents, path, vocabulary)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
