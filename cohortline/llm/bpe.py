"""Byte-level BPE: encoding over an Aho-Corasick automaton with backtracking, and decoding."""

from __future__ import annotations

import base64
import gc
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm.common import table
from cohortline.llm.registry import register

RANKS_FILE = "byte_bpe_multi_50k.tiktoken"
#: White space as the split pattern knows it (Unicode's White_Space property).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of the Latin blocks; words of others take the general way.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"
#: No match of the split pattern crosses the border of such a chunk: a word before a gap, comma
#: or full stop, else what stands between gaps, else a gap.
CHUNKS = re.compile(f" ?[{LATIN}]++(?=[{SPACE},.]|\\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Such a chunk is one match of the pattern.
ONE_WORD = regex.compile(r" ?\p{L}+")
#: Bounds of what an encoder remembers: two generations of chunks, and pairs.
REMEMBERED_CHUNKS = 300_000
REMEMBERED_PAIRS = 1_000_000
LONGEST_REMEMBERED = 48


class BytePairEncoder:
    """Encoding and decoding with the ranks of a byte-level BPE vocabulary.

    The vocabulary's tokens, bytes mapped to Latin-1 characters, form an Aho-Corasick
    automaton. A piece is encoded from left to right: take the longest token that starts
    here, if it may stand next to the token before it (merging their joint text by rank
    leaves just these two) and if its end was not found to lead nowhere; otherwise try the
    next shorter one, and where none is left, go back by one token and mark the place. A
    prefix has only one sequence of compatible neighbours, so no place is tried twice and
    the work is linear in the piece. Compatibility of a pair is remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.texts = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.texts[rank] = token
        self.lengths = [len(token) for token in self.texts]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.texts))]
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            parts = self._merged_to_two(token)
            if len(parts) > 2:
                continue  # merging never gives this token: it stands only for a whole piece
            self.halves[rank] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = [self._longest_proper_prefix(token) for token in self.texts]
        self._pairs: dict[tuple[int, int], bool] = {}
        self._chunks: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _merged_to_two(self, token: bytes) -> list[bytes]:
        """The parts of a token before its last merge, lowest rank first."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            lowest = min(joined)
            if lowest == 1 << 60:
                break
            at = joined.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _longest_proper_prefix(self, token: bytes) -> int:
        """The next shorter token that starts a token; -1 where there is none."""
        for size in range(len(token) - 1, 0, -1):
            rank = self.ranks.get(token[:size])
            if rank in self.halves:
                return rank
        return -1

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two tokens by rank leaves just these two."""
        pair = (left, right)
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= REMEMBERED_PAIRS:
                self._pairs.clear()
            known = self._pairs[pair] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo merges on both sides of the border, latest first.

        The tokens fall apart if a merge across the border was possible before the merge
        undone last; of equal ranks the one further left came first.
        """
        undone = 1 << 60
        while True:
            across = self.ranks.get(self.texts[left] + self.texts[right])
            if across is not None and across < undone:
                return False
            if left > right:
                undone, halves = left, self.halves[left]
                if halves is None:
                    return True
                left = halves[1]
            else:
                undone, halves = right + 1, self.halves[right]
                if halves is None:
                    return True
                right = halves[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        letters = piece.decode("latin-1")
        tokens = [token for _, token in self.automaton.iter_long(letters)]
        known = self._pairs.get
        for at, pair in enumerate(zip(tokens, tokens[1:]), 1):
            verdict = known(pair)
            if not (self.compatible(*pair) if verdict is None else verdict):
                return self._backtrack(letters, tokens[:at], self.shorter[tokens[at]])
        return tokens

    def _backtrack(self, letters: str, tokens: list[int], token: int) -> list[int]:
        """The encoding of a piece; the given tokens fit together, ``token`` is to be tried next."""
        size, lengths, shorter = len(letters), self.lengths, self.shorter
        longest, known = self.automaton.iter_long, self._pairs.get
        at = sum([lengths[t] for t in tokens])
        dead: set[int] = set()
        while True:
            if token < 0:
                if not tokens:
                    raise ValueError("a byte of the piece is not in the vocabulary")
                dead.add(at)
                token = tokens.pop()
                at -= lengths[token]
                token = shorter[token]
                continue
            end = at + lengths[token]
            if end not in dead:
                verdict = True
                if tokens:
                    verdict = known((tokens[-1], token))
                    if verdict is None:
                        verdict = self.compatible(tokens[-1], token)
                if verdict:
                    tokens.append(token)
                    if end == size:
                        return tokens
                    at = end
                    token = next(longest(letters, at))[1]
                    continue
            token = shorter[token]

    def _encode_chunk(self, chunk: str) -> bytes:
        packed = self._older.get(chunk)
        if packed is not None:
            self._remember(chunk, packed)
            return packed
        one_word = chunk.lstrip(" ").isalpha() if chunk.isascii() else ONE_WORD.fullmatch(chunk)
        if one_word:
            packed = b"".join([self.packed[i] for i in self.encode_piece(chunk.encode())])
        else:
            pieces = [match.group() for match in self.pattern.finditer(chunk)]
            known = self._chunks.get
            packed = b"".join(
                [
                    known(piece) or b"".join([self.packed[i] for i in self.encode_piece(piece.encode())])
                    for piece in pieces
                ]
            )
        self._remember(chunk, packed)
        return packed

    def _remember(self, chunk: str, packed: bytes) -> None:
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self._chunks) >= REMEMBERED_CHUNKS:
                self._older, self._chunks = self._chunks, {}
            self._chunks[chunk] = packed

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join([self._chunks.get(chunk) or self._encode_chunk(chunk) for chunk in CHUNKS.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> BytePairEncoder:
    """The encoder of a rank file (base64 token and rank per line), built once per process."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    made = BytePairEncoder(ranks, pattern)
    gc.freeze()  # the vocabulary stays: spare the collector from walking it
    return made


def encoded(text: Column, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Token ids of a text column, as binary: little-endian unsigned 32-bit integers.

    The text is split by the pattern, each match is encoded on its own, without special
    tokens. A null text counts as empty; an empty text has no ids. The rank file must be
    installed under the same path on every machine.
    """

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        own = encoder(ranks_path, pattern)
        return texts.map(lambda text: own.encode(text or ""))

    return encode(text)


def decoded(ids: Column, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes that a binary column of ids stands for; null ids count as none."""

    @F.pandas_udf("binary")
    def decode(values: pd.Series) -> pd.Series:
        own = encoder(ranks_path, pattern)
        return values.map(lambda value: own.decode(value or b""))

    return decode(ids)


@register()
def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    path = public_tokenizers.path(RANKS_FILE)
    documents = table(spark, sf_dir, "documents")
    ids = documents.select("doc_id", encoded(F.col("text"), path).alias("ids"))
    both = ids.withColumn("decoded", decoded(F.col("ids"), path))
    return both.select(
        "doc_id",
        F.expr("bigint(octet_length(ids) div 4)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def token_table(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids`` of documents; ids as in ``encoded``."""
    ids = docs.select("doc_id", "source", encoded(F.col("text"), ranks_path).alias("ids"))
    return ids.withColumn("n_tokens", F.expr("bigint(octet_length(ids) div 4)"))
