"""Repeated passages: MinHash-banded paragraphs, and anchored windows for passages inside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.llm.common import SliceHash, slabs, table, word_bounds, written
from cohortline.llm.components import components
from cohortline.llm.minhash import SHINGLE_WORDS, SIMILARITY, band_keys, linked, shingle_runs
from cohortline.llm.registry import register
from cohortline.llm.screening import cells_for, paired, sketch

LEAST_WORDS = SHINGLE_WORDS
WINDOW_WORDS = 32
ANCHOR_WORDS = 4
ANCHOR_SPAN = 18
#: Rows of a band: fewer and shorter bands than for whole documents, for the same recall.
BAND_ROWS = 4
#: Hashes that a text may give, for the size of the sketch: one for so many characters.
CHARS_PER_HASH = 20
SLAB = 1 << 18
#: Bytes of band keys and windows that are screened at a time.
PART = 1 << 20
#: Edges between windows that a task holds at a time.
MOST_EDGES = 1 << 20
#: A sentence ends with one of these, whatever closes it.
SENTENCE_ENDS, CLOSERS = tuple(".!?:…。！？"), """"')]»”’*_"""


def paragraphs_of(text: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The words of a text, and first and end word of its paragraphs.

    Every line is a paragraph. So are lines joined up to a line that ends a sentence, and lines
    joined up to a blank one where the text has blank lines: lines of wrapped text say nothing by themselves.
    """
    words: list[bytes] = []
    lines, sentences, blocks = [], [], []
    sentence = block = 0
    blank = False
    for line in text.split("\n"):
        found = line.lower().encode().split()
        at = len(words)
        if not found:
            blank = blank or 0 < at
            sentences.append((sentence, at))
            blocks.append((block, at))
            sentence = block = at
            continue
        words += found
        lines.append((at, len(words)))
        if line.rstrip().rstrip(CLOSERS).endswith(SENTENCE_ENDS):
            sentences.append((sentence, len(words)))
            sentence = len(words)
    sentences.append((sentence, len(words)))
    blocks.append((block, len(words)))
    places = {*lines, *sentences, *(blocks if blank else [])}
    return words, sorted(place for place in places if place[0] < place[1])


def _parsed(
    texts: list[str], least_words: int, keys: bool = True, shingles: bool = True
) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Paragraphs of enough words with band keys and shingles (none below five words), and windows of words.

    A window starts at an anchor: the word whose four-word hash is the least among any
    ``ANCHOR_SPAN`` neighbouring ones. Anchors depend on the words around them alone, so a
    passage of 52 words or more holds the same whole window wherever it stands.
    """
    words, held, row, first, end = [], [], [], [], []
    for number, text in enumerate(texts):
        found, places = paragraphs_of(text)
        words += found
        held.append(len(found))
        for low, high in places:
            if high - low >= least_words:
                row.append(number)
                first.append(low)
                end.append(high)
    none = np.empty(0, np.int64)
    buffer = b" ".join(words)
    data = np.frombuffer(buffer, np.uint8)
    starts, ends = word_bounds(data)
    hashed = SliceHash(data)  # one for all texts: hashes of slices do not depend on where they stand
    held = np.array(held, np.int64)
    bases = np.cumsum(held) - held
    lines = pd.DataFrame({"row": np.array(row, np.int64), "first": np.array(first, np.int64), "end": np.array(end, np.int64)})
    counts = np.array(lines["end"] - lines["first"])
    begin = bases[lines["row"]] + lines["first"].to_numpy()
    cuts = zip(starts[begin].tolist(), ends[begin + counts - 1].tolist())
    lines["whole"] = np.array([xxhash.xxh64_intdigest(buffer[low:high]) for low, high in cuts], np.uint64)
    long = np.flatnonzero(counts >= SHINGLE_WORDS)
    sizes = counts[long] - SHINGLE_WORDS + 1
    at = np.cumsum(sizes) - sizes
    grams = hashed(starts[: 1 - SHINGLE_WORDS], ends[SHINGLE_WORDS - 1 :])
    hashes = grams[np.arange(sizes.sum()) + np.repeat(begin[long] - at, sizes)]
    anchors = _anchors(hashed(starts[: 1 - ANCHOR_WORDS], ends[ANCHOR_WORDS - 1 :]), held) if keys else none
    values = hashed(starts[anchors], ends[anchors + WINDOW_WORDS - 1]).view(np.int64)
    owner = np.repeat(np.arange(len(held)), held)[anchors]
    found_keys, found_shingles = [none] * len(lines), [none] * len(lines)
    if keys and len(long):
        for i, found in zip(long, band_keys(hashes, at, BAND_ROWS)):
            found_keys[i] = found
    if shingles:
        for i, low, high in zip(long, at, [*at[1:], len(hashes)]):
            found_shingles[i] = np.unique(hashes[low:high]).view(np.int64)
    lines["keys"] = pd.Series(found_keys, dtype=object)
    lines["shingles"] = pd.Series(found_shingles, dtype=object)
    return lines, pd.DataFrame({"row": owner, "first": anchors - bases[owner], "value": values})


def _anchors(grams: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Places among all words of texts that hold so many words each, at which windows start.

    The first least hash of each span that lies within one text, for all spans at once: spans of twice the length are
    put together from two, the last length from two that overlap.
    """
    least, place, length = grams, np.arange(len(grams)), 1
    while length < ANCHOR_SPAN:
        step = min(length, ANCHOR_SPAN - length)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        length += step
    ends = np.repeat(np.cumsum(held), held)
    long = np.repeat(held >= WINDOW_WORDS, held)
    spans = np.arange(len(place))
    inside = long[: len(place)] & (spans + ANCHOR_SPAN + ANCHOR_WORDS - 1 <= ends[: len(place)])
    anchors = np.unique(place[inside])
    return anchors[anchors + WINDOW_WORDS <= ends[anchors]]


#: A text's paragraphs and windows as packed numbers: places are first and end words, firsts the first words of windows.
TEXTS = "id long, body long, places binary, wholes binary, keys binary, firsts binary, windows binary"
PARSED = "id long, body long, kind string, first int, end int, value long, keys array<long>"


def _slabs(batch: pd.DataFrame | pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    texts = batch["text"].tolist() if isinstance(batch, pd.DataFrame) else batch.column("text").to_pylist()
    for start, stop in slabs(map(len, texts), SLAB):
        yield start, stop, texts[start:stop]


def _bodies(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)


def _packed(numbers: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """Numbers of each of so many rows, as binary; the numbers are in the order of their rows."""
    cuts = np.searchsorted(row, np.arange(rows + 1)).tolist()
    return pa.array([numbers[low:high].tobytes() for low, high in zip(cuts, cuts[1:])], pa.binary())


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and the row of each."""
    values = column.to_pylist()
    sizes = np.array([len(v) for v in values], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(values), kind), np.repeat(np.arange(len(values)), sizes)


def _parse(least_words: int):
    """Rows of ``TEXTS``: texts are parsed once, before what occurs once is known."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in _slabs(batch):
                lines, windows = _parsed(texts, least_words, shingles=False)
                row, keys, count = lines["row"].to_numpy(), lines["keys"].to_numpy(), len(texts)
                places = lines[["first", "end"]].to_numpy(np.int32)
                flat = np.concatenate([np.empty(0, np.int64), *keys]).astype(np.int64)
                of_key = np.repeat(row, np.array([len(k) for k in keys], np.int64))
                at = windows["row"].to_numpy()
                columns = [
                    batch.column("id").slice(start, count),
                    pa.array(_bodies(texts)),
                    _packed(places, row, count),
                    _packed(lines["whole"].to_numpy(np.uint64).view(np.int64), row, count),
                    _packed(flat, of_key, count),
                    _packed(windows["first"].to_numpy(np.int32), at, count),
                    _packed(windows["value"].to_numpy(np.int64), at, count),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "body", "places", "wholes", "keys", "firsts", "windows"])

    return parse


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of ``TEXTS`` whose band keys and windows have a bounded size, or one row."""
    held = zip(batch.column("keys").to_pylist(), batch.column("windows").to_pylist())
    for start, stop in slabs((len(keys) + len(windows) + 1 for keys, windows in held), PART):
        yield batch.slice(start, stop - start)


def _hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Band keys of the distinct paragraphs of some texts and window values, for the sketch.

    A paragraph that stands several times counts once in them; if it stands nowhere else, its equals
    are found by their value all the same.
    """
    for part in _parts(batch):
        places, _ = _unpacked(part.column("places"), "<i4")
        wholes, _ = _unpacked(part.column("wholes"), "<i8")
        keys, _ = _unpacked(part.column("keys"), "<i8")
        long = wholes[np.diff(places.reshape(-1, 2)).ravel() >= SHINGLE_WORDS]
        once = np.unique(long, return_index=True)[1]
        yield paired(keys.reshape(len(long), -1)[once].ravel() if len(long) else keys)
        yield paired(_unpacked(part.column("windows"), "<i8")[0])


def _screen(single: Callable[[np.ndarray], np.ndarray]):
    """Rows of paragraphs, with the band keys that other paragraphs may share, and of windows that may occur again."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                ids, bodies = part.column("id").to_numpy(), part.column("body").to_numpy()
                places = _unpacked(part.column("places"), "<i4")[0].reshape(-1, 2)
                wholes, row = _unpacked(part.column("wholes"), "<i8")
                keys, _ = _unpacked(part.column("keys"), "<i8")
                long = places[:, 1] - places[:, 0] >= SHINGLE_WORDS
                owner = np.repeat(np.flatnonzero(long), len(keys) // max(long.sum(), 1))
                again = ~single(paired(keys))
                ends = np.cumsum(np.bincount(owner[again], minlength=len(wholes)))
                met = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(keys[again]))
                yield _rows("paragraph", ids[row], bodies[row], places[:, 0], places[:, 1], wholes, met)
                values, row = _unpacked(part.column("windows"), "<i8")
                firsts, _ = _unpacked(part.column("firsts"), "<i4")
                again = ~single(paired(values))
                values, row, firsts = values[again], row[again], firsts[again]
                none = pa.nulls(len(values), pa.list_(pa.int64()))
                yield _rows("window", ids[row], bodies[row], firsts, firsts + np.int32(WINDOW_WORDS), values, none)

    return screen


def _rows(kind: str, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    ids, bodies, *others = (c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns)
    names = ["id", "body", "kind", "first", "end", "value", "keys"]
    return pa.RecordBatch.from_arrays([ids, bodies, pa.array([kind] * len(ids), pa.string()), *others], names=names)


def _shingles(least_words: int, wanted_text: Callable[[np.ndarray], np.ndarray], seen: Callable[[np.ndarray], np.ndarray]):
    """Shingles of the distinct paragraphs of a slab whose value, and text, may be among the wanted ones."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, _, texts in _slabs(batch):
                joined = {}
                for i in np.flatnonzero(wanted_text(paired(_bodies(texts)))):
                    words, places = paragraphs_of(texts[i])
                    for low, high in places:
                        if high - low >= max(least_words, SHINGLE_WORDS):
                            part = b" ".join(words[low:high])
                            joined[xxhash.xxh64_intdigest(part)] = part, high - low
                values = np.array(list(joined), np.uint64).view(np.int64)
                wanted = np.flatnonzero(seen(paired(values))) if len(values) else values
                if len(wanted):
                    parts = list(joined.values())
                    parts = [parts[i] for i in wanted]
                    hashes, at = shingle_runs([part for part, _ in parts], np.array([n for _, n in parts]))
                    sets = [np.unique(x).view(np.int64) for x in np.split(hashes, at[1:])]
                    yield pd.DataFrame({"value": values[wanted], "shingles": pd.Series(sets, dtype=object).array})

    return shingles


def similar_paragraphs(paragraphs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges ``a, b`` that connect distinct paragraphs (``value, keys, shingles``) of enough Jaccard similarity."""
    sets = paragraphs.select("value", "shingles")
    return linked(paragraphs, lambda values: sets.join(values, "value", "left_semi"), similarity)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of windows (``id, body, first, value, keeper``, in this order of texts and places) at most their length apart.

    Only pairs of different windows of one keeper are given. What is kept from one batch to the next is what
    lies so near to its last window.
    """
    names = ["id", "body", "first", "value", "keeper"]
    kept = None
    for batch in batches:
        rows = [batch.column(name).to_numpy() for name in names]
        old = 0
        if kept is not None:
            old, rows = len(kept[0]), [np.concatenate(both) for both in zip(kept, rows)]
        ids, bodies, first, value, keeper = rows
        if not len(ids):
            continue
        for step in range(1, len(ids)):
            apart = first[step:] - first[:-step]
            near = (ids[step:] == ids[:-step]) & (bodies[step:] == bodies[:-step]) & (apart <= WINDOW_WORDS)
            if not near.any():
                break
            near &= (apart > 0) & (keeper[step:] == keeper[:-step]) & (value[step:] != value[:-step])
            one = np.flatnonzero(near[max(old - step, 0) :]) + max(old - step, 0)
            if len(one):
                found = value[one], value[one + step], apart[one], keeper[one], ids[one]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "apart", "keeper", "id"])
        last = (ids == ids[-1]) & (bodies == bodies[-1]) & (first >= first[-1] - WINDOW_WORDS)
        kept = [x[last] for x in rows]


def _window_links(repeated: DataFrame) -> DataFrame:
    """Edges ``keeper, a, b`` between repeated windows (``id, body, first, value, keeper``) of one passage.

    Two windows at most their length apart are linked if their keeper is the same document and holds them at the
    same distance too. So the keeper of a cluster holds all its windows, one after the other: passages
    that only stand next to each other in some document have keepers, or distances, of their own.
    """
    place = ["id", "body", "first"]
    ordered = repeated.select(*place, "value", "keeper").repartition("id", "body").sortWithinPartitions(*place)
    pairs = ordered.mapInArrow(_neighbours, "a long, b long, apart int, keeper long, id long")
    held = pairs.groupBy("a", "b", "apart", "keeper").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    return held.where("low = keeper AND low < high").select("keeper", "a", "b")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that edges connect to a smaller one, and the smallest node that each is connected to."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[one], label[two]), np.maximum(label[one], label[two])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    led = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[led], nodes[label[led]]


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clusters of edges ``keeper, a, b`` in the order of keepers, as ``node, component, open``.

    A window has one keeper, so no cluster runs over several. The edges of a keeper that has more than
    ``MOST_EDGES`` are taken in parts: what these connect stays open.
    """
    parts, held, cut = [], 0, None

    def taken(keeper: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        again = keeper == cut if cut is not None else np.zeros(len(keeper), bool)
        for some, is_open in ((~again, False), (again, True)):
            nodes, least = _stars(a[some], b[some])
            if len(nodes):
                flags = np.full(len(nodes), is_open)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes, least, flags)], names=["node", "component", "open"])

    for batch in batches:
        parts.append([batch.column(name).to_numpy() for name in ("keeper", "a", "b")])
        held += len(batch)
        if held > MOST_EDGES:
            keeper, a, b = (np.concatenate(x) for x in zip(*parts))
            end = int(np.searchsorted(keeper, keeper[-1]))
            if not end:
                cut, end = keeper[-1], held
            yield from taken(keeper[:end], a[:end], b[:end])
            parts, held = [[keeper[end:], a[end:], b[end:]]], held - end
    if held:
        yield from taken(*(np.concatenate(x) for x in zip(*parts)))


def _window_clusters(repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, component`` of the windows whose cluster has a smaller one, and edges ``a, b`` that are still to be connected."""
    links = _window_links(repeated).repartition("keeper").sortWithinPartitions("keeper")
    found = written(links.mapInArrow(_clusters, "node long, component long, open boolean"), "window-clusters")
    still = found.where("open").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return found.where("NOT open").select("node", "component"), still


def repeated_passages(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``id, cluster_id, first_word, end_word, kept``: a row per document and contiguous span that other documents share.

    Paragraphs (``paragraphs_of``) of ``least_words`` words or more are linked from a Jaccard similarity
    ``similarity`` over five-word shingles on, shorter ones than a shingle where they are equal. Passages inside longer paragraphs, which
    no paragraph measure sees, are found as equal windows of 32 words at content-chosen places:
    any passage of 52 words or more that stands in two documents holds one. Windows are linked where the
    document that keeps them holds both in the same distance. Clusters are the connected components; the
    smallest id keeps the passage (``kept``) and, for windows, holds all of it. Places of a cluster in a document that
    overlap or touch are one span. A count-min sketch, 64 MB at the most, proves most band keys and windows to occur once; these
    have no partner and are not written or shuffled (if it is too small for the data, fewer are found, and nothing else changes). Spans of different clusters may overlap: words under a kept span stay. Words are compared in
    lower case (A-Z and beyond), split at ASCII white space. Null ids and null, empty or short
    texts have no rows; rows with the same id are one document, spans count the words of each row's text.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.where("id IS NOT NULL")
    broadcast = rows.sparkSession.sparkContext.broadcast
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    texts = written(rows.mapInArrow(_parse(least_words), TEXTS), "parsed-texts")
    counted = broadcast(sketch(texts, cells_for(size // CHARS_PER_HASH), _hashes))
    parsed = written(texts.mapInArrow(_screen(lambda hashes: counted.value.single(hashes)), PARSED), "passages")
    counted.destroy()
    place = ["id", "body", "first", "end", "value"]
    lines = parsed.where("kind = 'paragraph'")
    met = lines.where("size(keys) > 0")
    # where a paragraph stands in several texts, its shingles are taken from one
    distinct = written(met.groupBy("value").agg(F.first("keys").alias("keys"), F.min_by("body", "id").alias("body")), "paragraphs")

    def shingles_of(values: DataFrame) -> DataFrame:
        chosen = distinct.join(values, "value", "left_semi").select("value", "body")
        cells = cells_for(chosen.count())
        bodies, wanted = broadcast(sketch(chosen.select("body"), cells)), broadcast(sketch(chosen.select("value"), cells))
        shingles = _shingles(least_words, lambda hashes: bodies.value.seen(hashes), lambda hashes: wanted.value.seen(hashes))
        some = rows.mapInPandas(shingles, "value long, shingles array<long>")
        return some.join(values, "value", "left_semi").groupBy("value").agg(F.first("shingles").alias("shingles"))

    near = linked(distinct.select("value", "keys"), shingles_of, similarity)
    windows = parsed.where("kind = 'window'").select(place)
    shared = windows.groupBy("value").agg(F.min("id").alias("keeper"), F.max("id").alias("high")).where("keeper < high")
    repeated = written(windows.join(shared.select("value", "keeper"), "value").distinct(), "repeated-windows")
    clusters, still = _window_clusters(repeated)
    edges = written(near.select("a", "b").unionByName(still), "passage-links")
    groups = written(components(edges).unionByName(clusters), "passage-groups").withColumnRenamed("node", "value")
    # a cluster of several paragraphs, or one paragraph that stands in several documents
    held = lines.groupBy("value").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    named = held.join(groups, "value", "left").where("component IS NOT NULL OR low < high")
    named = named.select("value", "low", "high", F.coalesce("component", "value").alias("cluster_id"))
    named = written(named, "paragraphs-met")
    keepers = named.groupBy("cluster_id").agg(F.min("low").alias("keeper"), F.max("high").alias("last")).where("keeper < last")
    kept_values = written(named.join(keepers, "cluster_id").select("value", "cluster_id", "keeper"), "paragraph-clusters")
    places = lines.select(place).join(kept_values, "value").distinct().unionByName(
        repeated.join(groups, "value", "left").select(
            *place, F.coalesce("component", "value").alias("cluster_id"), "keeper"
        )
    )
    inside = W.partitionBy("cluster_id", "id", "body").orderBy("first", "end")
    before = F.max("end").over(inside.rowsBetween(W.unboundedPreceding, -1))
    begins = places.withColumn("begins", (before.isNull() | (F.col("first") > before)).cast("int"))
    spans = begins.withColumn("span", F.sum("begins").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return spans.groupBy("cluster_id", "id", "body", "span", "keeper").agg(
        F.min("first").alias("first_word"), F.max("end").alias("end_word")
    ).select("id", "cluster_id", "first_word", "end_word", (F.col("id") == F.col("keeper")).alias("kept"))


@register()
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share; also lines of fewer words than a shingle, where they are equal."""
    return repeated_passages(table(spark, sf_dir, "documents"), least_words=1).withColumnRenamed("id", "doc_id")
