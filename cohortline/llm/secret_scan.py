"""Secret scans: candidate spans, judged by how many owners and repositories share a value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm.common import columns_of, table, unused, written
from cohortline.llm.registry import register

#: More owners than this make a value a widely copied example.
MOST_OWNERS = 2
#: So do more repositories for each of its owners.
MOST_REPOSITORIES = 10
PLACEHOLDER = "<secret>"


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the secret value, and what a match must fulfil."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool = True
    needs: tuple[str, ...] = ()


# Fixed patterns. Hexadecimal and access runs are maximal, so their length may stand in the pattern.
KINDS = (
    Kind(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
    Kind("mixed", r"[A-Za-z0-9+/_-]{24,}", 0, 24, base=False, needs=("[0-9]", "[a-z]", "[A-Z]")),
)
SPAN = "struct<kind:int,start:int,end:int,value:string>"


def _spans(text: Column, number: int, kind: Kind) -> Column:
    """Spans of a kind, in order: offsets in code points, end exclusive.

    The gaps between matches and the matches themselves, in turn, make up the text, so their
    running lengths are the offsets.
    """
    pattern = F.lit(kind.pattern)
    pieces = F.arrays_zip(
        F.split(text, kind.pattern).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(kind.group)).alias("value"),
    )

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["match"]), F.lit(0))
        span = F.struct(F.lit(number).alias("kind"), start.alias("start"), end.alias("end"), piece["value"].alias("value"))
        good = F.coalesce(F.length(piece["value"]) >= kind.least, F.lit(False))
        for need in kind.needs:
            good = good & piece["value"].rlike(need)
        kept = F.when(good, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    none = F.array().cast(f"array<{SPAN}>")
    first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    found = F.aggregate(pieces, first, step, lambda state: state["spans"])
    return F.when(text.rlike(kind.pattern), found).otherwise(none)


def candidates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """``row, id, owner, key, found`` per row: all candidate spans of the whole text.

    ``row`` numbers the rows of the written table, ``key`` is the text's hash, ``found`` holds
    the spans in order of start, then kind. A null text counts as empty, a null owner as one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.array_sort(
        F.transform(
            F.concat(*[_spans(whole, number, kind) for number, kind in enumerate(KINDS)]),
            lambda span: F.struct(span["start"].alias("start"), span["kind"].alias("kind"), span["end"].alias("end"), span["value"].alias("value")),
        )
    )
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.sha2(whole.cast("binary"), 256).alias("key"),
        found.alias("found"),
    )
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "secret-candidates")


def judged(
    found: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES
) -> DataFrame:
    """``row, judged`` for rows with candidates: spans with ``owners``, ``repositories`` and ``live``.

    Over the whole corpus, the hash of every candidate value is counted by distinct owner and
    by distinct repository (here: document id). A value looks live that few owners hold, each in few
    repositories; one that many hold, or that stands all over one owner's repositories, is an example that
    people copy. Counting goes through partial aggregates, and a
    hash that a third of all rows share is split in the join by adaptive execution.
    """
    spans = found.select("row", "id", "owner", F.explode("found").alias("span"))
    spans = spans.withColumn("hash", F.sha2(F.col("span.value").cast("binary"), 256))
    places = spans.select("hash", "owner", "id").distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    shared = places.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    joined = spans.join(shared, "hash").select(
        "row",
        F.struct(
            "span.start", "span.kind", "span.end", F.length("span.value").alias("size"),
            "owners", "repositories", ((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories * F.col("owners"))).alias("live"),
        ).alias("span"),
    )
    return joined.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("judged"))


def _reported(span: Column) -> Column:
    """Base spans always; spans of other kinds only where the value looks live."""
    base = [number for number, kind in enumerate(KINDS) if kind.base]
    return span["kind"].isin(base) | span["live"]


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    texts = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(texts, ",")


def secret_spans(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    most_owners: int = MOST_OWNERS,
) -> DataFrame:
    """``id, spans`` per row: an array of start, kind, end, size of the value, owners, repositories, live.

    Repeated rows stay repeated; a text without secrets (empty, null) has an empty array. Spans
    of equal start are ordered by kind. Other columns are not read.
    """
    found = candidates(docs, id_column, text, owner)
    kept = judged(found, most_owners).select("row", F.filter("judged", _reported).alias("spans"))
    none = F.array().cast(kept.schema["spans"].dataType)
    return found.select("row", "id").join(kept, "row", "left").select("id", F.coalesce("spans", none).alias("spans"))


def redacted(docs: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """The documents, every reported secret value replaced by a placeholder; n_chars follows the text.

    All documents stay; texts without secrets stay as they are.
    """
    found = candidates(docs)
    key, hashed, reported = unused(docs, "_key", "_hashed", "_spans")
    spans = judged(found, most_owners).join(found.select("row", "key"), "row")
    by_text = spans.groupBy(F.col("key").alias(hashed)).agg(F.first(F.filter("judged", _reported)).alias(reported)).where(F.size(reported) > 0)
    keyed = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    both = keyed.join(by_text, F.col(key) == F.col(hashed), "left")
    text = F.col("text")

    def step(state: Column, span: Column) -> Column:
        start, at = span["end"] - span["size"], state["at"]
        before = F.concat(state["out"], F.substring(text, at + 1, start - at), F.lit(PLACEHOLDER))
        out = F.when(start >= at, before).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(at, span["end"]).alias("at"))

    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    by_value = F.array_sort(
        F.transform(reported, lambda s: F.struct((s["end"] - s["size"]).alias("start"), s["end"].alias("end"), s["size"].alias("size")))
    )
    clean = F.aggregate(
        by_value, first, step, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))
    )
    changed = both.withColumn("text", F.when(F.col(reported).isNotNull(), clean).otherwise(text))
    n_chars = F.when(F.col(reported).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", n_chars).select(columns_of(docs))


@register()
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    spans = secret_spans(table(spark, sf_dir, "documents"))

    def count(name: str) -> Column:
        number = [kind.name for kind in KINDS].index(name)
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin([n for n, kind in enumerate(KINDS) if kind.base]))
    return spans.select(
        F.col("id").alias("doc_id"),
        *[count(kind.name).alias(f"n_{kind.name}") for kind in KINDS if kind.base],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )
