"""Mixing sources to target weights, cut at each source's exact budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.llm.common import columns_of, table, unused, written
from cohortline.llm.registry import register

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
ROWS_PER_RANGE = 1_000


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``source, source_size`` (one row per source).

    Sources by code point, null last, take the weights in turn. Targets share the sum of all
    sizes by weight; none exceeds ``most_epochs`` times its source's size, and the excess is
    shared again by weight among the others. The sources that end at their limit are those
    with the smallest limits for their weight: in this order, the first source that does not
    need its whole limit fixes the level for itself and all after it.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    limit = (F.col("source_size") * most_epochs).alias("limit")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    weighed = sources.select("source", "source_size", weight.alias("weight"), limit)
    by_need = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_need.rowsBetween(W.unboundedPreceding, -1), by_need.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    shared = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))).alias("rest"),
        F.sum("weight").over(after).alias("rest_weight"),
        F.row_number().over(by_need).alias("place"),
    )
    fits = F.col("limit") * F.col("rest_weight") >= F.col("rest") * F.col("weight")
    level = F.min(F.when(fits, F.struct("place", "rest", "rest_weight"))).over(everything)
    shared = shared.withColumn("level", level)
    share = (F.col("level.rest") * F.col("weight")).cast("double") / F.col("level.rest_weight")
    target = F.when(F.col("place") < F.col("level.place"), F.col("limit").cast("double")).otherwise(share)
    return shared.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """``id, source, size, source_size, target, taken`` per row: how many words the mix takes of each document.

    A document's size is its number of words (a null text has none). Every document has a
    random key, the hash of its id, and the words of a source stand in the order of the keys;
    the mix takes the first ``target`` of them, rounded down, starting again where it reaches
    the end. Only the document at the cut is taken in part. Equal keys (repeated or null ids)
    are ordered by size. Reruns give the same mix.

    A source is not sorted in one task: as keys are uniform, ranges of keys hold about as many
    rows each. Sums per range give each range's offset, and running sums stay within a range.
    No words at all give targets of 0; an empty table gives an empty result.
    """
    key = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
    )
    rows = written(rows, "sizes")
    totals = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    targets = source_targets(totals.select("source", "source_size"), weights, most_epochs)
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n") / ROWS_PER_RANGE)).alias("ranges")
    plan = targets.withColumnRenamed("source", "of").join(
        totals.select(F.col("source").alias("named"), ranges), F.expr("of <=> named")
    )
    plan = written(plan.drop("named"), "targets")

    # the first 12 hex digits of a key, as a share of all, number its range
    share = F.conv(F.substring("key", 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    placed = rows.join(plan, F.expr("source <=> of")).withColumn("range", F.floor(share * F.col("ranges")))
    sums = placed.groupBy("of", "range").agg(F.sum("size").alias("range_size"))
    by_range = W.partitionBy("of").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("range_size").over(by_range), F.lit(0))
    offsets = sums.select(F.col("of").alias("at"), F.col("range").alias("at_range"), offset.alias("offset"))
    within = W.partitionBy("of", "range").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    summed = summed.join(offsets, F.expr("of <=> at AND range = at_range"))
    budget = F.floor(F.col("target"))
    epochs = F.expr("floor(target) div nullif(source_size, 0)")
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inside")
    last = F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    taken = F.coalesce(epochs * F.col("size") + last, F.lit(0)).cast("long")
    return summed.select("id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The documents of the mix: a row per whole copy taken, and one for the part at a cut.

    The part is the text up to its last taken word; n_chars follows the text. Documents of
    which no word is taken leave. Columns are those of the documents. Rows with the same
    doc_id are told apart by size.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    names = unused(docs, "_nth", "_id", "_size", "_taken", "_mixed_nth", "_copy", "_words")
    nth, mixed_id, mixed_size, mixed_taken, mixed_nth, copy, left = names
    numbered = docs.withColumn(nth, F.row_number().over(W.partitionBy("doc_id").orderBy(size)))
    taken = mix(docs, weights=weights, most_epochs=most_epochs).select(
        F.col("id").alias(mixed_id),
        F.col("size").alias(mixed_size),
        F.col("taken").alias(mixed_taken),
        F.row_number().over(W.partitionBy("id").orderBy("size")).alias(mixed_nth),
    )
    both = numbered.join(taken, F.expr(f"doc_id <=> {mixed_id} AND {nth} = {mixed_nth}")).where(F.col(mixed_taken) > 0)
    times = F.ceil(F.col(mixed_taken) / F.col(mixed_size)).cast("int")
    copies = both.withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
    words = F.least(F.col(mixed_taken) - (F.col(copy) - 1) * F.col(mixed_size), F.col(mixed_size))
    word = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    pieces = F.arrays_zip(F.split("text", WORD).alias("gap"), F.slice(word, 1, F.col(left).cast("int")).alias("word"))
    head = F.array_join(F.transform(pieces, lambda p: F.when(p["word"].isNull(), "").otherwise(F.concat(p["gap"], p["word"]))), "")
    text = F.when(F.col(left) < F.col(mixed_size), head).otherwise(F.col("text"))
    cut = copies.withColumn(left, words).withColumn("text", text)
    n_chars = F.when(F.col(left) < F.col(mixed_size), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(columns_of(docs))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM totals
), shared AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest_weight,
         row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place
  FROM weighed
), level AS (
  SELECT place AS first_open, rest AS level_rest, rest_weight AS level_weight FROM shared
  WHERE most * rest_weight >= rest * weight ORDER BY place LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN place < first_open THEN most::DOUBLE ELSE (level_rest * weight)::DOUBLE / level_weight END AS target
  FROM shared, level
), placed AS (
  SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       coalesce(floor(target)::BIGINT // nullif(source_size, 0) * size
         + least(greatest(floor(target)::BIGINT % nullif(source_size, 0) - before, 0), size), 0)::BIGINT AS taken
FROM placed
"""


@register(ORACLE)
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document so that sources meet their targets."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
