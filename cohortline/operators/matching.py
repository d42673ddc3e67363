"""Inner joins that account for the rows they lose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohortline.functions import column

LEFT, RIGHT = "_in_left", "_in_right"


def _sides() -> dict[str, Column]:
    left, right = F.col(LEFT).isNotNull(), F.col(RIGHT).isNotNull()
    return {"matched": left & right, "only_left": left & ~right, "only_right": right & ~left}


def _both(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.withColumn(LEFT, F.lit(True)).join(right.withColumn(RIGHT, F.lit(True)), list(keys), "full_outer")


def accounted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "join") -> tuple[DataFrame, Observation]:
    """The inner join on the keys, and an observation of what it keeps and loses.

    Once the rows have been computed, ``observation.get`` holds ``matched`` rows of the result and rows of
    ``only_left`` and ``only_right`` that have no partner; they are counted in the same pass. A missing key has
    no partner.
    """
    observation = Observation(name)
    counts = [F.count_if(side).alias(to) for to, side in _sides().items()]
    observed = _both(left, right, keys).observe(observation, *counts)
    return observed.filter(_sides()["matched"]).drop(LEFT, RIGHT), observation


def match_losses(left: DataFrame, right: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Rows ``matched``, ``only_left`` and ``only_right`` for each value of one key column.

    A name that is written in another way on either side shows as rows of one side only. Each side is
    first counted by its keys, so neither a frequent key nor a name with many rows is joined row by row.
    """
    sides = []
    for df, to in ((left, LEFT), (right, RIGHT)):
        sides.append(df.groupBy(*[column(k) for k in keys]).agg(F.count(F.lit(1)).alias(to)))
    both = sides[0].join(sides[1], list(keys), "full_outer")
    n_left, n_right = F.coalesce(F.col(LEFT), F.lit(0)), F.coalesce(F.col(RIGHT), F.lit(0))
    return both.groupBy(column(by)).agg(
        F.sum(n_left * n_right).alias("matched"),
        F.sum(F.when(n_right == 0, n_left).otherwise(0)).alias("only_left"),
        F.sum(F.when(n_left == 0, n_right).otherwise(0)).alias("only_right"),
    )
