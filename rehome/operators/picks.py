"""First matches, unions and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROW, TAG = "_row", "_tag"


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first n rows of each key.

    Spark keeps n rows of a key in every task before the shuffle (WindowGroupLimit), so a key
    with most of the rows sends n rows of each task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(ROW, F.row_number().over(window)).filter(F.col(ROW) <= n).drop(ROW)


def join_lookup(df: DataFrame, one: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join to a side that was reduced to one row for each key.

    Grouped by the same keys, that side would be joined as it lies, and adaptive execution splits
    a hot key of ``df`` only where both sides are freshly shuffled. A hash of the keys as one more
    join key brings about that shuffle, of the reduced side only.
    """
    tag = F.xxhash64(*keys)
    joined = df.withColumn(TAG, tag).join(one.withColumn(TAG, tag), [*keys, TAG], how)
    return joined.drop(TAG)


def union_frames(*frames: DataFrame) -> DataFrame:
    """Frames of different columns one below the other; what a frame lacks is NULL."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def split_by(df: DataFrame, column: str, values: list[str]) -> dict[str, DataFrame]:
    """Disjoint parts of one frame."""
    return {value: df.filter(F.col(column) == value) for value in values}
