"""Joins of spans that overlap, and of rows with the state that held at their time.

``overlaps`` deals the spans of both sides into bins of a fixed width, so that one key with any
number of spans is many groups, and joins bin by bin: an equi-join, with the overlap as the rest of the
condition. A pair that shares several bins comes out in the bin where the later of the two
starts, and nowhere else, so nothing is made twice and nothing has to be made distinct.

``as_of`` gives each row of the left side the last row of the right side that is not later, by one union of
both sides and a running value in order of time; no row is compared with another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = 8192) -> DataFrame:
    """The pairs of rows with equal keys and ``right.end > left.start and right.start < left.end``; all columns of both, the keys once.

    Ends lie behind the last place of a span. A span longer than the width is written to each of
    its bins, so the width should not be much less than the usual span. Rows with null keys, starts or ends meet none. Column
    names of the two sides differ, but for the keys.
    """

    def binned(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        first, last = (F.floor(c / width) for c in (F.col(span[0]), F.greatest(F.col(span[0]), F.col(span[1]) - 1)))
        return df.withColumn("_bin", F.explode(F.sequence(first, last)))

    met = binned(left, left_span).join(binned(right, right_span), [*keys, "_bin"])
    (a, b), (c, d) = left_span, right_span
    later = F.floor(F.greatest(F.col(a), F.col(c)) / width)
    return met.where((F.col(d) > F.col(a)) & (F.col(c) < F.col(b)) & (F.col("_bin") == later)).drop("_bin")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """The rows of ``left`` with ``values`` of the last row of ``right`` of the same keys whose time is not after theirs; nulls if there is none.

    Keys may be null and are then equal. Of right rows of one time the one with the greatest values counts. Rows of either side without a time meet
    none. Rows of one key are in one group, sorted by time; its running value holds one row at a time.
    """
    carried = F.struct(*[F.col(v) for v in values])
    known = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), carried.alias("_v"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"), F.lit(0).alias("_side"))
    asked = left.select(*keys, F.col(left_time).alias("_t"), F.lit(None).cast(known.schema["_v"].dataType).alias("_v"), F.struct("*").alias("_row"), F.lit(1).alias("_side"))
    # at one time the right rows come first, so that a left row sees them; a null time comes before all
    so_far = Window.partitionBy(*keys).orderBy(F.col("_t").asc_nulls_first(), "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = known.unionByName(asked).withColumn("_last", F.last("_v", ignorenulls=True).over(so_far)).where("_side = 1")
    return rows.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])
