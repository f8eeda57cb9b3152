"""Values carried along the lines of a file, without putting a whole file into one task.

A file is cut into segments: the block that one reading task took, and within it stretches of ``SEGMENT`` line numbers. Only a segment is sorted. Each
segment gives its last values, one small row; those of a file's segments are combined in order, and what the segments before have left
is joined to each segment's lines by the segment, on which they are dealt already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Line numbers (or places in bytes) of a segment.
SEGMENT = 1 << 20

_PLACE = ("file_path", "block_start", "_segment")


def _shifted(segments: DataFrame, names: list[str]) -> DataFrame:
    """For each segment of a file the last values that the segments before it hold, each by itself; rows without any are left out.

    A file's segments come as an array of ends: a file of a terabyte has some ten thousand.
    """
    ends = segments.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("block_start", "_segment", *names))).alias("ends")).filter(F.size("ends") > 1)
    kinds = {f.name: f.dataType for f in segments.schema}
    nothing = F.struct(*[F.lit(None).cast(kinds[n]).alias(n) for n in names])
    have = F.struct(F.array(nothing).alias("all"), nothing.alias("last"))

    def step(acc: Column, end: Column) -> Column:
        last = F.struct(*[F.coalesce(end[n], acc["last"][n]).alias(n) for n in names])
        return F.struct(F.concat(acc["all"], F.array(last)).alias("all"), last.alias("last"))

    before = F.aggregate("ends", have, step, lambda acc: acc["all"])
    rows = ends.select("file_path", F.posexplode(F.arrays_zip("ends", F.slice(before, F.lit(1), F.size("ends")).alias("before"))).alias("_n", "z"))
    return rows.filter("_n > 0").select("file_path", "z.ends.block_start", "z.ends._segment", *[F.col(f"z.before.{n}").alias(f"_before_{n}") for n in names])


def carried(lines: DataFrame, given: dict[str, Column], strict: tuple[str, ...] = (), segment: int = SEGMENT) -> DataFrame:
    """``lines`` with a column for each of ``given``: its last value that isn't null up to the line, or before it for names in ``strict``.

    Lines have file_path, block_start and line_id, the order within a file.
    """
    names = list(given)
    lines = lines.withColumn("_segment", F.floor(F.col("line_id") / segment)).withColumns({f"_own_{n}": c for n, c in given.items()})
    own = lambda n: F.col(f"_own_{n}")
    ends = lines.groupBy(*_PLACE).agg(*[F.max_by(own(n), F.when(own(n).isNotNull(), F.col("line_id"))).alias(n) for n in names])
    order = Window.partitionBy(*_PLACE).orderBy("line_id")
    until = lambda n: order.rowsBetween(Window.unboundedPreceding, -1 if n in strict else Window.currentRow)
    inside = lines.withColumns({f"_in_{n}": F.last(own(n), ignorenulls=True).over(until(n)) for n in names})
    out = inside.join(_shifted(ends, names), list(_PLACE), "left").withColumns({n: F.coalesce(f"_in_{n}", f"_before_{n}") for n in names})
    return out.drop("_segment", *[f"{x}{n}" for n in names for x in ("_own_", "_in_", "_before_")])
