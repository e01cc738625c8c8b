"""Numbers in an order, without a task that sees all of a key's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.staging import fresh, staged

_ROW = (1 << 33) - 1


def ranked(rows: DataFrame, per: list[str], order: list, name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within each ``per`` by ``order`` (columns that tell its rows apart).

    Rows are dealt by ranges of (per, order), so a huge key spreads over many tasks. A row's place
    in its range, the sizes of earlier ranges and the place where its key begins give its number:
    only a row a range and a row a key meet in a join.
    """
    at, part, before, first = (fresh(rows, c) for c in ("at", "part", "before", "first_of_key"))
    by = [*(F.col(c) for c in per), *(F.col(c) if isinstance(c, str) else c for c in order)]
    laid = staged(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()), "ranked")
    laid = laid.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit(_ROW)))
    sizes = laid.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    # one row a range, as many as tasks
    earlier = sizes.select(part, F.coalesce(F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    placed = laid.join(F.broadcast(earlier), part).withColumn(at, F.col(at) + F.col(before)).drop(before, part)
    begin = placed.groupBy(*per).agg(F.min(at).alias(first))
    return placed.join(begin, per).withColumn(name, (F.col(at) - F.col(first) + 1).cast("int")).select(*rows.columns, name)
