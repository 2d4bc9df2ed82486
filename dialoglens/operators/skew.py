"""Work on groups that may hold a large part of all rows.

Aggregates combine before the shuffle and need none of this. It serves the two
things that do not: collecting a group in order, and numbering rows globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoglens.session import materialize

PART_SIZE = 10_000
MAX_BROADCAST_KEYS = 100_000
MAX_CONFIG_ROWS = 10_000


def small_side(df: DataFrame, max_rows: int = MAX_CONFIG_ROWS) -> DataFrame:
    """Broadcast hint for configuration tables, only where the row count proves it safe.

    Larger frames are returned as they are and joined by shuffle.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def config_rows(df: DataFrame, max_rows: int = MAX_CONFIG_ROWS) -> list:
    """Rows of a configuration table that become part of the plan; refuses larger ones."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"configuration table has more than {max_rows} rows")
    return rows


def collect_in_parts(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    item: Column,
    part_size: int = PART_SIZE,
    max_broadcast_keys: int = MAX_BROADCAST_KEYS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Ordered lists per key: `keys, part, parts, items`.

    A key with at most `part_size` rows gives one row. A hot key gives several, numbered
    in order, whose lists joined are its whole list, so no task ever holds all of it.
    `counts` are the rows of each key (`keys, _n`) where they are known; else `df` is read for them.
    """
    rows = df.select(*keys, F.struct(*order, item.alias("item")).alias("_row"))
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > part_size).select(*keys, F.lit(True).alias("_hot"))
    hot_keys = hot.limit(max_broadcast_keys + 1).count()

    if hot_keys == 0:
        return _whole_lists(rows, keys, order)
    if hot_keys > max_broadcast_keys:
        return _sliced_lists(rows, keys, part_size)
    flagged = _attach(rows, F.broadcast(hot), keys, ["_hot"], "left")
    cold = flagged.filter(F.col("_hot").isNull()).drop("_hot")
    spread = flagged.filter(F.col("_hot")).drop("_hot")
    return _whole_lists(cold, keys, order).unionByName(_sliced_lists(spread, keys, part_size))


def _attach(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], how: str) -> DataFrame:
    """Add `columns` of `right`, both frames coming from the same rows; NULL keys match."""
    renamed = {k: f"_right_{k}" for k in keys}
    side = right.select(*[F.col(k).alias(r) for k, r in renamed.items()], *columns)
    same = [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]
    return left.join(side, same, how).drop(*renamed.values())


def _whole_lists(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    ordered = F.sort_array(F.collect_list("_row"))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda r: r["item"]).alias("items")).select(
        *keys, F.lit(1).alias("part"), F.lit(1).alias("parts"), "items"
    )


def _sliced_lists(rows: DataFrame, keys: list[str], part_size: int) -> DataFrame:
    """Range partitions cut a hot key into ordered slices, each slice into chunks."""
    placed = rows.repartitionByRange(*keys, "_row").withColumn("_pid", F.spark_partition_id())
    placed = materialize(placed, "slices")
    local = Window.partitionBy(*keys, "_pid").orderBy("_row")
    chunked = placed.withColumn("_chunk", F.floor((F.row_number().over(local) - 1) / part_size))
    lists = chunked.groupBy(*keys, "_pid", "_chunk").agg(
        F.transform(F.sort_array(F.collect_list("_row")), lambda r: r["item"]).alias("items")
    )
    lists = materialize(lists, "parts")
    # numbering touches one short row per chunk, not the rows in it
    numbered = (
        lists.select(*keys, "_pid", "_chunk")
        .withColumn("part", F.row_number().over(Window.partitionBy(*keys).orderBy("_pid", "_chunk")))
        .withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int"))
    )
    joined = _attach(lists, numbered, [*keys, "_pid", "_chunk"], ["part", "parts"], "inner")
    return joined.select(*keys, "part", "parts", "items")


def number_rows(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """1-based position in a total order, without bringing all rows to one task.

    The sorted frame is written once; a partition's first position is the number of rows
    in the partitions before it, a list with one entry per partition.
    """
    placed = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    pid, row = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_pid", pid)
        .join(F.broadcast(starts), "_pid")
        .withColumn(name, F.col("_start") + row + 1)
        .drop("_id", "_pid", "_start")
    )
