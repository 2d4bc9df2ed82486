"""Keyed tables kept as a leveled log of changes.

A batch appends its changes as a run of level 0, one folder for each month that it touches, and replaces that run when
it is repeated: its cost follows the batch and never the table. When a month has `FANOUT` runs of a level, the next
batch merges them into one run of the level above, which holds the winning version of each key of that month; other
months are not touched. So a month has few runs however many batches there were, and a read opens the runs of the asked
months alone. Merged runs are sorted by key and carry Bloom filters of their keys, by which scans skip row groups.

Readers take the newest version of each key. A batch repeated after its merge has to bring the keys that it had; its
rows then count in place of those merged. Runs that a merge has replaced are deleted one batch later, so a reader
that has listed them can finish. A catalog with a MERGE INTO format can take this class's place.
"""

from __future__ import annotations

import dataclasses
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dialoglens.session import delete_path, list_folders

MARKS = "_version bigint, _gone boolean, batch bigint"
FANOUT = 8
#: The month of tables without a time, and of rows without one.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"
AGAIN = "-again"


@dataclasses.dataclass(frozen=True)
class Run:
    """Changes of the batches `first` to `last` in one month. `again`: a batch repeated after it was merged."""

    path: str
    level: int
    month: str
    first: int
    last: int
    again: bool

    def covers(self, other: "Run") -> bool:
        return self.month == other.month and self.level > other.level and self.first <= other.first and other.last <= self.last and not other.again


class ChangeTable:
    """Rows of `schema` by `keys`; NULL is a key like any other.

    The version of a change is the time in column `order` of what is put, else its batch. All rows of a key's winning
    version and batch are its rows, so a key may have several. `keep="first"` lets the earliest version win instead.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, keys: list[str], order: str | None = None, time: str | None = None, keep: str = "last",
        fanout: int = FANOUT,
    ):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.order, self.time, self.keep, self.fanout = order, time, keep, fanout

    # ---- runs ------------------------------------------------------------------------------------------------------

    def runs(self) -> list[Run]:
        """All complete runs, also those that a merge has replaced."""
        found = []
        for level_name in list_folders(self.spark, self.path, "level="):
            level = int(level_name.removeprefix("level="))
            for name in list_folders(self.spark, f"{self.path}/{level_name}", "run=", complete=level == 0):
                first, last = name.removeprefix("run=").removesuffix(AGAIN).split("-")
                folder = f"{self.path}/{level_name}/{name}"
                for month in list_folders(self.spark, folder, "month=", complete=level > 0):
                    found.append(Run(f"{folder}/{month}", level, month.removeprefix("month="), int(first), int(last), name.endswith(AGAIN)))
        return found

    def current(self, first_month=None) -> list[Run]:
        """The runs that a read opens: of the months from `first_month` on, and of rows without a month."""
        runs = self.runs()
        if isinstance(first_month, Column):
            first_month = self.spark.range(1).select(first_month.cast("date")).first()[0]
        asked = lambda run: first_month is None or run.month == NO_MONTH or run.month >= str(first_month)
        return [run for run in runs if asked(run) and not any(other.covers(run) for other in runs)]

    # ---- writing ---------------------------------------------------------------------------------------------------

    def put(self, rows: DataFrame, batch_id: int, touched: DataFrame | None = None) -> None:
        """Append a batch. Keys in `touched` lose the rows that they had and get none but those in `rows`."""
        runs = self.runs()
        replaced = [run for run in runs if any(other.covers(run) for other in runs)]
        self._merge_full(batch_id)
        for run in replaced:
            delete_path(self.spark, run.path)
        self._sweep(batch_id)
        changes = self._marked(rows, batch_id, False)
        if touched is not None:
            changes = changes.unionByName(self._marked(touched, batch_id, True), allowMissingColumns=True)
        month = F.trunc(self.time, "month") if self.time else F.lit(None).cast("date")
        # what was merged can't be taken out of its run: the repeated batch stands beside it and counts in its place
        merged = any(run.level > 0 and run.first <= batch_id <= run.last for run in runs)
        folder = f"{self.path}/level=0/run={batch_id}-{batch_id}{AGAIN if merged else ''}"
        changes.withColumn("month", month).write.mode("overwrite").partitionBy("month").parquet(folder)

    def _marked(self, rows: DataFrame, batch_id: int, gone: bool) -> DataFrame:
        version = F.unix_micros(F.col(self.order).cast("timestamp")) if self.order else F.lit(batch_id)
        fields = self.spark.createDataFrame([], self.schema).schema.fields
        present = set(self.keys if gone else rows.columns)
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        return rows.select(*columns, version.cast("bigint").alias("_version"), F.lit(gone).alias("_gone"), F.lit(batch_id).cast("bigint").alias("batch"))

    def _sweep(self, before: int) -> None:
        """Delete the folders of runs that have no month left."""
        for level_name in list_folders(self.spark, self.path, "level="):
            for name in list_folders(self.spark, f"{self.path}/{level_name}", "run="):
                folder = f"{self.path}/{level_name}/{name}"
                if int(name.removesuffix(AGAIN).split("-")[1]) < before and not list_folders(self.spark, folder, "month="):
                    delete_path(self.spark, folder)

    def _merge_full(self, before: int) -> None:
        """Merge what months have gathered in the batches before `before`, whose repetition is over."""
        levels: dict[tuple[str, int], list[Run]] = defaultdict(list)
        for run in self.current():
            if run.last < before and not run.again:
                levels[run.month, run.level].append(run)
        for (_, level), runs in sorted(levels.items()):
            if len(runs) >= self.fanout:
                self._merge(runs, level + 1)

    def _merge(self, runs: list[Run], level: int) -> None:
        first, last = min(r.first for r in runs), max(r.last for r in runs)
        repeated = {r.first for r in self.runs() if r.again}
        rows = self._ranked(self._rows(runs, repeated)).drop("month", "level", "run")
        writer = rows.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.mode("overwrite")
        for key in self.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(f"{self.path}/level={level}/run={first}-{last}/month={runs[0].month}")

    def compact(self) -> None:
        """Merge each month that has several runs into one; run it while no batch is being written or read."""
        runs = self.current()
        repeated = any(run.again for run in runs)
        top = max((run.level for run in runs), default=0) + 1
        by_month: dict[str, list[Run]] = defaultdict(list)
        for run in runs:
            by_month[run.month].append(run)
        for some in by_month.values():
            if len(some) > 1 or repeated:
                self._merge(some, top)
        for run in self.runs():
            if run.level < top and (len(by_month[run.month]) > 1 or repeated):
                delete_path(self.spark, run.path)

    # ---- reading ---------------------------------------------------------------------------------------------------

    def _rows(self, runs: list[Run], repeated: set[int]) -> DataFrame:
        schema = f"{self.schema}, {MARKS}, level int, run string, month date"
        if not runs:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*[run.path for run in runs])
        if repeated:
            rows = rows.filter(~F.col("batch").isin(*repeated) | F.col("run").endswith(AGAIN))
        return rows

    def changes(self, first_month=None) -> DataFrame:
        """The stored versions with `_version`, `_gone`, `batch` and `month`; from `first_month` on, and those without a month.

        From a month on is exact for tables whose key has one month, or where any version of a key will do.
        """
        runs = self.current(first_month)
        repeated = {run.first for run in self.runs() if run.again}
        if first_month is None:
            return self._rows(runs, repeated).drop("level", "run")
        if not isinstance(first_month, Column):
            first_month = F.lit(str(first_month)).cast("date")
        dated = self._rows([run for run in runs if run.month != NO_MONTH], repeated).filter(F.col("month") >= first_month)
        bare = [run for run in runs if run.month == NO_MONTH]
        found = dated.unionByName(self._rows(bare, repeated)) if bare else dated
        return found.drop("level", "run")

    def _ranked(self, rows: DataFrame) -> DataFrame:
        """The winning version of each key, also where it takes the key away."""
        age = F.col("_version"), F.col("batch")
        order = [c.desc_nulls_last() if self.keep == "last" else c.asc_nulls_last() for c in age]
        rank = F.rank().over(Window.partitionBy(*self.keys).orderBy(*order))
        return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")

    def read(self, first_month=None) -> DataFrame:
        rows = self._ranked(self.changes(first_month)).filter("NOT _gone")
        return rows.select(*[c for c in rows.columns if c not in ("_version", "_gone", "batch", "month")])
