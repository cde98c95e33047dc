"""Day-partitioned Parquet tables (year=YYYY/month=MM/day=DD) and flat dimensions."""

from __future__ import annotations

import time
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import date, timedelta

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from shelfledger.functions.columns import conform, day_range
from shelfledger.operators.costs import unified_cost
from shelfledger.operators.sales import combined_sales
from shelfledger.schemas import (
    COST_TABLES,
    DAILY_TABLES,
    DIMENSIONS,
    RAW_TABLES,
    Spec,
    struct_type,
)
from shelfledger.sources.manifest import EMPTY, PLAIN, Days, Manifest, Version

DAY_COLUMNS = ("year", "month", "day")
#: Extra column of a typed view: the day of the folder, where ``date`` is a time.
FOLDER_DAY = "_day"
_NO_DATA = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def empty_frame(spark: SparkSession, spec: Spec) -> DataFrame:
    return spark.createDataFrame([], struct_type(spec))


def read_or_empty(
    spark: SparkSession, path: str, spec: Spec, merge_schema: bool = False
) -> DataFrame:
    """Parquet below ``path``, or an empty frame with the declared columns.

    The declared schema is given to the reader, so no file footer is opened to
    plan the scan and columns missing in older files read as NULL.  Set
    ``merge_schema`` when files disagree on types: the union of their schemas is
    read instead and :func:`typed` casts it.
    """
    reader = spark.read
    reader = reader.option("mergeSchema", "true") if merge_schema else reader.schema(struct_type(spec))
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in _NO_DATA:
            return empty_frame(spark, spec)
        raise


def partition_day() -> Column:
    """Calendar day of a partition, from its folder names."""
    return F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int"))


def typed(df: DataFrame, spec: Spec) -> DataFrame:
    """Typed view of a stored table: values cast without failing, NULL becomes the default.

    A day column of a day-partitioned table is the day of its folder, so any
    filter on it prunes folders.  A ``date`` with a time of day is stored in the
    file and falls back to the folder.
    """
    if set(DAY_COLUMNS) <= set(df.columns):
        for name, kind, _ in spec:
            if name in ("date", "snapshot_date", FOLDER_DAY) and kind == "date":
                df = df.withColumn(name, partition_day())
            elif name == "date":
                stored = F.col(name).try_cast(kind) if name in df.columns else F.lit(None)
                df = df.withColumn(name, F.nvl(stored.cast(kind), partition_day().cast(kind)))
    return df.select(*conform(df, spec))


def read_days(
    spark: SparkSession,
    path: str,
    spec: Spec,
    start: date | None = None,
    end: date | None = None,
    merge_schema: bool = False,
) -> DataFrame:
    """Typed rows of a day-partitioned table; only folders in [start, end] are read."""
    df = read_or_empty(spark, path, spec, merge_schema)
    if set(DAY_COLUMNS) <= set(df.columns):
        if start is not None:
            df = df.where(partition_day() >= F.lit(start))
        if end is not None:
            df = df.where(partition_day() <= F.lit(end))
    elif start is not None and end is not None and "date" in df.columns:
        df = df.where(day_range(F.col("date"), start, end))
    return typed(df, spec)


def _with_day_folders(df: DataFrame, day: Column) -> DataFrame:
    return df.withColumns(
        {
            "year": F.date_format(day, "yyyy"),
            "month": F.date_format(day, "MM"),
            "day": F.date_format(day, "dd"),
        }
    )


def day_path(path: str, day: date) -> str:
    return f"{path}/year={day:%Y}/month={day:%m}/day={day:%d}"


def write_days(
    df: DataFrame, path: str, day_column: str = "date", sort_by: tuple[str, ...] = ()
) -> None:
    """Replace every day that occurs in ``df``; other days stay as they are.

    The rebalance hint brings a day's rows together and lets the engine split a
    day that is far larger than the others over several tasks and files.  The
    writer sorts by folder anyway; ``sort_by`` extends that order, so a later
    filter on these columns can skip row groups.
    """
    (
        _with_day_folders(df, F.col(day_column).cast("date"))
        .hint("rebalance", *DAY_COLUMNS)
        .sortWithinPartitions(*DAY_COLUMNS, *sort_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*DAY_COLUMNS)
        .parquet(path)
    )


def day_files(spark: SparkSession, path: str) -> DataFrame:
    """One row (``date``, ``path``) per Parquet file below a day-partitioned table."""
    nothing = spark.createDataFrame([], "date date, path string")
    try:
        files = (
            spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        )
    except AnalysisException as error:
        if error.getCondition() in _NO_DATA:
            return nothing
        raise
    if not set(DAY_COLUMNS) <= set(files.columns):
        return nothing
    return files.select(partition_day().alias("date"), "path")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored_files(spark: SparkSession, path: str, days: list[date]) -> dict[date, frozenset[str]]:
    """Names of the Parquet files of each given day; only the folders of these days are listed."""
    fs, system = _file_system(spark, path)
    found = {}
    for day in days:
        folder = fs.Path(day_path(path, day))
        if system.exists(folder):
            names = (entry.getPath().getName() for entry in system.listStatus(folder))
            found[day] = frozenset(name for name in names if name.endswith(".parquet"))
    return found


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """Days that have a folder, in order.  Folder names are listed, no files."""
    fs, system = _file_system(spark, path)
    entries = system.globStatus(fs.Path(f"{path}/year=*/month=*/day=*")) or []
    return sorted(_folder_day(str(entry.getPath())) for entry in entries)


def _folder_day(folder: str) -> date:
    year, month, day = (int(part.split("=")[1]) for part in folder.split("/")[-3:])
    return date(year, month, day)


def replace_days(
    df: DataFrame,
    path: str,
    start: date,
    end: date,
    day_column: str = "date",
    sort_by: tuple[str, ...] = (),
) -> None:
    """Replace all days of [start, end]; a day without rows is left with an empty file.

    Running it again gives the same lake, and one range gives the same as its days one by one: a day whose rows
    have all gone does not keep its old ones, and a day without rows is there and empty.  Only the
    folders of the range are listed, and ``df`` is computed once.  Rows outside the range are not written; the
    caller decides about them.
    """
    spark = df.sparkSession
    days = [start + timedelta(days=k) for k in range((end - start).days + 1)]
    before = stored_files(spark, path, days)
    day = F.col(day_column).cast("date")
    write_days(df.where(day.between(F.lit(start), F.lit(end))), path, day_column, sort_by)
    after = stored_files(spark, path, days)
    # A day that the write did not reach is gone, or never was there.
    empty = [d for d in days if not after.get(d) or after[d] == before.get(d)]
    if not empty:
        return
    first = day_path(path, empty[0])
    df.limit(0).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(first)
    fs, system = _file_system(spark, path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for other in empty[1:]:
        target = fs.Path(day_path(path, other))
        system.delete(target, True)
        fs.FileUtil.copy(system, fs.Path(first), system, target, False, True, conf)


def write_dimension(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


# --- files of differing types -------------------------------------------------------------------

# Error conditions of files whose columns have no common type.
_NO_COMMON_TYPE = {"CANNOT_MERGE_SCHEMAS", "CANNOT_MERGE_INCOMPATIBLE_DATA_TYPE"}


def type_generations(
    spark: SparkSession, base: str, paths: list[str], spec: Spec
) -> list[tuple[list[str], StructType]]:
    """Runs of neighbouring ``paths`` whose files agree on the types of the declared columns.

    A run is halved as long as its first and last file differ, so a table whose types changed a few
    times costs a few footers for each change.  Then Spark merges all footers of a run, in parallel, which adds
    columns that only some files have; a run that does not merge is halved as well.
    """
    names = {name for name, _, _ in spec}
    reader = spark.read.option("basePath", base)
    seen: dict[str, StructType] = {}

    def declared(schema: StructType) -> StructType:
        return StructType([field for field in schema if field.name in names])

    def one(path: str) -> dict[str, str]:
        if path not in seen:
            seen[path] = declared(reader.parquet(path).schema)
        return {field.name: field.dataType.simpleString() for field in seen[path]}

    def agree(left: str, right: str) -> bool:
        a, b = one(left), one(right)
        return all(a[name] == b[name] for name in a.keys() & b.keys())

    def split(run: list[str]) -> list[tuple[list[str], StructType]]:
        if agree(run[0], run[-1]):
            try:
                merged = reader.option("mergeSchema", "true").parquet(*run).schema
                return [(run, declared(merged))]
            except PySparkException as error:
                if len(run) == 1 or not any(name in str(error) for name in _NO_COMMON_TYPE):
                    raise
        half = len(run) // 2
        left, right = split(run[:half]), split(run[half:])
        if left[-1][1] == right[0][1]:  # one generation, cut by the halving
            left[-1] = (left[-1][0] + right[0][0], left[-1][1])
            right = right[1:]
        return left + right

    return split(paths) if paths else []


FLAT = date.min  # stands for the only "day" of a table without days


class Lake:
    """Folder layout: ``<root>/raw``, ``<root>/clean``, ``<root>/star-schema``.

    Every write goes to new version folders (``.../day=DD/v=<version>``) and is published by the manifest, one
    write at a time or, inside :meth:`transaction`, all tables and days at once.  Readers see the published
    versions only, so a job stopped at any step leaves the former state.  Days that other
    writers left as plain day folders are read as well and taken over on the first write.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.manifest = Manifest(spark, self.root)
        self._base: int | None = None
        self._pending: dict[str, Days] = {}
        self._plain: dict[str, Days] = {}

    def raw(self, table: str) -> str:
        return f"{self.root}/raw/{table}"

    def clean(self, table: str) -> str:
        return f"{self.root}/clean/{table}"

    def star(self, table: str) -> str:
        return f"{self.root}/star-schema/{table}"

    # --- published and pending days -----------------------------------------------------------

    @contextmanager
    def transaction(self) -> Iterator[Lake]:
        """Publishes all writes of the block together when it ends, or none if it fails.

        Inside the block this lake reads what it has written and otherwise the state at the
        beginning.  A block inside another one belongs to it.
        """
        if self._base is not None:
            yield self
            return
        self._base, self._pending = self.manifest.latest(), {}
        try:
            yield self
            if self._pending:
                self.manifest.commit(self._base, self._pending)
        finally:
            self._base, self._pending = None, {}

    def _key(self, path: str) -> str:
        return path[len(self.root) + 1 :]

    def versions(self, path: str, pending: bool = True) -> Days:
        """Version of each stored day; with ``pending`` also those of the open transaction."""
        base = self.manifest.latest() if self._base is None else self._base
        found = self.manifest.days(self.manifest.root(base), self._key(path))
        if not found:
            found = self._plain_days(path)
        return found | self._pending.get(self._key(path), {}) if pending else found

    def _plain_days(self, path: str) -> Days:
        """Days of plain folders.  Types are read from their files, once for this lake."""
        fs, system = _file_system(self.spark, path)
        entries = system.globStatus(fs.Path(f"{path}/year=*/month=*/day=*/*.parquet")) or []
        days = sorted({_folder_day(str(entry.getPath().getParent())) for entry in entries})
        known = self._plain.get(path, {})
        if set(days) != set(known):
            folders = {self._day_folder(path, day, PLAIN): day for day in days}
            spec = self._spec(path)
            known = {
                folders[folder]: Version(PLAIN, _ddl(schema))
                for group, schema in type_generations(self.spark, path, list(folders), spec)
                for folder in group
            }
            self._plain[path] = known
        return known

    def _spec(self, path: str) -> Spec:
        name = path.rpartition("/")[2]
        return DAILY_TABLES.get(name) or RAW_TABLES[name]

    @staticmethod
    def _day_folder(path: str, day: date, version: str) -> str:
        if day == FLAT:
            return f"{path}/v={version}"
        folder = day_path(path, day)
        return f"{folder}/v={version}" if version else f"{folder}/*.parquet"

    def days(self, name: str) -> list[date]:
        """Days that a star-schema table holds, empty ones included, in order."""
        return sorted(self.versions(self.star(name)))

    # --- reading ---------------------------------------------------------------------------------

    def read(
        self, path: str, spec: Spec, days: Iterable[date], pending: bool = True
    ) -> DataFrame:
        """Typed rows of the given days, whatever types their files have.

        Only folders of these days are listed.  Days whose files have other types than the rest are read
        on their own and cast; the number of scans is the number of such generations.
        """
        stored = self.versions(path, pending)
        groups: dict[tuple[bool, str], list[str]] = defaultdict(list)
        for day in sorted(set(days) & set(stored)):
            version = stored[day]
            if version.name == EMPTY:
                continue
            groups[bool(version.name), version.schema].append(
                self._day_folder(path, day, version.name)
            )
        rows = None
        for (_, schema), folders in groups.items():
            reader = self.spark.read.schema(StructType.fromDDL(schema)).option("basePath", path)
            part = typed(reader.parquet(*folders), spec)
            rows = part if rows is None else rows.unionByName(part)
        return typed(empty_frame(self.spark, spec), spec) if rows is None else rows

    def read_as_written(self, path: str, days: Iterable[date]) -> DataFrame | None:
        """Rows of the given days with the columns they were written with; None without a stored day."""
        stored = self.versions(path)
        days = [day for day in days if day in stored]
        if not days:
            return None
        fields = StructType.fromDDL(stored[max(days)].schema).fields
        return self.read(path, [(f.name, f.dataType.simpleString(), None) for f in fields], days)

    def row_counts(self, path: str, start: date, end: date) -> DataFrame:
        """(date, rows) of every stored day of the range, 0 for an empty one.

        No column is read: the scan answers from the row counts in the Parquet footers.
        """
        days = [day for day in self.versions(path) if start <= day <= end]
        listed = self.spark.createDataFrame([(day,) for day in days], "date date")
        rows = self.read(path, [(FOLDER_DAY, "date", None)], days)
        counts = rows.groupBy(F.col(FOLDER_DAY).alias("date")).agg(
            F.count(F.lit(1)).alias("rows")
        )
        return listed.join(counts, "date", "left").select("date", F.nvl("rows", F.lit(0)).alias("rows"))

    def _range(
        self,
        path: str,
        spec: Spec,
        start: date | None = None,
        end: date | None = None,
        pending: bool = True,
    ) -> DataFrame:
        days = self.versions(path, pending)
        return self.read(
            path, spec, [d for d in days if (start or d) <= d <= (end or d)], pending
        )

    def table(self, name: str, start: date | None = None, end: date | None = None) -> DataFrame:
        """Typed view of a star-schema table.

        Tables whose day column is a date prune their folders for any date filter.
        ``fact_sales`` and ``fact_inventory_moves`` hold timestamps, so give their
        range here.
        """
        if name in DAILY_TABLES:
            return self._range(self.star(name), DAILY_TABLES[name], start, end)
        if name in COST_TABLES:
            return self._flat(name, COST_TABLES[name]).where("is_active")
        return self._flat(name, DIMENSIONS[name])

    def published(self, name: str, start: date | None = None, end: date | None = None) -> DataFrame:
        """A daily table as it was when the open transaction began."""
        return self._range(self.star(name), DAILY_TABLES[name], start, end, pending=False)

    def _flat(self, name: str, spec: Spec) -> DataFrame:
        path = self.star(name)
        base = self.manifest.latest() if self._base is None else self._base
        found = self.manifest.days(self.manifest.root(base), self._key(path))
        found = found | self._pending.get(self._key(path), {})
        if FLAT not in found:
            return typed(read_or_empty(self.spark, path, spec), spec)
        folder = self._day_folder(path, FLAT, found[FLAT].name)
        schema = StructType.fromDDL(found[FLAT].schema)
        return typed(self.spark.read.schema(schema).parquet(folder), spec)

    def register_views(self) -> list[str]:
        """Temp views for SQL users: every table, all sales lines, unified costs.

        In ``fact_sales``, ``fact_sales_all`` and ``fact_inventory_moves`` the day column (``date``,
        ``movement_date``) is the day of the folder; the time is in ``sold_at`` or ``moved_at``.
        """
        names = [*DAILY_TABLES, *COST_TABLES, *DIMENSIONS]
        for name in names:
            self.table(name).createOrReplaceTempView(name)
        # Day columns of timestamp tables are the folder days, so a filter on them prunes folders.
        by_day = {
            name: self._by_folder_day(name) for name in ("fact_sales", "fact_inventory_moves")
        }
        by_day["fact_sales"].createOrReplaceTempView("fact_sales")
        by_day["fact_inventory_moves"].withColumnsRenamed(
            {"sold_at": "moved_at", "date": "movement_date"}
        ).createOrReplaceTempView("fact_inventory_moves")
        combined_sales(by_day["fact_sales"], self.table("fact_invoice_sales")).drop(
            "sold_at"
        ).createOrReplaceTempView("fact_sales_all")
        unified_cost(
            self.table("fact_product_cost_latest_daily"), self.table("fact_product_legacy_costs")
        ).createOrReplaceTempView("fact_product_costs_unified")
        return [*names, "fact_sales_all", "fact_product_costs_unified"]

    def _by_folder_day(self, name: str) -> DataFrame:
        """A timestamp table with ``date`` as the folder day and the time in ``sold_at``."""
        spec = [*DAILY_TABLES[name], (FOLDER_DAY, "date", None)]
        rows = self._range(self.star(name), spec)
        return rows.withColumnRenamed("date", "sold_at").withColumnRenamed(FOLDER_DAY, "date")

    # --- writing ---------------------------------------------------------------------------------

    def replace(self, name: str, df: DataFrame, start: date, end: date, day: str = "date") -> None:
        """Replace the days of a range; rows of a day are kept in product order."""
        self.replace_days(self.star(name), df, _calendar(start, end), day)

    def replace_days(
        self, path: str, df: DataFrame, days: list[date], day_column: str = "date"
    ) -> None:
        """Replace the given days; one without rows is there and empty.

        Rows of other days are not written.  Nothing is read or listed but the written days.
        """
        if not days:
            return
        with self.transaction():
            version = _new_version()
            day = F.col(day_column).cast("date")
            first, last = min(days), max(days)
            inside = day.between(F.lit(first), F.lit(last))
            if len(set(days)) <= (last - first).days:
                inside = inside & day.isin(list(days))
            (
                _with_day_folders(df.where(inside), day)
                .withColumn("v", F.lit(version))
                .hint("rebalance", *DAY_COLUMNS)
                .sortWithinPartitions(*DAY_COLUMNS, *self.order(df))
                .write.mode("append")
                .option("compression", "zstd")
                .partitionBy(*DAY_COLUMNS, "v")
                .parquet(path)
            )
            fs, system = _file_system(self.spark, path)
            taken = {} if self._key(path) in self._pending else self._taken_over(path)
            schema = _ddl(df.schema)
            for one in days:
                full = system.exists(fs.Path(self._day_folder(path, one, version)))
                taken[one] = Version(version if full else EMPTY, schema)
            self._pending.setdefault(self._key(path), {}).update(taken)

    def _taken_over(self, path: str) -> Days:
        """Plain days that the manifest does not name yet."""
        root = self.manifest.root(self._base or 0)
        return {} if self.manifest.days(root, self._key(path)) else dict(self._plain_days(path))

    def replace_flat(self, name: str, df: DataFrame) -> None:
        """Replace a table without days."""
        with self.transaction():
            version, path = _new_version(), self.star(name)
            write_dimension(df, self._day_folder(path, FLAT, version))
            self._pending[self._key(path)] = {FLAT: Version(version, _ddl(df.schema))}

    @staticmethod
    def order(df: DataFrame) -> tuple[str, ...]:
        return ("product_id",) if "product_id" in df.columns else ()

    def days_before(self, name: str, day: date) -> DataFrame:
        """Rows of the partition of the day before ``day``."""
        previous = day - timedelta(days=1)
        return self.table(name, previous, previous)

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0) -> int:
        """Delete versions that none of the last ``keep`` commits names; returns how many.

        Readers of an older commit fail afterwards.  Folders younger than ``older_than`` seconds may
        belong to a writer at work and stay.
        """
        before = int((time.time() - older_than) * 1000)
        deleted = 0
        for table, days in self.manifest.live(keep).items():
            path = f"{self.root}/{table}"
            fs, system = _file_system(self.spark, path)
            for day, names in days.items():
                parent = fs.Path(path if day == FLAT else day_path(path, day))
                for entry in system.listStatus(parent) if system.exists(parent) else []:
                    name = entry.getPath().getName()
                    known = name[2:] in names if name.startswith("v=") else PLAIN in names
                    if not known and entry.getModificationTime() <= before:
                        system.delete(entry.getPath(), True)
                        deleted += 1
        self.manifest.forget(keep, before)
        return deleted


def _new_version() -> str:
    return f"w{uuid.uuid4().hex}"


def _calendar(start: date, end: date) -> list[date]:
    return [start + timedelta(days=k) for k in range((end - start).days + 1)]


def _ddl(schema: StructType) -> str:
    return ", ".join(
        f"`{field.name}` {field.dataType.simpleString()}"
        for field in schema
        if field.name not in (*DAY_COLUMNS, "v")
    )
