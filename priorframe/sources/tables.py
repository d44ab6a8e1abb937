"""Reading and writing tables: shared workspaces, versioned tables, upserts, retention, archives and prunes on Parquet."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

_LOCAL: dict[str, str] = {}


class Workspace:
    """A folder of written tables in the shared folder that ``spark.checkpoint.dir`` names."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        app = spark.sparkContext.applicationId
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not root and app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="priorframe-")
        root = root or _LOCAL[app]
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")


class VersionedTable:
    """A Parquet table in folders by one column, whose live folders a version file names.

    A commit writes the folders of the touched values first and the version file last; a file of that name is never
    overwritten. So a reader sees the version before or the version after, never a mix; of two writers of one version one
    is refused; and values that a commit does not touch keep their files. Old folders stay for the readers of old versions.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, by: str):
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), schema, by
        jvm = spark._jvm
        self._of = jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version, 0 where there is none yet."""
        folder = self._of(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max([int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith((".", "_"))], default=0)

    def folders(self, version: int | None = None) -> dict[str, list[str]]:
        """The live folders of each value, which are few: a value's text to folders under the table's."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        at = f"{self.path}/versions/{version:012d}.json"
        stream = self._fs.open(self._of(at))
        try:
            raw = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        return json.loads(raw)

    def read(self, version: int | None = None, values: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version (the newest), of some values only if asked for."""
        live = self.folders(version)
        paths = [f"{self.path}/{f}" for v, fs in sorted(live.items()) if values is None or v in set(values) for f in fs]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def values(self, rows: DataFrame) -> list[str]:
        """The distinct values of the folder column in rows, as text; there are as many as folders."""
        return sorted(r.v for r in rows.select(self._value().alias("v")).distinct().collect())

    def _value(self) -> Column:
        return F.coalesce(F.col(self.by).cast("string"), F.lit("__none"))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows to a new place; the folder of each value that has rows."""
        place = f"data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).withColumn("__by", self._value()).write.partitionBy("__by").parquet(f"{self.path}/{place}")
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = [f.getPath().getName() for f in self._fs.listStatus(self._of(f"{self.path}/{place}"))]
        return {unescape(n.split("=", 1)[1]): f"{place}/{n}" for n in names if n.startswith("__by=")}

    def _commit(self, base: int, live: dict[str, list[str]]) -> int:
        version = base + 1
        at = self._of(f"{self.path}/versions/{version:012d}.json")
        # written aside and renamed, so that a version file is whole when it is there; rename refuses a name that is taken
        aside = self._of(f"{self.path}/versions/_{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(live, sort_keys=True).encode()))
        finally:
            stream.close()
        if self._fs.exists(at) or not self._fs.rename(aside, at):
            raise RuntimeError(f"version {version} of {self.path} was written by another")
        return version

    def append(self, rows: DataFrame, base: int | None = None) -> int:
        """Add rows to a version (the newest) and commit; the new version's number."""
        base = self.version() if base is None else base
        live = self.folders(base)
        for value, folder in self._write(rows).items():
            live.setdefault(value, []).append(folder)
        return self._commit(base, live)

    def replace(self, values: Sequence[str], rows: DataFrame, base: int | None = None) -> int:
        """Put rows in place of all rows of these values and commit; rows may have no other values."""
        base = self.version() if base is None else base
        live, new = self.folders(base), self._write(rows)
        if set(new) - set(values):
            raise ValueError(f"rows of values that are not replaced: {sorted(set(new) - set(values))}")
        return self._commit(base, {**{v: fs for v, fs in live.items() if v not in set(values)}, **{v: [f] for v, f in new.items()}})

    def change(self, updates: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Rewrite the values that occur in updates by ``how(target, updates)``; all others keep their files.

        ``how`` must not move a row to another value.
        """
        base = self.version()
        updates = Workspace(self.spark, "updates").save(updates, "rows")
        touched = self.values(updates)
        return self.replace(touched, how(self.read(base, touched), updates), base)


def files_fingerprint(*frames: DataFrame) -> str:
    """A digest of the files that these tables are read from: names, sizes and times. It changes when a table is rewritten."""
    named = [df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct() for df in frames]
    marks = reduce(DataFrame.unionByName, named).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time")).alias("x")).first()
    return f"{marks.n}-{marks.x}"


def scan(spark: SparkSession, path: str, season: str, seasons: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """A season-partitioned table: only these seasons' files and these columns are read."""
    return spark.read.parquet(path).where(F.col(season).isin(*seasons)).select(*columns)


def scan_before(df: DataFrame, keys: DataFrame, key: str, season: str, period: str, at: tuple[int, int]) -> DataFrame:
    """Rows of a key list strictly before a (season, period)."""
    cut = F.struct(F.lit(at[0]).cast("long").alias(season), F.lit(at[1]).cast("long").alias(period))
    return df.where(F.struct(season, period) < cut).join(keys.select(key).distinct(), key, "left_semi")


def read_named_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV files with the stem of the file a row came from as ``stem``."""
    rows = spark.read.schema(schema).csv(path, header=True)
    return rows.withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:-\d+.*)?\.csv", 1))


def resolve_headers(columns: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Header to name by the first alias that is there; two headers of one alias are refused."""
    plain: dict[str, list[str]] = {}
    for c in columns:
        plain.setdefault(c.strip().lower(), []).append(c)
    out = {}
    for name, options in aliases.items():
        found = next((o for o in options if o in plain), None)
        if found is None:
            raise ValueError(f"no header for {name}")
        if len(plain[found]) > 1:
            raise ValueError(f"two headers for {name}: {plain[found]}")
        out[plain[found][0]] = name
    return out


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Last write wins: of the updates of a key the last by ``order``, else the target's row."""
    ranked = updates.withColumn("__first", F.lit(0)).unionByName(target.withColumn("__first", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__first", *([order] if order is not None else [])))
    return ranked.withColumn("__place", place).where("__place = 1").select(*target.columns)


def insert_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with the rows whose key it does not have yet; rows must be unique on the key."""
    return target.unionByName(rows.join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def coalesce_update(target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str], insert: bool = True) -> DataFrame:
    """New values where they are not null, else the old ones; without ``insert``, only rows that exist are touched."""
    named = updates.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = target.join(named, list(keys), "full" if insert else "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns))


def guarded_update(target: DataFrame, updates: DataFrame, keys: Sequence[str], stamp: str, value: str, limit: DataFrame, limit_stamp: str) -> DataFrame:
    """A new value only if its stamp is newer than the target's and before the limit of its key."""
    new = updates.select(*keys, F.col(stamp).alias("__stamp"), F.col(value).alias("__value")).join(limit, list(keys), "left")
    joined = target.join(new, list(keys), "left")
    ok = (F.col("__stamp") > F.col(stamp)) & (F.col("__stamp") < F.col(limit_stamp))
    pick = {value: F.when(ok, F.col("__value")).otherwise(F.col(value)), stamp: F.when(ok, F.col("__stamp")).otherwise(F.col(stamp))}
    return joined.select(*(pick[c].alias(c) if c in pick else F.col(c) for c in target.columns))


def protected_upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], approved: Column) -> tuple[DataFrame, DataFrame]:
    """Updates without the keys that another approved run serves, and a one-row count of the skipped."""
    served = target.where(approved).select(*keys).distinct()
    skipped = updates.join(served, list(keys), "left_semi").agg(F.count("*").alias("skipped"))
    return upsert(target, updates.join(served, list(keys), "left_anti"), keys), skipped


def promote_run(held: VersionedTable, run: str, pending: str, approved: str) -> int:
    """Relabel a run's rows in one commit of a table in folders by run; refused if rows of the run would be lost or doubled."""
    base = held.version()
    before = held.read(base, [pending, approved]).groupBy(run).agg(F.count("*").alias("n")).collect()  # two rows at most
    rows = held.read(base, [pending, approved]).withColumn(run, F.lit(approved).cast(held.schema[run].dataType))
    version = held.replace([pending, approved], rows, base)
    n = held.read(version, [approved]).count()
    if n != sum(r.n for r in before):
        raise RuntimeError(f"the promotion of {pending} is not complete: {n} rows of {sum(r.n for r in before)}")
    return version


def keep_recent(df: DataFrame, stamp: str, now: Column, days: int, always: Column | None = None) -> DataFrame:
    """Rows younger than this many days, and those of sources that are always kept."""
    if days <= 0:
        raise ValueError("the retention window must be positive")
    young = F.col(stamp) >= now - F.make_dt_interval(F.lit(days))
    return df.where(young if always is None else young | always)


def keep_runs(df: DataFrame, run: str, keep: Sequence[int], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of kept runs, and keys that would be left without any row."""
    kept = df.where(F.col(run).isin(*keep))
    uncovered = df.select(key).distinct().join(kept.select(key).distinct(), key, "left_anti")
    return kept, uncovered


def intersect_columns(source: DataFrame, target: DataFrame, never: Sequence[str] = ()) -> list[str]:
    """The target's columns that the source has, in the target's order."""
    return [c for c in target.columns if c in source.columns and c not in never]
