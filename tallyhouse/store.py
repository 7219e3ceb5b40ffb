"""Tables of a store as Parquet: facts and errors by upload, the others as versioned snapshots.

A write makes a new snapshot and then moves the pointer to it, so that readers see the old or the new table and a plan
may read the table that it replaces. Facts and errors are replaced by upload partition. One writer at a time holds a
lock file. Files are reached by Hadoop's file system API, so that the root may be in any store Spark can write to.
"""

from __future__ import annotations

import datetime as dt
import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyhouse import schema
from tallyhouse.schema import RetailError

SNAPSHOTS = {
    "uploads": schema.UPLOADS, "skus": schema.SKUS, "sku_mappings": schema.MAPPINGS, "anomaly_rules": schema.RULES,
    "adapter_configs": "platform_key string, version int, yaml_text string, is_builtin boolean, enabled boolean",
    "daily_reports": "report_date date, metrics_json string, summary string, workbook string, created_at timestamp",
}
BY_UPLOAD = ("sales_facts", "fact_days", "upload_errors", "raw_files")
DAYS = "upload_id long, stat_date date"
RAW = "upload_id long, filename string, sha256 string, content binary"


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.shapes = {"sales_facts": schema.FACTS, "fact_days": DAYS, "upload_errors": schema.ERRORS, "raw_files": RAW}

    # files
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def remove(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def _put(self, name: str, text: str) -> None:
        path, fs = self._path(name)
        out = fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _get(self, name: str) -> str:
        return "".join(r.value for r in self.spark.read.text(f"{self.root}/{name}").collect())

    @contextmanager
    def writing(self, patience: float = 30.0):
        path, fs = self._path("_lock")
        end = time.time() + patience
        while not fs.createNewFile(path):
            if time.time() > end:
                raise RetailError("STORE_LOCKED", f"{self.root} is being written by another process")
            time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(path, False)

    # snapshots
    def table(self, name: str) -> DataFrame:
        if name in BY_UPLOAD:
            if not self._exists(name):
                return self.spark.createDataFrame([], self.shapes[name])
            wanted = self.spark.createDataFrame([], self.shapes[name]).schema
            return self.spark.read.schema(wanted).parquet(f"{self.root}/{name}").select(*wanted.names)
        if not self._exists(f"{name}/current"):
            return self.spark.createDataFrame([], SNAPSHOTS[name])
        return self.spark.read.schema(SNAPSHOTS[name]).parquet(f"{self.root}/{name}/{self._get(f'{name}/current')}")

    def replace(self, name: str, df: DataFrame) -> None:
        """A new snapshot; the one before the last is removed."""
        now = int(self._get(f"{name}/current")[1:]) if self._exists(f"{name}/current") else 0
        cols = [F.col(c.split()[0]).cast(c.split(None, 1)[1]).alias(c.split()[0]) for c in _fields(SNAPSHOTS[name])]
        df.select(*cols).write.mode("overwrite").parquet(f"{self.root}/{name}/v{now + 1}")
        self._put(f"{name}/current", f"v{now + 1}")
        if now > 1:
            self.remove(f"{name}/v{now - 1}")

    # by upload
    def put_upload(self, name: str, upload_id: int, df: DataFrame, counts: dict[str, Column] | None = None) -> dict:
        """Replace an upload's rows. Returns their number as ``rows`` and what ``counts`` come to, observed while they are written."""
        if "stat_date" in df.columns:
            df = df.sortWithinPartitions("stat_date", "platform_key")
        if name == "sales_facts":
            self._put_days(df)
        df, seen = _observed(df, counts)
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(f"{self.root}/{name}")
        if not seen.get["rows"]:
            self.drop_upload(name, upload_id)  # a write of nothing leaves the rows of before
        return seen.get

    def _put_days(self, facts: DataFrame) -> None:
        """Note the days of uploads before their facts are written. Days that an upload had before stay: one too many costs a look, one too few would lose rows."""
        new = facts.select("upload_id", "stat_date").distinct()
        old = self.table("fact_days").join(new.select("upload_id"), "upload_id", "left_semi")
        new.union(old).distinct().repartition("upload_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(f"{self.root}/fact_days")

    def facts_between(self, first: dt.date, last: dt.date) -> DataFrame:
        """The facts of some days. Facts lie by upload; the small table of their days tells which uploads are read at all."""
        within = F.col("stat_date").between(F.lit(first), F.lit(last))
        facts = self.table("sales_facts").where(within)
        if not self._exists("fact_days"):
            return facts
        return facts.join(self.table("fact_days").where(within).select("upload_id").distinct(), "upload_id", "left_semi").select(*facts.columns)

    def put_uploads(self, name: str, df: DataFrame, new_days: bool = True) -> None:
        """Replace the rows of every upload in df by one write; df may be made of the table itself. new_days=False: rows keep their days.

        Only the partitions of these uploads are written anew. A task has whole uploads, each a file's worth of rows, so
        that an upload is one file and not one of each task.
        """
        if name == "sales_facts" and new_days:
            self._put_days(df)
        if name != "raw_files":
            df = df.repartition("upload_id").sortWithinPartitions("upload_id", *[c for c in ("stat_date", "platform_key") if c in df.columns])
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(f"{self.root}/{name}")

    def staged(self, name: str, df: DataFrame, counts: dict[str, Column] | None = None, found: dict | None = None) -> DataFrame:
        """df written under a name of its own and read back: what follows reads it and does not make it again. ``found`` takes the number of rows and the counts."""
        watched, seen = _observed(df, counts)
        watched.write.mode("overwrite").parquet(f"{self.root}/{name}")
        if found is not None:
            found.update(seen.get)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop_upload(self, name: str, upload_id: int) -> None:
        for table in (name, "fact_days") if name == "sales_facts" else (name,):
            self.remove(f"{table}/upload_id={upload_id}")

    def next_id(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    def rows(self, name: str, values: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(values, SNAPSHOTS[name])


def _observed(df: DataFrame, counts: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """df with its number of rows and other aggregates observed by the next action on it, without a job of their own."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in (counts or {}).items()]), seen


def _fields(ddl: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in ddl:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [*out, now.strip()]
