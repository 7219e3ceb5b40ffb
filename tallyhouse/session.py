"""What a session needs before a query runs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: HotSpot's limit of a method that it compiles (-XX:-DontCompileHugeMethods lifts it).
MOST_BYTECODE = 8000
HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's code to Python workers, once a context, so that it need not be installed on them."""
    sc = spark.sparkContext
    if not getattr(sc, "_tallyhouse_shipped", False):
        path = os.path.join(tempfile.mkdtemp(prefix="tallyhouse-code-"), "tallyhouse.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(HERE.rglob("*")):
                if p.is_file() and p.suffix in (".py", ".yaml"):
                    z.write(p, p.relative_to(HERE.parent))
        sc.addPyFile(path)
        sc._tallyhouse_shipped = True
    return spark


def small_methods(spark: SparkSession) -> None:
    """Have Spark make methods that the JVM compiles.

    The JVM never compiles a method of over 8,000 bytes of bytecode but interprets it. Casts of wide rows make such
    methods where Spark fuses all steps into one; above this bound it makes many small ones instead. It holds for what
    else runs in the session.
    """
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > MOST_BYTECODE:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(MOST_BYTECODE))


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local master, where driver and executors are one process, gets a temporary folder where none is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="tallyhouse-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df written as a table to the folder that driver and executors share, and read back whatever becomes of executors: later steps read the columns that they use, and by folders where ``by`` names columns that they filter."""
    path = f"{_shared(df.sparkSession)}/tallyhouse/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
