"""A drop folder as a stream of files: each content once, failures apart, reports current.

Structured Streaming tracks paths; contents seen before are skipped by digest, so that a renamed copy is not taken twice.
A batch is a few jobs for each channel, however many files it has. A file that fails is recorded and does not stop the
batch. With an archive, finished files are moved there, failures apart.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyhouse.engine import Engine

FILE = "path string, modificationTime timestamp, length long, content binary"
#: Names of files that are still being written or are not meant for us.
IGNORED = r"(^|/)[.~][^/]*$|\.(tmp|crdownload|part)$"


def _filed(engine: Engine, path: str, archive: str, outcome: str) -> bool:
    """Move a finished file to the archive's folder of its outcome, the time before its name; False if it could not be moved."""
    hadoop = engine.spark._jvm.org.apache.hadoop.fs
    source = hadoop.Path(path)
    fs = source.getFileSystem(engine.spark._jsc.hadoopConfiguration())
    target = hadoop.Path(f"{archive}/{outcome}/{dt.datetime.now():%Y%m%d_%H%M%S_%f}_{source.getName()}")
    fs.mkdirs(target.getParent())
    return fs.rename(source, target)


def ingest_batch(engine: Engine, batch: DataFrame, auto_commit: bool = True, archive: str | None = None) -> list[dict]:
    """The files of a batch in order of time: skipped, parsed, committed or failed.

    Contents stay with the executors: digests, parsing and writing are jobs over all new files of a channel at once. The
    driver sees a row a file. Contents that are committed, by whatever name, are known by their digest in the store.

    With an archive, files that are committed or skipped go to its folder ``processed`` and failed ones, with their
    copies in the batch, to ``failed``; a file that is only parsed stays where it is, and one that can't be moved has
    ``moved`` False.
    """
    found = batch.where(~F.col("path").rlike(IGNORED) & (F.col("length") > 0)).withColumn("sha256", F.sha2("content", 256))
    if archive:
        home = engine.spark._jvm.org.apache.hadoop.fs.Path(archive)
        home = home.getFileSystem(engine.spark._jsc.hadoopConfiguration()).makeQualified(home).toString()
        found = found.where(~F.col("path").startswith(home + "/processed/") & ~F.col("path").startswith(home + "/failed/"))
    known = engine.store.table("uploads").where("status = 'committed'").select("sha256").distinct().withColumn("_known", F.lit(True))
    listed = found.select("path", "modificationTime", "sha256").join(known, "sha256", "left").orderBy("modificationTime", "path").collect()
    first = {}
    for r in listed:
        if not r._known:
            first.setdefault(r.sha256, r.path)
    fresh = [(r.path, r.sha256) for r in listed if first.get(r.sha256) == r.path]
    wanted = engine.spark.createDataFrame(fresh, "path string, _digest string").select("path")
    out = engine.ingest_files(found.join(wanted, "path", "left_semi"), fresh, auto_commit)
    states = {digest: done["status"] for (_, digest), done in zip(fresh, out, strict=True)}
    out += [{"file": r.path.rpartition("/")[2], "path": r.path, "upload_id": None, "status": "skipped", "of": states.get(r.sha256, "committed")} for r in listed if first.get(r.sha256) != r.path]
    for done in out if archive else ():
        state = done.get("of", done["status"])
        if state in ("committed", "failed"):
            done["moved"] = _filed(engine, done["path"], archive, "failed" if state == "failed" else "processed")
    return out


def scan(engine: Engine, folder: str, auto_commit: bool = True, archive: str | None = None) -> list[dict]:
    """One pass over what is in the folder now, under whatever name it came before. Finished files move, by default to folders in this one."""
    files = engine.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return ingest_batch(engine, files, auto_commit, archive or folder)


def watch(engine: Engine, folder: str, checkpoint: str, every: str | None = None, auto_commit: bool = True, files_per_batch: int = 20, archive: str | None = None) -> StreamingQuery:
    """Take what is in the folder once (every=None), or keep watching. archive: where finished files go, by outcome.

    A path is taken once, even if another file comes under it later: scan() takes those.
    A batch that runs again after a stop finds some of its files moved already; those are passed over.
    """
    stream = engine.spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    writer = stream.load(folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: ingest_batch(engine, df, auto_commit, archive) and None)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
