"""Generated files against the values that they were made of."""

import hashlib

from pyspark.sql import functions as F

from tallyhouse.operators.normalize import finished, typed
from tallyhouse.sources import files, generator, spec

DAYS, SKUS = 14, 30


def facts_of(found, key):
    own = spec.builtin(key)
    parsed = files.parsed(found.where(F.col("path").startswith(generator.CHANNELS[key][0].partition("{")[0])), own.file_matching).cache()
    number = F.xxhash64("path").alias("upload_id")
    return finished(typed(parsed.where("cells is not null").select(number, "row_no", "cells"), parsed.first()["header"], own, ("upload_id",)), own)


def test_files_reach_the_manifest(spark):
    """Read and normalised, each channel has the sums, counts and errors that the plan says."""
    made = generator.rows(spark, DAYS, SKUS)
    found = generator.files(made, DAYS, SKUS).cache()
    assert found.count() == 4
    want = {(r.platform_key, r.stat_date): r.asDict() for r in generator.manifest(made).collect()}
    assert len(want) == 4 * DAYS - 1 and ("jd", generator.LAST_DAY) not in want
    for key in generator.CHANNELS:
        done = facts_of(found, key)
        got = {r.stat_date: r.asDict() for r in done.facts.groupBy("stat_date").agg(*[F.sum(c).alias(c) for c in generator.SUMS], F.count("*").alias("n")).collect()}
        own = {d: w for (k, d), w in want.items() if k == key}
        assert set(got) == set(own)
        for d, w in own.items():
            # a sum over no value at all is 0 where the channel has the field
            assert {c: got[d][c] for c in generator.SUMS if w[c] is not None} == {c: w[c] for c in generator.SUMS if w[c] is not None}
            assert got[d]["n"] == w["rows"] - w["filtered"] - w["failed"] - w["duplicated"]
        errors = {r.error_type: r["count"] for r in done.errors.groupBy("error_type").count().collect()}
        assert errors == {"filtered_out": 1, "duplicate_row": 1, "number_parse_failed": 1}


def test_rows_do_not_depend_on_tasks(spark):
    """The same bytes from 1 and 8 partitions, other bytes from another seed, and files cut by rows."""
    made = generator.rows(spark, DAYS, SKUS)
    one, many = ({(r.path, r.sha256) for r in generator.files(made.repartition(n), DAYS, SKUS).select("path", "sha256").collect()} for n in (1, 8))
    assert one == many
    other = {(r.path, r.sha256) for r in generator.files(generator.rows(spark, DAYS, SKUS, seed=8), DAYS, SKUS).select("path", "sha256").collect()}
    assert {p for p, _ in other} == {p for p, _ in one} and not other & one


def test_files_have_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(generator, "ROWS_PER_FILE", 20)
    made = generator.rows(spark, 3, 30)
    found = generator.files(made, 3, 30).cache()
    assert found.count() == 2 * (4 * 3 - 1) and found.select("path").distinct().count() == found.count()
    assert facts_of(found, "taobao").facts.agg(F.sum("gmv")).first()[0] == generator.manifest(made).where("platform_key = 'taobao'").agg(F.sum("gmv")).first()[0]


def test_written_files(spark, tmp_path):
    made = generator.files(generator.rows(spark, 3, 5), 3, 5)
    done = generator.write(made, f"file://{tmp_path}/drop").collect()
    assert {x.name for x in (tmp_path / "drop").iterdir()} == {r.path for r in done} and len(done) == 4
    assert all(hashlib.sha256((tmp_path / "drop" / r.path).read_bytes()).hexdigest() == r.sha256 for r in done)


def test_many_rows_need_no_loop(spark):
    """Half a million rows are one plan over one range."""
    made = generator.rows(spark, 35, 3500)
    assert made.count() == 4 * 35 * 3675 - 3675 + 4
    got = generator.manifest(made).agg(F.sum("rows"), F.sum("gmv")).first()
    assert got[0] == made.count() and got[1] > 0
