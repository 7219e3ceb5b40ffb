"""A store from files to reports and back."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallyhouse.engine import Engine
from tallyhouse.schema import FACTS, RetailError
from tallyhouse.sinks import texts
from tallyhouse.sources import files, generator, spec
from tallyhouse.streaming.drop_folder import scan, watch

HEAD = "统计日期,店铺名称,商品ID,商品名称,一级类目,支付金额,支付件数,退款金额,商品访客数,支付买家数,推广花费\n"
DAY = "2026-09-06"
TAOBAO = (HEAD + f"{DAY},店,K1,面霜,美妆,1000,10,100,200,8,50\n{DAY},店,B2,玻尿酸补水精华液,美妆,300,3,0,60,3,0\n{DAY},店,B2,玻尿酸补水精华液,美妆,100,1,0,6,1,0\n{DAY},店,C3,测试品,美妆,1,1,0,1,1,0\n{DAY},店,D4,x,美妆,N/A,1,0,1,1,0\n2026-09-05,店,K1,面霜,美妆,800,8,80,160,6,40\n").encode("gb18030")
PDD = ("统计日期,店铺名称,商品ID,商品名称,商品一级类目,成团金额(GMV),成团件数,退款金额,商品访客数,成团买家数,推广花费\n" + "".join(f"{DAY},店,P{i},名{i},食品,{i + 1}.50,1,0,5,1,0\n" for i in range(5)) + "说明一,,\n说明二,,\n").encode()


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}", "公司")
    e.add_sku("K1", "面霜", "美妆", cost_price="30")
    e.add_sku("S2", "玻尿酸精华液", "美妆", cost_price="20")
    return e


def test_lifecycle(engine):
    up = engine.ingest(TAOBAO, "生意参谋.csv")
    row = engine._upload(up)
    assert (row.platform_key, row.status, row.row_count_total, row.row_count_valid, row.row_count_error) == ("taobao", "parsed", 6, 3, 1)
    assert [e["error_type"] for e in engine.upload_errors(up)["items"]] == ["duplicate_row", "filtered_out", "number_parse_failed"]
    assert len(engine.preview(up)) == 3
    done = engine.commit(up)
    assert done["unmapped_codes"] == 1 and done["matched"] == {"mapping": 0, "exact": 1, "unmapped": 1} and done["latest_date"] == DAY
    assert engine.commit(up)["valid"] == 3 and engine.facts().count() == 3
    again = engine.ingest(TAOBAO, "copy.csv", "taobao")
    with pytest.raises(RetailError) as e:
        engine.commit(again)
    assert e.value.code == "DUPLICATE_UPLOAD_COMMITTED"
    engine.delete_upload(again)
    assert engine.uploads()["total"] == 1
    with pytest.raises(RetailError):
        engine.commit(again)


def test_identity(engine):
    got = engine.suggest().collect()
    assert [(r.platform_product_code, r.sku_code, r.band) for r in got] == [("B2", "S2", "medium")] and abs(got[0].score - 85.714) < 0.01
    assert engine.adopt() == 0
    engine.map_products([("taobao", "B2", 2)])
    assert engine.facts().where("sku_id = 2").count() == 1 and engine.mappings(match_type="confirmed")["total"] == 2
    with pytest.raises(RetailError):
        engine.map_products([("taobao", "B2", 99)])
    with pytest.raises(RetailError) as e:
        engine.delete_sku(2)
    assert e.value.code == "SKU_IN_USE"
    engine.clear_mapping("taobao", "B2")
    assert engine.facts().where("sku_id = 2").count() == 0 and engine.facts().count() == 3
    engine.delete_sku(2)
    assert engine.skus(q="面")["total"] == 1
    with pytest.raises(RetailError):
        engine.update_sku(1, name=None)


def test_report_and_sinks(engine):
    r = engine.generate_daily(DAY, at=dt.datetime(2026, 9, 7, 8))
    assert r["overview"]["gmv"] == 1400 and r["overview"]["gmv_dod"] == 0.75 and r["data_completeness"]["missing_platforms"] == ["doudian", "jd", "pinduoduo"]
    assert r["summary_text"].startswith("【公司电商销售日报】2026-09-06 周日\n\n◆ 整体\nGMV ¥1,400.00｜环比 +75.0%｜周同比 —\n") and len(r["summary_text"]) <= 800
    assert r["summary_text"].endswith("—— 由 电商日报工具 自动生成 2026-09-07 08:00") and "面霜" in texts.digest(r)
    book = files.Workbook(engine.daily_workbook(r))
    assert list(book.sheets) == ["日报总览", "分平台", "分店铺", "分类目", "分SKU", "异常预警", "口径说明"] and book.rows("日报总览")[3][:2] == ["GMV", "1400"]
    assert engine.history()["total"] == 1 and engine.stored_report(DAY)["overview"]["gmv"] == 1400
    week = engine.weekly_report(DAY)
    assert week["start_date"] == "2026-08-31" and week["totals"]["total_gmv"] == 2200 and "基数不足" in week["summary_text"] and len(files.Workbook(engine.weekly_workbook(week)).sheets) == 4
    with pytest.raises(RetailError):
        engine.daily_report("2020-01-01")
    with pytest.raises(RetailError):
        engine.daily_report("x")
    assert engine.daily_report(DAY, platforms=["taobao"], compare=False)["overview"]["gmv_dod"] is None
    many = dict(r, anomalies=[{"severity": "critical", "scope": "platform", "subject": "s", "message": "长" * 60}] * 30)
    assert len(texts.daily_summary(many, "公司")) <= 800


def test_round_trip(engine, spark, tmp_path):
    up = engine.ingest(PDD, "拼多多.csv")
    assert engine.commit(up)["valid"] == 5
    assert engine.history()["total"] == 0  # the stored report went with the new data
    out = {x["platform_key"]: x for x in engine.export_detail(DAY)}
    assert out["pinduoduo"]["row_count"] == 5 and out["pinduoduo"]["footer_rows"] == 2 and out["taobao"]["row_count"] == 2
    other = Engine(spark, f"file://{tmp_path}/other")
    for x in out.values():
        other.commit(other.ingest(x["content"], x["filename"], x["platform_key"]))
    total = lambda e: e.facts().where(f"stat_date = '{DAY}'").groupBy("platform_key").agg({"gmv": "sum", "paid_qty": "sum"}).orderBy("platform_key").collect()
    assert total(other) == total(engine)


def test_rules_and_channels(engine):
    assert len(engine.rules()) == 6
    engine.set_rule(4, threshold="0.01", enabled=True)
    assert any(a["scope"] == "overall" for a in engine.daily_report(DAY)["anomalies"])
    with pytest.raises(RetailError):
        engine.set_rule(99, enabled=False)
    import yaml

    own = spec._over(yaml.safe_load((spec.FOLDER / "defaults.yaml").read_text()), yaml.safe_load((spec.FOLDER / "taobao.yaml").read_text()))
    own["metric_semantics"]["platform_fee_rate"] = 0.1
    assert engine.save_adapter("taobao", yaml.safe_dump(own, allow_unicode=True)) == 2 and engine.save_adapter("taobao", yaml.safe_dump(own, allow_unicode=True)) == 3
    assert engine.adapter("taobao").metric_semantics["platform_fee_rate"] == 0.1
    assert engine.reset_adapter("taobao").metric_semantics["platform_fee_rate"] == 0 and engine.validate_adapter("a: 1")["valid"] is False
    assert engine.meta()["platforms"] == ["pinduoduo", "taobao"] and engine.latest_date() == DAY


def test_failed_upload(engine):
    up = engine.ingest(b"a,b\n1,2\n", "x.csv")
    assert engine._upload(up).status == "failed"
    engine.reparse(up, "taobao")
    assert "MISSING_REQUIRED_COLUMN" in engine._upload(up).error_message


def test_drop_folder(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "生意参谋1.csv").write_bytes(TAOBAO)
    (drop / "bad.xlsx").write_bytes(b"PK\x03\x04broken")
    (drop / "x.csv.part").write_bytes(TAOBAO)
    for _ in range(2):
        watch(e, str(drop), str(tmp_path / "checkpoint")).awaitTermination()
        (drop / "renamed.csv").write_bytes(TAOBAO)
    states = sorted((u["filename"], u["status"]) for u in e.uploads()["items"])
    assert [s for _, s in states] == ["failed", "committed"] and e.facts().count() == 3


def test_archive(spark, tmp_path):
    """Finished files move by outcome; a copy goes where its first went, and a later one is skipped."""
    e = Engine(spark, f"file://{tmp_path}/store")
    drop = archive = tmp_path / "drop"
    drop.mkdir()
    for name, raw in (("生意参谋1.csv", TAOBAO), ("bad.xlsx", b"PK\x03\x04broken"), ("worse.xlsx", b"PK\x03\x04broken"), ("x.csv.part", TAOBAO)):
        (drop / name).write_bytes(raw)
    for _ in range(2):
        watch(e, str(drop), str(tmp_path / "checkpoint"), archive=str(archive)).awaitTermination()
        (drop / "again.csv").write_bytes(TAOBAO)
    assert [(r["file"], r["status"]) for r in scan(e, str(drop))] == [("again.csv", "skipped")] and scan(e, str(drop)) == []
    names = {f: sorted(x.name.split("_", 3)[3] for x in (archive / f).glob("[0-9]*")) for f in ("processed", "failed")}
    assert names["failed"] == ["bad.xlsx", "worse.xlsx"] and set(names["processed"]) == {"again.csv", "生意参谋1.csv"}
    assert [x.name for x in drop.glob("*.*") if x.is_file()] == ["x.csv.part"]
    assert e.facts().count() == 3 and e.uploads()["total"] == 2
    assert [(s["filename"], s["row_count_valid"]) for s in e.sources(DAY)] == [("生意参谋1.csv", 3)] and e.sources("2020-01-01") == []
    up = e.ingest(PDD, "拼多多.csv")
    got = e.commit_all([up, 99])
    assert (got["valid"], got["unmapped_codes"], got["latest_date"], got["committed"]) == (5, 5, DAY, 1) and got["failed"][0]["upload_id"] == 99


def jobs(spark, run):
    """Spark jobs of a call, and what it returns."""
    spark.sparkContext.setJobGroup(f"count-{id(run)}", "count")
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"count-{id(run)}"))
    spark.sparkContext.setJobGroup("", "")
    return n, out


def test_many_files_at_once(spark, tmp_path):
    """A folder of generated files, one that is broken, one of another layout and a copy: facts reach the manifest, with as many jobs as for fewer files."""
    days, skus = 6, 12
    made = generator.rows(spark, days, skus)
    counts = []
    for name, rows_per_file in (("few", 1000), ("many", 30)):
        generator.ROWS_PER_FILE, before = rows_per_file, generator.ROWS_PER_FILE
        try:
            generator.write(generator.files(made, days, skus), f"file://{tmp_path}/{name}").collect()
        finally:
            generator.ROWS_PER_FILE = before
        drop = tmp_path / name
        (drop / "bad.xlsx").write_bytes(b"PK\x03\x04broken")
        (drop / "none.csv").write_bytes(b"a,b\n1,2\n")
        (drop / "other.csv").write_bytes("商品ID,统计日期,支付金额\nZ1,2026-01-01,7.5\n".encode())
        e = Engine(spark, f"file://{tmp_path}/store-{name}")
        n, out = jobs(spark, lambda e=e, drop=drop: scan(e, str(drop)))
        counts.append((n, len(out)))
        assert {r["status"] for r in out} == {"committed", "failed"} and sorted(r["file"] for r in out if r["status"] == "failed") == ["bad.xlsx", "none.csv"]
        assert all(r["moved"] for r in out)
        want = generator.manifest(made).groupBy("platform_key").agg(F.sum("gmv").alias("gmv"), F.sum("paid_qty").alias("qty"), (F.sum("rows") - F.sum("filtered") - F.sum("failed") - F.sum("duplicated")).alias("n"))
        got = e.facts().where("stat_date > '2026-02-01'").groupBy("platform_key").agg(F.sum("gmv").alias("gmv"), F.sum("paid_qty").alias("qty"), F.count("*").alias("n"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert e.facts().where("platform_product_code = 'Z1' and gmv = 7.5 and visitors is null").count() == 1
        state = {u["filename"]: u for u in e.uploads(size=100)["items"]}
        assert sum(u["row_count_total"] or 0 for u in state.values() if u["status"] == "committed") == made.count() + 1
        assert sum(u["row_count_error"] or 0 for u in state.values()) == 0 and sum(r["count"] for r in e.store.table("upload_errors").groupBy("error_type").count().collect()) == 7
        assert e.mappings(match_type="unmapped")["total"] == e.facts().select("platform_key", "platform_product_code").distinct().count()
    (a, few), (b, many) = counts
    assert many > 2 * few - 4 and b <= a + 6


def test_stopped_batch_is_taken_up(spark, tmp_path, monkeypatch):
    """A batch that stops before its facts are in runs again under the same numbers, and nothing is there twice."""
    e = Engine(spark, f"file://{tmp_path}/store")
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "生意参谋1.csv").write_bytes(TAOBAO)
    (drop / "拼多多.csv").write_bytes(PDD)
    with monkeypatch.context() as m:
        m.setattr(Engine, "_commit_facts", lambda self, facts: 1 / 0)
        with pytest.raises(StreamingQueryException):
            watch(e, str(drop), str(tmp_path / "checkpoint")).awaitTermination()
    assert [u["status"] for u in e.uploads()["items"]] == ["parsing"] * 2 and e.facts().count() == 0
    for _ in range(2):
        watch(e, str(drop), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((u["id"], u["status"]) for u in e.uploads()["items"]) == [(1, "committed"), (2, "committed")] and e.facts().count() == 8


def test_backfill_is_one_write(spark, tmp_path):
    """Hundreds of uploads with a product get its SKU by as many jobs as one, and other partitions stay as they are."""
    e = Engine(spark, f"file://{tmp_path}/store")
    e.add_sku("K1", "a")
    columns = {f.name: F.lit(None).cast(f.dataType) for f in FACTS}
    own = {"row_no": F.lit(1).cast("long"), "stat_date": F.lit(DAY).cast("date"), "platform_key": F.lit("taobao"), "shop_code": F.lit("s"), "gmv": F.lit(1).cast("decimal(14,2)")}
    facts = spark.range(300).withColumns({"upload_id": F.col("id"), "platform_product_code": F.when(F.col("id") % 3 == 0, "A").otherwise("B")})
    e.store.put_uploads("sales_facts", facts.select(*[F.col(n) if n in facts.columns else own.get(n, c).alias(n) for n, c in columns.items()]))
    stamp = lambda k: {p.name: p.stat().st_mtime_ns for p in (tmp_path / f"store/sales_facts/upload_id={k}").glob("*.parquet")}
    other, own_file = stamp(1), stamp(3)
    n, _ = jobs(spark, lambda: e.map_products([("taobao", "A", 1)]))
    assert n < 40 and stamp(1) == other and stamp(3) != own_file
    assert e.facts().where("sku_id = 1").count() == 100 and e.facts().count() == 300
    e.clear_mapping("taobao", "A")
    assert e.facts().where("sku_id is not null").count() == 0 and e.facts().count() == 300


def test_days_choose_uploads(spark, tmp_path):
    """A report's window reads the partitions of uploads that have such days, and only those; moved and dropped uploads stay right."""
    e = Engine(spark, f"file://{tmp_path}/store")
    rows = "".join(f"2026-01-{d:02d},店,K{d},面霜,美妆,{d},1,0,1,1,0\n" for d in (1, 2))
    for m in range(1, 5):
        e.commit(e.ingest((HEAD + rows.replace("2026-01", f"2026-{m:02d}")).encode("gb18030"), f"生意参谋{m}.csv", "taobao"))
    got = e.store.facts_between(dt.date(2026, 3, 1), dt.date(2026, 3, 31))
    assert sorted(r.upload_id for r in got.collect()) == [3, 3] and e.store.facts_between(dt.date(2026, 1, 2), dt.date(2026, 2, 1)).count() == 2
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    e.map_products([("taobao", "K1", None)])
    e.delete_facts(3)
    assert got.sparkSession is spark and e.store.facts_between(dt.date(2026, 3, 1), dt.date(2026, 3, 31)).count() == 0
    assert [x["row_count"] for x in e.export_detail("2026-02-02")] == [1] and e.daily_report("2026-02-02")["overview"]["gmv"] == 2
