"""The engine's surface: ingesting files, keeping tables, and answering reports.

Every answer is computed by DataFrames; only finished sections, which are small, are collected into documents.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import anomaly, identity
from tallyhouse.operators.metrics import with_costs
from tallyhouse.operators.normalize import Normalised, cast_counts, error_counts, finished, normalise, observed_stats, typed
from tallyhouse.plans import daily, listing, sections, weekly
from tallyhouse.schema import CHANNELS, DEFAULT_RULES, WEEKDAYS, RetailError
from tallyhouse.sinks import detail, texts
from tallyhouse.sinks.xlsx import workbook
from tallyhouse.sources import files, generator, spec
from tallyhouse.store import Store


def date_of(text: str) -> dt.date:
    try:
        return dt.date.fromisoformat(text)
    except (TypeError, ValueError) as e:
        raise RetailError("INVALID_DATE", f"{text!r} is not YYYY-MM-DD") from e


def plain(v: object) -> object:
    if isinstance(v, dt.date):
        return v.isoformat()
    return float(v) if isinstance(v, Decimal) else v


def collected(df: DataFrame) -> list[dict]:
    return [{k: plain(v) for k, v in r.asDict(recursive=True).items()} for r in df.collect()]


class Engine:
    def __init__(self, spark: SparkSession, root: str, company: str = "") -> None:
        self.spark, self.store, self.company = spark, Store(spark, root), company
        self._seed()

    def _seed(self) -> None:
        """The default rules that the store lacks, by name."""
        have = {r["name"] for r in self.store.table("anomaly_rules").select("name").collect()}
        first = self.store.next_id("anomaly_rules")
        new = [(first + i, n, m, s, o, Decimal(t), Decimal(b), True) for i, (n, m, s, o, t, b) in enumerate(r for r in DEFAULT_RULES if r[0] not in have)]
        if new:
            self._save("anomaly_rules", self.store.table("anomaly_rules").unionByName(self.store.rows("anomaly_rules", new)))

    def _save(self, name: str, df: DataFrame) -> None:
        with self.store.writing():
            self.store.replace(name, df)

    # channels
    def adapters(self) -> dict[str, spec.Spec]:
        """Built-in channels under the enabled overrides; a broken override is left out."""
        out = {k: spec.builtin(k) for k in spec.builtin_keys()}
        for r in self.store.table("adapter_configs").where("enabled").collect():
            try:
                out[r.platform_key] = spec.from_yaml(r.yaml_text)
            except RetailError:
                continue
        return out

    def adapter(self, key: str) -> spec.Spec:
        found = self.adapters().get(key)
        if found is None:
            raise RetailError("ADAPTER_NOT_FOUND", f"no channel {key!r}")
        return found

    def validate_adapter(self, text: str) -> dict:
        try:
            return {"valid": True, "errors": [], "warnings": spec.advice(spec.from_yaml(text))}
        except RetailError as e:
            return {"valid": False, "errors": e.detail.get("errors", [e.message]), "warnings": []}

    def save_adapter(self, key: str, text: str) -> int:
        """Store an override; its version is one more than the last, or than the built-in one."""
        if spec.from_yaml(text).platform_key != key:
            raise RetailError("ADAPTER_CONFIG_INVALID", f"the specification isn't for {key!r}")
        old = self.store.table("adapter_configs")
        last = old.where(F.col("platform_key") == key).agg(F.max("version")).first()[0]
        own = key in spec.builtin_keys()
        version = (last if last is not None else spec.builtin(key).adapter_version if own else 0) + 1
        self._save("adapter_configs", old.where(F.col("platform_key") != key).unionByName(self.store.rows("adapter_configs", [(key, version, text, own, True)])))
        return version

    def reset_adapter(self, key: str) -> spec.Spec:
        old = self.store.table("adapter_configs")
        self._save("adapter_configs", old.where(F.col("platform_key") != key))
        return spec.builtin(key)

    def channels(self) -> DataFrame:
        rows = [(k, s.display_name, Decimal(str(s.metric_semantics["platform_fee_rate"])), Decimal(str(s.metric_semantics["fulfillment_cost_per_unit"])), bool(s.metric_semantics["gmv_includes_shipping"])) for k, s in self.adapters().items()]
        return self.spark.createDataFrame(rows, CHANNELS)

    # uploads
    def _upload(self, upload_id: int):
        row = self.store.table("uploads").where(F.col("id") == upload_id).first()
        if row is None:
            raise RetailError("UPLOAD_NOT_FOUND", f"no upload {upload_id}")
        return row

    def _set_upload(self, **values) -> None:
        self._set_uploads([values])

    def _set_uploads(self, changes: list[dict]) -> None:
        """Values of uploads by id, over those they have; one snapshot."""
        old = self.store.table("uploads")
        ids = [c["id"] for c in changes]
        before = {r.id: r.asDict() for r in old.where(F.col("id").isin(ids)).collect()}
        rows = [before.get(c["id"], {}) | c for c in changes]
        names = old.columns
        for row in rows:
            row["version"] = (row.get("version") or 0) + 1
        self._save("uploads", old.where(~F.col("id").isin(ids)).unionByName(self.store.rows("uploads", [tuple(row.get(n) for n in names) for row in rows])))

    def _parsed(self, upload_id: int, platform_key: str | None) -> tuple[Normalised, spec.Spec, dict]:
        """Parse an upload's stored file with the current specification of its channel. The counts of cast rows are observed while they are staged."""
        raw = self.store.table("raw_files").where(F.col("upload_id") == upload_id)
        one = raw.select(F.col("filename").alias("path"), "content", "sha256")
        if platform_key is None:
            probe = self._first(files.parsed(one, self._probe()))
            ranked = spec.detect(probe["header"], probe["path"])
            if not ranked or not ranked[0]["score"]:
                raise RetailError("ADAPTER_NOT_FOUND", "the file's channel can't be told", {"candidates": ranked})
            platform_key = ranked[0]["platform_key"]
        own = self.adapter(platform_key)
        rows = files.parsed(one, own.file_matching)
        first = self._first(rows)
        seen: dict = {}

        def keep(cast: DataFrame) -> DataFrame:
            return self.store.staged(f"staging/{upload_id}", cast, cast_counts(), seen)

        return normalise(rows.where("cells is not null").select("row_no", "cells"), first["header"], own, upload_id, keep), own, seen

    @staticmethod
    def _probe() -> spec.FileMatching:
        every = [spec.builtin(k).file_matching for k in spec.builtin_keys()]
        return spec.FileMatching(extensions=list(files.EXTENSIONS), encoding_candidates=["utf-8-sig", "utf-8", "gb18030", "gbk"], auto_header_hints=sorted({h for f in every for h in f.auto_header_hints}))

    @staticmethod
    def _first(rows: DataFrame) -> dict:
        row = rows.first().asDict()
        if row["error_code"]:
            raise RetailError(row["error_code"], row["error_message"])
        return row

    def ingest(self, raw: bytes, filename: str, platform_key: str | None = None) -> int:
        """Register a file and parse it; errors are stored, facts aren't yet. A file that fails stays for another try."""
        upload_id = self.store.next_id("uploads")
        digest = hashlib.sha256(raw).hexdigest()
        with self.store.writing():
            self.store.put_upload("raw_files", upload_id, self.spark.createDataFrame([(upload_id, filename, digest, bytearray(raw))], "upload_id long, filename string, sha256 string, content binary"))
        self._set_upload(id=upload_id, filename=filename, sha256=digest, platform_key=platform_key, status="parsing", created_at=dt.datetime.now())
        self._stage(upload_id, platform_key)
        return upload_id

    def ingest_files(self, found: DataFrame, listed: list[tuple[str, str]], auto_commit: bool = True) -> list[dict]:
        """Register, parse and, if asked, commit many files: the jobs go with the number of channels, not of files.

        found: path, sha256 and content. listed: path and sha256 of each, in the order in which they get numbers. Contents
        and rows stay with the executors; the driver sees paths, headers and counts. A file that fails is recorded and
        does not stop the others. What a run that was stopped had begun is taken up under the same numbers.
        """
        if not listed:
            return []
        table = self.spark.createDataFrame(listed, "path string, sha256 string")
        begun = {r.sha256: r.id for r in self.store.table("uploads").where("status = 'parsing'").join(table.select("sha256"), "sha256", "left_semi").collect()}
        free = self.store.next_id("uploads")
        uploads = {}
        for path, digest in listed:
            number = begun.get(digest, free)
            free += number == free
            uploads[number] = {"id": number, "path": path, "filename": path.rpartition("/")[2], "sha256": digest, "status": "parsing", "created_at": dt.datetime.now()}
        self._set_uploads(list(uploads.values()))
        ids = self.spark.createDataFrame([(u["path"], n, u["filename"]) for n, u in uploads.items()], "path string, upload_id long, filename string")
        with self.store.writing():
            self.store.put_uploads("raw_files", found.select("path", "sha256", "content").join(ids, "path").select("upload_id", "filename", "sha256", "content"))
        stored = lambda some: self.store.table("raw_files").where(F.col("upload_id").isin(some)).select(F.concat_ws("/", "upload_id", "filename").alias("path"), "content", "sha256")

        def failed(numbers: list[int], code: str, message: str) -> None:
            for n in numbers:
                uploads[n] |= {"status": "failed", "error_message": f"{code}: {message}"}

        channels: dict[str, list[int]] = {}
        for head in files.parsed(stored(list(uploads)), self._probe(), heads=True).select("path", "header", "error_code", "error_message").collect():
            n, _, name = head.path.partition("/")
            ranked = spec.detect(head.header, name) if head.error_code is None else []
            if head.error_code:
                failed([int(n)], head.error_code, head.error_message)
            elif not ranked or not ranked[0]["score"]:
                failed([int(n)], "ADAPTER_NOT_FOUND", "the file's channel can't be told")
            else:
                channels.setdefault(ranked[0]["platform_key"], []).append(int(n))
        place, facts = f"staging/files-{min(uploads)}", None
        for key, numbers in sorted(channels.items()):
            own = self.adapter(key)
            read = files.parsed(stored(numbers), own.file_matching).withColumn("upload_id", F.split("path", "/")[0].cast("long"))
            rows = self.store.staged(f"{place}/{key}/rows", read.select("upload_id", "row_no", "header", "cells", "error_code", "error_message"))
            headers: dict[tuple, list[int]] = {}
            for r in rows.groupBy("upload_id").agg(F.first("header", True).alias("header"), F.max("error_code").alias("code"), F.max("error_message").alias("message")).collect():
                uploads[r.upload_id] |= {"platform_key": key, "adapter_version": own.adapter_version}
                if r.code:
                    failed([r.upload_id], r.code, r.message)
                else:
                    headers.setdefault(tuple(r.header), []).append(r.upload_id)
            every = None
            for header, some in sorted(headers.items()):
                try:
                    part = typed(rows.where(F.col("upload_id").isin(some) & F.col("cells").isNotNull()).select("upload_id", "row_no", "cells"), list(header), own, ("upload_id",))
                except RetailError as e:
                    failed(some, e.code, e.message)
                    continue
                for n in some:
                    uploads[n] |= {"status": "parsed", "row_count_total": 0, "row_count_valid": 0, "row_count_error": 0, "error_message": None}
                every = part if every is None else every.unionByName(part, allowMissingColumns=True)
            if every is None:
                continue
            cast = self.store.staged(f"{place}/{key}/typed", every)
            done = finished(cast, own)
            sold = self.store.staged(f"{place}/{key}/facts", done.facts)
            bad = self.store.staged(f"{place}/{key}/errors", done.errors)
            with self.store.writing():
                self.store.put_uploads("upload_errors", bad)
            counts = [cast.select("upload_id", F.lit("row_count_total").alias("what")), sold.select("upload_id", F.lit("row_count_valid").alias("what")), bad.where(F.col("error_type").isin("number_parse_failed", "date_parse_failed")).select("upload_id", F.lit("row_count_error").alias("what"))]
            for r in counts[0].union(counts[1]).union(counts[2]).groupBy("upload_id", "what").count().collect():
                uploads[r.upload_id][r.what] = r["count"]
            facts = sold if facts is None else facts.unionByName(sold)
        if auto_commit and facts is not None:
            self._commit_facts(facts)
            for u in uploads.values():
                u["status"] = "committed" if u["status"] == "parsed" else u["status"]
        self._set_uploads(list(uploads.values()))
        self.store.remove(place)
        return [{"file": u["filename"], "path": u["path"], "upload_id": u["id"], "status": u["status"]} | ({"error": u["error_message"]} if u["status"] != "committed" else {}) for u in uploads.values()]

    def _commit_facts(self, facts: DataFrame) -> None:
        """Put the facts of new uploads in, with SKUs, and their products among the mappings."""
        found, codes = identity.attach(facts, self.store.table("sku_mappings"), self.store.table("skus"))
        changes = codes.where("match_type <> 'mapping'").withColumn("confidence", F.when(F.col("sku_id").isNotNull(), 1).otherwise(0).cast("decimal(5,4)"))
        with self.store.writing():
            self._drop_reports(facts.select("stat_date"), locked=True)
            self.store.put_uploads("sales_facts", found)
            self.store.replace("sku_mappings", identity.upserted(self.store.table("sku_mappings"), changes))

    def _stage(self, upload_id: int, platform_key: str | None) -> None:
        try:
            done, own, cast = self._parsed(upload_id, platform_key)
        except RetailError as e:
            self._set_upload(id=upload_id, status="failed", error_message=f"{e.code}: {e.message}")
            return
        with self.store.writing():
            stats = observed_stats(cast, self.store.put_upload("upload_errors", upload_id, done.errors, error_counts()))
        self._set_upload(id=upload_id, platform_key=own.platform_key, adapter_version=own.adapter_version, status="parsed", row_count_total=stats["total"], row_count_valid=stats["valid"], row_count_error=stats["failed"], error_message=None)

    def sources(self, date: str) -> list[dict]:
        """The uploads that a day's rows came from, by file name."""
        found = daily.sources(self.store.table("sales_facts"), self.store.table("uploads"), date_of(date)).orderBy("filename", "id")
        return collected(found.select("filename", "platform_key", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_at"), "row_count_total", "row_count_valid"))

    def commit_all(self, upload_ids: list[int]) -> dict:
        """Commit each upload; one that fails does not stop the others. Totals are over those that went in."""
        done, failed = [], []
        for upload_id in upload_ids:
            try:
                done.append(self.commit(upload_id))
            except RetailError as e:
                failed.append({"upload_id": upload_id, "error": f"{e.code}: {e.message}"})
        total = {k: sum(r[k] for r in done) for k in ("valid", "unmapped_codes")}
        return total | {"latest_date": max((r["latest_date"] for r in done if r["latest_date"]), default=None), "committed": len(done), "failed": failed}

    def preview(self, upload_id: int, n: int = 20) -> list[dict]:
        done, _, _ = self._parsed(upload_id, self._upload(upload_id).platform_key)
        return [{k: None if v is None else str(v) for k, v in r.asDict().items()} for r in done.facts.orderBy("row_no").limit(n).collect()]

    def commit(self, upload_id: int, force: bool = False) -> dict:
        """Parse anew and replace the upload's facts; a file committed before is refused unless forced."""
        up = self._upload(upload_id)
        same = self.store.table("uploads").where((F.col("sha256") == up.sha256) & (F.col("id") != upload_id) & (F.col("status") == "committed"))
        if not force and (other := same.first()) is not None:
            raise RetailError("DUPLICATE_UPLOAD_COMMITTED", f"upload {other.id} has the same content", {"upload_id": other.id})
        done, own, cast = self._parsed(upload_id, up.platform_key)
        facts, codes = identity.attach(done.facts, self.store.table("sku_mappings"), self.store.table("skus"))
        self._drop_reports(done.facts.select("stat_date"))
        with self.store.writing():
            stats = observed_stats(cast, self.store.put_upload("upload_errors", upload_id, done.errors, error_counts()))
            if up.status == "committed":
                self._drop_reports(self.store.table("sales_facts").where(F.col("upload_id") == upload_id).select("stat_date"), locked=True)
            stats["valid"] = (sold := self.store.put_upload("sales_facts", upload_id, facts, {"last": F.max("stat_date")}))["rows"]
            matched = {r.match_type: r.codes for r in identity.match_counts(codes).collect()}
            changes = codes.where("match_type <> 'mapping'").withColumn("confidence", F.when(F.col("sku_id").isNotNull(), 1).otherwise(0).cast("decimal(5,4)"))
            self.store.replace("sku_mappings", identity.upserted(self.store.table("sku_mappings"), changes))
        self._set_upload(id=upload_id, status="committed", row_count_total=stats["total"], row_count_valid=stats["valid"], row_count_error=stats["failed"])
        return stats | {"latest_date": plain(sold["last"]), "unmapped_codes": matched.get("unmapped", 0), "matched": {k: matched.get(k, 0) for k in ("mapping", "exact", "unmapped")}}

    def _changes(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, "platform_key string, platform_product_code string, platform_product_name string, sku_id long, match_type string, confidence decimal(5,4)")

    def _drop_reports(self, dates: DataFrame, locked: bool = False) -> None:
        """Stored reports of these dates no longer hold."""
        old = self.store.table("daily_reports")
        kept = old.join(dates.distinct(), old.report_date == dates.stat_date, "left_anti")
        if locked:
            self.store.replace("daily_reports", kept)
        else:
            self._save("daily_reports", kept)

    def reparse(self, upload_id: int, platform_key: str | None = None) -> None:
        """Stage again, as another channel if one is given; committed facts of the upload go."""
        up = self._upload(upload_id)
        if up.status == "committed":
            self.delete_facts(upload_id)
        self._stage(upload_id, platform_key or up.platform_key)

    def delete_facts(self, upload_id: int) -> None:
        self._drop_reports(self.store.table("sales_facts").where(F.col("upload_id") == upload_id).select("stat_date"))
        with self.store.writing():
            self.store.drop_upload("sales_facts", upload_id)

    def delete_upload(self, upload_id: int) -> None:
        self._upload(upload_id)
        self.delete_facts(upload_id)
        with self.store.writing():
            for t in ("upload_errors", "raw_files"):
                self.store.drop_upload(t, upload_id)
            self.store.remove(f"staging/{upload_id}")
            self.store.replace("uploads", self.store.table("uploads").where(F.col("id") != upload_id))

    def uploads(self, status: str | None = None, platform_key: str | None = None, page: int = 1, size: int = 20) -> dict:
        got = self.store.table("uploads")
        for c, v in (("status", status), ("platform_key", platform_key)):
            got = got if v is None else got.where(F.col(c) == v)
        return page_of(got, [F.desc("id")], page, size)

    def upload_errors(self, upload_id: int, page: int = 1, size: int = 50) -> dict:
        return page_of(self.store.table("upload_errors").where(F.col("upload_id") == upload_id), [F.asc("row_number"), F.asc("error_type")], page, size)

    # SKUs and mappings
    def skus(self, q: str | None = None, category: str | None = None, status: str | None = None, page: int = 1, size: int = 50) -> dict:
        got = self.store.table("skus")
        if q:
            got = listing.searched(got, name=q, sku_code=q)
        for c, v in (("category", category), ("status", status)):
            got = got if v is None else got.where(F.col(c) == v)
        return page_of(got, [F.asc("id")], page, size)

    def add_sku(self, sku_code: str, name: str, category: str | None = None, brand: str | None = None, cost_price: str | None = None, status: str = "active") -> int:
        old = self.store.table("skus")
        if not old.where(F.col("sku_code") == sku_code).isEmpty():
            raise RetailError("VALIDATION_ERROR", f"SKU code {sku_code!r} exists")
        new = self.store.next_id("skus")
        self._save("skus", old.unionByName(self.store.rows("skus", [(new, sku_code, name, category, brand, None if cost_price is None else Decimal(cost_price), status)])))
        return new

    def update_sku(self, sku_id: int, **values) -> None:
        if any(k in values and values[k] is None for k in ("name", "status", "sku_code")):
            raise RetailError("VALIDATION_ERROR", "name, code and status can't be empty")
        self._require_skus([sku_id])
        old = self.store.table("skus")
        changed = old.withColumns({k: F.when(F.col("id") == sku_id, F.lit(v).cast(old.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()})
        self._save("skus", changed)

    def delete_sku(self, sku_id: int) -> None:
        self._require_skus([sku_id])
        if any(self.sku_references(sku_id).values()):
            raise RetailError("SKU_IN_USE", f"SKU {sku_id} is mapped or has sales", self.sku_references(sku_id))
        self._save("skus", self.store.table("skus").where(F.col("id") != sku_id))

    def sku_references(self, sku_id: int) -> dict:
        return {"mappings": self.store.table("sku_mappings").where(F.col("sku_id") == sku_id).count(), "facts": self.store.table("sales_facts").where(F.col("sku_id") == sku_id).count()}

    def _require_skus(self, ids: list[int]) -> None:
        asked = self.spark.createDataFrame([(i,) for i in ids], "id long")
        if missing := [r.id for r in listing.missing(asked, self.store.table("skus")).collect()]:
            raise RetailError("SKU_NOT_FOUND", f"no SKU {missing}", {"missing": missing})

    def mappings(self, q: str | None = None, platform_key: str | None = None, match_type: str | None = None, page: int = 1, size: int = 50) -> dict:
        got = self.store.table("sku_mappings")
        if q:
            got = listing.searched(got, platform_product_name=q, platform_product_code=q)
        if platform_key:
            got = got.where(F.col("platform_key") == platform_key)
        if match_type:
            got = got.where("sku_id is not null" if match_type == "confirmed" else F.col("match_type") == match_type)
        return page_of(listing.with_skus(got, self.store.table("skus")), [F.asc("id")], page, size)

    def map_products(self, pairs: list[tuple[str, str, int | None]], match_type: str = "manual", confidence: float = 1.0) -> int:
        """Map (platform_key, code) to SKUs, all or none, and write the SKU into committed facts. Counts pairs."""
        self._require_skus(sorted({s for *_, s in pairs if s is not None}))
        changes = self._changes([(k, c, None, s, match_type, Decimal(str(confidence))) for k, c, s in pairs])
        with self.store.writing():
            self.store.replace("sku_mappings", identity.upserted(self.store.table("sku_mappings"), changes))
            self._backfill(changes.where("sku_id is not null").select("platform_key", "platform_product_code", F.col("sku_id").alias("_new")))
        return len(pairs)

    def clear_mapping(self, platform_key: str, code: str) -> None:
        """Back to unmapped; facts lose the SKU only where they have the one that was mapped."""
        with self.store.writing():
            old = self.store.table("sku_mappings")
            at = (F.col("platform_key") == platform_key) & (F.col("platform_product_code") == code)
            before = old.where(at).select("platform_key", "platform_product_code", F.lit(None).cast("long"), "sku_id").collect()
            was = self.spark.createDataFrame(before, "platform_key string, platform_product_code string, _new long, _old long")
            self.store.replace("sku_mappings", old.withColumns({"sku_id": F.when(~at, F.col("sku_id")), "match_type": F.when(at, "unmapped").otherwise(F.col("match_type")), "confidence": F.when(at, F.lit(0)).otherwise(F.col("confidence"))}))
            self._backfill(was, only_old=True)

    def _backfill(self, changes: DataFrame, only_old: bool = False) -> None:
        """Rewrite the upload partitions that hold the changed codes, and no others, by one write. Runs under the writer's lock."""
        self.store.put_uploads("sales_facts", identity.backfilled(self.store.table("sales_facts"), changes, only_old), new_days=False)

    def suggest(self, k: int = 3) -> DataFrame:
        """Likely SKUs of unmapped products."""
        free = self.store.table("sku_mappings").where("sku_id is null").select("platform_key", "platform_product_code", F.col("platform_product_name").alias("product_name"))
        known = self.store.table("sales_facts").where("category is not null").groupBy("platform_key", "platform_product_code").agg(F.min("category").alias("category"))
        return identity.candidates(free.join(known, ["platform_key", "platform_product_code"], "left"), self.store.table("skus"), k)

    def adopt(self, least: float = identity.HIGH) -> int:
        """Take the best suggestion of each product that scores at least ``least``, whatever its category."""
        free = self.store.table("sku_mappings").where("sku_id is null").select("platform_key", "platform_product_code", F.col("platform_product_name").alias("product_name"), F.lit(None).cast("string").alias("category"))
        best = identity.candidates(free, self.store.table("skus"), 1, least).collect()
        return self.map_products([(r.platform_key, r.platform_product_code, r.sku_id) for r in best], "fuzzy", 0.9) if best else 0

    # rules and lists
    def rules(self) -> list[dict]:
        return collected(self.store.table("anomaly_rules").orderBy("id"))

    def set_rule(self, rule_id: int, **values) -> None:
        old = self.store.table("anomaly_rules")
        if old.where(F.col("id") == rule_id).isEmpty():
            raise RetailError("ANOMALY_RULE_NOT_FOUND", f"no rule {rule_id}")
        if bad := set(values) - {"name", "threshold", "min_base", "enabled"}:
            raise RetailError("VALIDATION_ERROR", f"{sorted(bad)} can't be changed")
        self._save("anomaly_rules", old.withColumns({k: F.when(F.col("id") == rule_id, F.lit(v).cast(old.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()}))

    def meta(self) -> dict:
        facts = self.store.table("sales_facts")
        one = lambda c: [r[0] for r in listing.values(facts, c).orderBy(c).collect()]
        return {"platforms": one("platform_key"), "categories": one("category"), "shops": one("shop_name")}

    def latest_date(self) -> str | None:
        return plain(self.store.table("sales_facts").agg(F.max("stat_date")).first()[0])

    # reports
    def facts(self, rounded: bool = True, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """Costed facts, of all days or of those from first to last, for which only uploads with such days are read."""
        found = self.store.table("sales_facts") if first is None else self.store.facts_between(first, last)
        return with_costs(found, self.store.table("skus"), self.channels(), rounded)

    def daily_report(self, date: str, platforms: list[str] | None = None, shops: list[str] | None = None, compare: bool = True) -> dict:
        """The whole report of a day. The window's rows are cached, and so are the groups' sums, which all sections over a dimension and the alerts are made of."""
        day, channels, skus = date_of(date), self.channels(), self.store.table("skus")
        facts = daily.scoped(daily.in_window(self.facts(first=day - dt.timedelta(days=daily.WINDOW_DAYS - 1), last=day), day), platforms, shops).cache()
        sums = sections.sums(facts, channels, day).cache()
        try:
            if facts.where(F.col("stat_date") == F.lit(day)).isEmpty():
                raise RetailError("NO_DATA_FOR_DATE", f"no sales on {day}", {"report_date": date})
            part = sections.parts(sums, channels, skus, compare)
            overview = collected(part["overall"])[0] | collected(daily.rolling_refund(facts, day))[0]
            if not compare:
                overview |= {k: None for k in ("refund_rate_7d_dod_pp", "refund_rate_7d_wow_pp")}
            missing = collected(daily.missing_platforms(facts, channels, day).where(F.col("platform_key").isin(*spec.builtin_keys())).orderBy("platform_key"))
            coverage = collected(daily.cost_coverage(facts, day))[0]["cost_coverage"]
            warnings = [f"缺失 {len(missing)} 个平台数据，合计值不完整：{'、'.join(m['display_name'] for m in missing)}"] if missing else []
            if coverage is not None and coverage < 0.999:
                warnings.append(f"仅 {coverage * 100:.1f}% 的成交额有成本价，毛利/经营利润只统计了这部分商品（去 SKU 管理补成本价）")
            by_net = [F.coalesce("net_amount", F.lit(0.0)).desc()]
            mapped = part["sku"].cache()
            trend = collected(daily.trend(facts, day).orderBy("stat_date"))
            names = channels.select(F.col("platform_key").alias("_k"), "display_name")
            subjects = anomaly.subjects_of(sections.of(sums, "overall"), "overall", F.lit("整体"), compare)
            by_channel = anomaly.subjects_of(sections.of(sums, "platform"), "platform", F.col("platform_key"), compare).join(names, F.col("subject") == F.col("_k"), "left").withColumn("subject", daily.shown(F.col("subject"), F.col("display_name")))
            by_sku = anomaly.subjects_of(sections.of(sums, "sku"), "sku", F.col("sku_id"), compare).join(skus.select(F.col("id").alias("_id"), "sku_code", "name"), F.col("subject") == F.col("_id"), "left").withColumn("subject", F.coalesce(F.concat_ws(" ", F.col("sku_code"), F.col("name")), F.concat(F.lit("SKU#"), F.col("subject").cast("string"))))
            context = subjects
            for more in (by_channel, by_sku):
                context = context.unionByName(more.select(*subjects.columns))
            present = [r[0] for r in facts.where(F.col("stat_date") == F.lit(day)).select("platform_key").distinct().orderBy("platform_key").collect()]
            report = {
                "report_date": date, "weekday": WEEKDAYS[day.weekday()], "compare_dates": {"dod": str(day - dt.timedelta(days=1)), "wow": str(day - dt.timedelta(days=7))},
                "data_completeness": {"expected_platforms": spec.builtin_keys(), "present_platforms": present, "missing_platforms": [m["platform_key"] for m in missing], "warning": "；".join(warnings) or None, "cost_coverage": coverage},
                "overview": overview, "overview_values": {r.pop("metric"): r for r in collected(daily.values_of(sections.of(sums, "overall")))}, "note": collected(daily.shipping_note(facts, channels, day))[0]["note"],
                "diagnosis": texts.explained(collected(daily.gmv_attribution(facts, day))[0]) if compare else None,
                "by_platform": collected(part["platform"].orderBy(*by_net, F.asc_nulls_last("platform_key"))),
                "by_shop": collected(part["shop"].orderBy(*by_net, *[F.asc_nulls_last(c) for c in ("platform_key", "shop_code", "shop_name")])),
                "by_category": collected(part["category"].orderBy(*by_net, F.asc_nulls_last("category"))),
                "by_sku": {"mapped": collected(mapped.orderBy(*by_net, "sku_id")), "unmapped": collected(part["unmapped"].orderBy(*by_net, "platform_key", "platform_product_code"))},
                "trend": {"dates": [r["stat_date"] for r in trend], "series": {k: [r[k] for r in trend] for k in ("gmv", "net_amount", "refund_rate")}},
                "top": {k: collected(daily.top(mapped, k)) for k in ("by_gmv", "by_growth", "by_decline", "by_refund")},
                "anomalies": collected(anomaly.in_order(anomaly.alerts(context, self.store.table("anomaly_rules")))),
            }
            mapped.unpersist()
            return report
        finally:
            sums.unpersist()
            facts.unpersist()

    def generate_daily(self, date: str, platforms: list[str] | None = None, shops: list[str] | None = None, at: dt.datetime | None = None) -> dict:
        """Report, text and workbook; stored by date unless the report is of some channels or shops only."""
        report = self.daily_report(date, platforms, shops)
        report["summary_text"] = texts.daily_summary(report, self.company, at)
        if not (platforms or shops):
            old = self.store.table("daily_reports")
            row = (date_of(date), json.dumps(report, ensure_ascii=False), report["summary_text"], None, at or dt.datetime.now())
            self._save("daily_reports", old.where(F.col("report_date") != F.lit(date_of(date))).unionByName(self.store.rows("daily_reports", [row])))
        return report

    def history(self, page: int = 1, size: int = 20) -> dict:
        return page_of(self.store.table("daily_reports").select("report_date", "summary", "created_at"), [F.desc("report_date")], page, size)

    def stored_report(self, date: str) -> dict:
        """The stored report of a date, made anew if it went with its data."""
        row = self.store.table("daily_reports").where(F.col("report_date") == F.lit(date_of(date))).first()
        return json.loads(row.metrics_json) if row else self.generate_daily(date)

    def daily_workbook(self, report: dict) -> bytes:
        """Seven sheets: overview, channels, shops, categories, SKUs, alerts, definitions."""
        o, v = report["overview"], report["overview_values"]
        spread = [("GMV", "gmv"), ("实际成交", "net_amount"), ("退款金额", "refund_amount"), ("退款率", "refund_rate"), ("支付件数", "paid_qty"), ("买家数", "buyers"), ("访客数", "visitors"), ("转化率", "conversion_rate"), ("客单价", "avg_order_value"), ("推广费", "ad_cost"), ("推广ROI", "roi"), ("毛利", "gross_profit"), ("毛利率", "gross_margin"), ("经营利润", "operating_profit")]
        ratio = ("refund_rate", "conversion_rate", "gross_margin")
        tail = lambda m, p: o[f"{m}_{p}_pp"] if m in ratio else o[f"{m}_{p}"]
        first = [[f"{self.company} 电商销售日报 {report['report_date']} {report['weekday']}"], [], ["指标", "今日", "昨日", "环比", "上周同日", "周同比"], *[[n, v[m]["today"], v[m]["dod_value"], tail(m, "dod"), v[m]["wow_value"], tail(m, "wow")] for n, m in spread], [], [report["data_completeness"]["warning"] or ""]]
        heads = ["GMV", "实际成交", "占比", "环比", "周同比", "退款率", "支付件数", "买家数", "转化率", "客单价", "件单价", "毛利", "毛利率"]
        fields = ["gmv", "net_amount", "share", "gmv_dod", "gmv_wow", "refund_rate", "paid_qty", "buyers", "conversion_rate", "avg_order_value", "unit_price", "gross_profit", "gross_margin"]
        formats = ["text", "money", "money", "pct", "pct_signed", "pct_signed", "pct", "int", "int", "pct", "money", "money", "money", "pct"]
        dims = lambda rows, name, title: [[title, *heads], *[[r[name], *[r.get(f) for f in fields]] for r in rows]]
        sku = [["类型", "编码", "名称", "类目", "平台", "GMV", "实际成交", "环比", "退款率"], *[["已映射", r["sku_code"], r["name"], r["category"], r["platforms"], r["gmv"], r["net_amount"], r["gmv_dod"], r["refund_rate"]] for r in report["by_sku"]["mapped"]], *[["未映射", r["platform_product_code"], r["product_name"], None, r["platform_key"], r["gmv"], r["net_amount"], r["gmv_dod"], r["refund_rate"]] for r in report["by_sku"]["unmapped"]]]
        alerts = [["级别", "规则", "对象", "指标", "当前值", "阈值", "说明"], *[[a["severity"], a["rule_name"], a["subject"], a["metric"], a["value"], a["threshold"], a["message"]] for a in report["anomalies"]]]
        notes = [["平台", "口径说明"], *[[s.display_name, spec.semantics_note(s)] for s in self.adapters().values()], [], ["数据来源文件", "平台", "导入时间", "总行数", "有效行数"], *[list(u.values()) for u in self.sources(report["report_date"])]]
        return workbook([
            ("日报总览", first, ["text", "money", "money", "pct_signed", "money", "pct_signed"]), ("分平台", dims(report["by_platform"], "platform_name", "平台"), formats), ("分店铺", dims(report["by_shop"], "display", "店铺"), formats),
            ("分类目", dims(report["by_category"], "display", "类目"), formats), ("分SKU", sku, ["text"] * 5 + ["money", "money", "pct_signed", "pct"]), ("异常预警", alerts, ["text"] * 4 + ["money", "money"]), ("口径说明", notes, ["text", "text", "text", "int", "int"]),
        ])

    def weekly_report(self, date: str) -> dict:
        day = date_of(date)
        monday, sunday = weekly.bounds(day)
        facts, channels, skus = self.facts(rounded=False), self.channels(), self.store.table("skus")
        if facts.where(F.col("stat_date").between(F.lit(monday), F.lit(sunday))).isEmpty():
            raise RetailError("NO_DATA_FOR_WEEK", f"no sales from {monday} to {sunday}")
        week = {
            "start_date": str(monday), "end_date": str(sunday), "week_number": monday.isocalendar()[1], "week_range_str": f"{monday} 至 {sunday} (第 {monday.isocalendar()[1]} 周)",
            "totals": collected(weekly.totals(facts, day))[0], "daily": collected(weekly.by_day(facts, day).orderBy("stat_date")),
            "platforms": collected(weekly.by_platform(facts, channels, day).orderBy(F.desc("gmv"), "platform_key")), "top_skus": collected(weekly.hot_list(facts, skus, channels, day).orderBy(F.desc("gmv"), "key")),
        }
        return week | {"summary_text": texts.weekly_summary(week, self.company)}

    def weekly_workbook(self, week: dict) -> bytes:
        """Four sheets: totals, days, channels, products."""
        listed = lambda rows: [list(rows[0]), *[list(r.values()) for r in rows]] if rows else [[]]
        return workbook([("周度总览", [["指标", "值"], ["周期", week["week_range_str"]], *[[k, v] for k, v in week["totals"].items()]], ["text", "money"]), ("每日趋势", listed(week["daily"]), ["text", "text"] + ["money"] * 8), ("分平台", listed(week["platforms"]), ["text", "text"] + ["money"] * 6), ("爆款榜", listed(week["top_skus"]), ["text"] * 3 + ["money"] * 5)])

    def export_detail(self, date: str) -> list[dict]:
        """A file that can be read in again for each built-in channel with sales of the day."""
        day, out = date_of(date), []
        facts = self.store.facts_between(day, day)
        if facts.isEmpty():
            raise RetailError("NO_DATA_FOR_DATE", f"no sales on {day}")
        adapters = self.adapters()
        for key in spec.builtin_keys():
            body, n = detail.content(facts, adapters[key], day)
            if n:
                out.append({"platform_key": key, "filename": detail.filename(adapters[key], day), "content": body, "row_count": n, "footer_rows": adapters[key].file_matching.skip_footer})
        if not out:
            raise RetailError("NO_DATA_FOR_DATE", f"no built-in channel has sales on {day}")
        return out

    def export_files(self, first: str, last: str, folder: str, rows_per_file: int = detail.ROWS_PER_FILE) -> list[dict]:
        """Detail files of all days from first to last, for each built-in channel, written into a folder that all executors reach.

        Channels and days share one plan; files are cut by rows and each is written whole by the task that makes it. What the folder
        holds is listed in the order of channels, days and parts. Parts that an earlier, larger export of the same days left are removed.
        """
        days = date_of(first), date_of(last)
        place = f"staging/detail-{uuid.uuid4().hex}"
        specs = {k: s for k, s in self.adapters().items() if k in spec.builtin_keys()}
        try:
            made = detail.parts(self.store.facts_between(*days), specs, lambda df: self.store.staged(place, df), rows_per_file)
            done = collected(generator.write(made, folder))
        finally:
            self.store.remove(place)
        if not done:
            raise RetailError("NO_DATA_FOR_DATE", f"no built-in channel has sales from {first} to {last}")
        self._remove_parts(folder, specs, days, {r["path"] for r in done})
        rank = {k: i for i, k in enumerate(spec.builtin_keys())}
        return sorted(done, key=lambda r: (rank[r["platform_key"]], r["stat_date"], r["path"].removesuffix(".csv")))

    def _remove_parts(self, folder: str, specs: dict[str, spec.Spec], days: tuple[dt.date, dt.date], kept: set[str]) -> None:
        """Remove this folder's detail files of these channels and days other than the kept ones."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        stems = {detail.filename(s, days[0] + dt.timedelta(days=i)).removesuffix(".csv") for s in specs.values() for i in range((days[1] - days[0]).days + 1)}
        for found in fs.listStatus(path):
            name = found.getPath().getName()
            if name not in kept and re.sub(r"(_\d{5})?\.csv$", "", name) in stems:
                fs.delete(found.getPath(), False)


def page_of(df: DataFrame, order: list, page: int, size: int) -> dict:
    return {"total": df.count(), "page": page, "page_size": size, "items": collected(listing.page(df, order, page, size))}
