"""The unified sales fact, its closed list of fields, and the error codes."""

from __future__ import annotations

from pyspark.sql import types as T

#: The fields of a fact, those that a file's column may map to, and the numeric ones.
UNIFIED_FIELDS = ["stat_date", "platform_key", "shop_code", "shop_name", "platform_product_code", "product_name", "category", "sku_id", "order_qty", "paid_qty", "gmv", "refund_amount", "net_amount", "visitors", "buyers", "ad_cost", "raw_row_json"]
MAPPABLE_FIELDS = [f for f in UNIFIED_FIELDS if f not in ("platform_key", "sku_id", "raw_row_json")]
NUMERIC_FIELDS = ["order_qty", "paid_qty", "gmv", "refund_amount", "net_amount", "visitors", "buyers", "ad_cost"]
MONEY_FIELDS = ["gmv", "refund_amount", "net_amount", "ad_cost"]
COUNT_FIELDS = ["order_qty", "paid_qty", "visitors", "buyers"]

MONEY = T.DecimalType(14, 2)

FACTS = T.StructType([
    T.StructField("upload_id", T.LongType()), T.StructField("row_no", T.LongType()), T.StructField("stat_date", T.DateType()),
    T.StructField("platform_key", T.StringType()), T.StructField("shop_code", T.StringType()), T.StructField("shop_name", T.StringType()),
    T.StructField("platform_product_code", T.StringType()), T.StructField("product_name", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("sku_id", T.LongType()), T.StructField("order_qty", T.LongType()), T.StructField("paid_qty", T.LongType()),
    T.StructField("gmv", MONEY), T.StructField("refund_amount", MONEY), T.StructField("net_amount", MONEY),
    T.StructField("visitors", T.LongType()), T.StructField("buyers", T.LongType()), T.StructField("ad_cost", MONEY), T.StructField("raw_row_json", T.StringType()),
])
ERRORS = "upload_id long, row_number long, error_type string, error_message string, raw_content string"
SKUS = "id long, sku_code string, name string, category string, brand string, cost_price decimal(14,2), status string"
MAPPINGS = "id long, platform_key string, platform_product_code string, platform_product_name string, sku_id long, match_type string, confidence decimal(5,4)"
RULES = "id long, name string, metric string, scope string, operator string, threshold decimal(14,4), min_base decimal(14,2), enabled boolean"
UPLOADS = "id long, filename string, sha256 string, platform_key string, adapter_version int, status string, row_count_total long, row_count_valid long, row_count_error long, error_message string, version long, created_at timestamp"
CHANNELS = "platform_key string, display_name string, platform_fee_rate decimal(10,6), fulfillment_cost_per_unit decimal(14,4), gmv_includes_shipping boolean"

#: The rules that a new store starts with.
DEFAULT_RULES = [
    ("GMV 环比大幅波动", "gmv_dod", "platform", "abs_gt", "0.30", "1000"),
    ("SKU GMV 环比骤降", "gmv_dod", "sku", "lt", "-0.40", "500"),
    ("退款率超限", "refund_rate", "sku", "gt", "0.15", "500"),
    ("整体退款率超限", "refund_rate", "overall", "gt", "0.20", "0"),
    ("转化率异常下滑", "conversion_rate_dod_pp", "platform", "lt", "-2.0", "1000"),
    ("推广 ROI 过低", "roi", "platform", "lt", "1.0", "500"),
]
WEEKDAYS = ["周一", "周二", "周三", "周四", "周五", "周六", "周日"]


class RetailError(Exception):
    """An operation's failure with the code that callers test for."""

    def __init__(self, code: str, message: str, detail: dict | None = None) -> None:
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.detail = code, message, detail or {}
