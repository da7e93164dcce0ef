"""The extraction task's fields, record schemas and named constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The fields in schema order as (name, kind, section, optional, concepts in order of preference).
FIELDS: list[tuple[str, str, str, bool, list[str]]] = [
    ("period_end", "date", "cover", False, ["dei:DocumentPeriodEndDate"]),
    ("fiscal_period", "categorical", "cover", False, ["dei:DocumentFiscalPeriodFocus"]),
    ("revenue", "monetary", "income", False, ["us-gaap:Revenues", "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax", "us-gaap:SalesRevenueNet", "us-gaap:RevenueFromContractWithCustomerIncludingAssessedTax"]),
    ("cost_of_revenue", "monetary", "income", True, ["us-gaap:CostOfRevenue", "us-gaap:CostOfGoodsAndServicesSold", "us-gaap:CostOfGoodsSold"]),
    ("operating_income", "monetary", "income", True, ["us-gaap:OperatingIncomeLoss"]),
    ("net_income", "monetary", "income", False, ["us-gaap:NetIncomeLoss", "us-gaap:ProfitLoss"]),
    ("eps_basic", "per_share", "income", True, ["us-gaap:EarningsPerShareBasic"]),
    ("eps_diluted", "per_share", "income", True, ["us-gaap:EarningsPerShareDiluted"]),
    ("shares_diluted", "share_count", "income", True, ["us-gaap:WeightedAverageNumberOfDilutedSharesOutstanding", "us-gaap:WeightedAverageNumberOfDilutedSharesOutstandingAdjusted"]),
    ("total_assets", "monetary", "balance", False, ["us-gaap:Assets"]),
    ("total_liabilities", "monetary", "balance", True, ["us-gaap:Liabilities"]),
    ("cash_and_equivalents", "monetary", "balance", False, ["us-gaap:CashAndCashEquivalentsAtCarryingValue", "us-gaap:CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "us-gaap:Cash"]),
    ("stockholders_equity", "monetary", "balance", False, ["us-gaap:StockholdersEquity", "us-gaap:StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"]),
    ("auditor_name", "categorical", "auditor", True, ["dei:AuditorName"]),
    ("state_of_incorporation", "categorical", "cover", True, ["dei:EntityIncorporationStateCountryCode"]),
]
NEIGHBOURS = {"shares_diluted": "us-gaap:WeightedAverageNumberOfSharesOutstandingBasic"}
FISCAL_PERIODS = ["FY", "Q1", "Q2", "Q3", "Q4"]
#: (target days, least, most) of a duration by fiscal period.
BANDS = {p: (365, 300, 400) if p == "FY" else (91, 60, 120) for p in FISCAL_PERIODS}
SLACK_DAYS, MAX_DISTRACTORS = 7, 4
RELATIVE_TOLERANCE, PER_SHARE_TOLERANCE = 0.005, 0.005
SCALE_RATIOS, RATIO_TOLERANCE = [1e-9, 1e-6, 1e-3, 1e-2, 1e-1, 1e1, 1e2, 1e3, 1e6, 1e9], 0.01
MISS_REASONS = ["missing", "hallucinated", "wrong_period", "sign", "scale", "malformed", "wrong_value"]
DROP_REASONS = ["not_fetched", "bank", "no_primary_document", "unreadable", "no_income_statement", "no_balance_sheet", "mixed_scale", "no_period", "truth_missing", "truth_invalid", "pairing_error", "unlocatable"]
SPLITS = ["train", "validation", "test_pre_cutoff", "test_post_cutoff"]
FORMS = ["10-K", "10-Q"]

NUMERIC_KINDS = ["monetary", "per_share", "share_count"]
REQUIRED = [name for name, _, _, optional, _ in FIELDS if not optional]

_SPARK_KIND = {"date": T.DateType(), "categorical": T.StringType()}
EXTRACTION = T.StructType([T.StructField(n, _SPARK_KIND.get(k, T.DoubleType())) for n, k, *_ in FIELDS])
FACT = "ordinal int, concept string, unit string, num_value double, str_value string, start date, end date, accession string, form string, filed date"
CONTEXT = "struct<scale:double,share_scale:double,distractors:map<string,array<struct<num:double,str:string>>>>"
PREDICTION = "line_no bigint, item_id string, text string, finish_reason string, status string, ok boolean, ledger_id bigint, cost_usd double, costed boolean, price_list string, price_sha256 string, latency_ms double, ttft_ms double, input_tokens bigint, output_tokens bigint, cached boolean, retries int, model_returned string"
TIMING = "concurrency int, sent_at double, first_token_at double, done_at double, output_tokens bigint, ok boolean, input_tokens bigint"


def field_dim(spark: SparkSession) -> DataFrame:
    """One row per field: field_ord, field, kind, section, optional, concepts."""
    return spark.createDataFrame([(i, *f) for i, f in enumerate(FIELDS)], "field_ord int, field string, kind string, section string, optional boolean, concepts array<string>")
