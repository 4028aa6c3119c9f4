"""Schemas and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

MEASURES = ["spend", "clicks", "impressions", "conversions", "revenue"]
TEXT_DIMS = ["channel", "campaign_type", "campaign_name"]
CANONICAL_COLUMNS = ["date", *TEXT_DIMS, *MEASURES, "roas"]
LEVEL_COLUMNS = {"channel": "channel", "campaign_type": "campaign_type", "campaign": "campaign_name"}

CAMPAIGN_FACT = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in TEXT_DIMS]
    + [T.StructField(c, T.DoubleType()) for c in [*MEASURES, "roas"]]
    + [T.StructField(c, T.StringType()) for c in ["source_schema", "source_file"]]
)

FORECAST = T.StructType(
    [
        T.StructField("level", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("horizon_days", T.IntegerType()),
        T.StructField("expected_revenue", T.DoubleType()),
        T.StructField("lower_revenue", T.DoubleType()),
        T.StructField("upper_revenue", T.DoubleType()),
        T.StructField("expected_roas", T.DoubleType()),
        T.StructField("lower_roas", T.DoubleType()),
        T.StructField("upper_roas", T.DoubleType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("interval_width_pct", T.DoubleType()),
        T.StructField("forecast_confidence", T.StringType()),
    ]
)
OUTPUT_COLUMNS = FORECAST.fieldNames()

# --- fixed values: must equal the published planning rules ---------------------------------------
HORIZONS = (30, 60, 90)
HORIZON_Z = {30: 0.95, 60: 1.00, 90: 1.10}
Z_CLAMP = (0.75, 1.65)
INTERVAL_MULTIPLIER = {30: 1.6, 60: 1.6, 90: 2.5}
INTERVAL_MULTIPLIER_LOW_SAMPLE = {30: 2.0, 60: 2.0, 90: 3.125}
INTERVAL_FLOOR_PCT = {30: 0.056, 60: 0.168, 90: 0.20}
ALT_INTERVAL_MULTIPLIER = {30: 1.0, 60: 2.35, 90: 2.55}
ALT_INTERVAL_FLOOR_PCT = {30: 0.056, 60: 0.1979, 90: 0.2029}
BASELINE_ANCHORED_SCALE = {30: 1.0, 60: 0.90, 90: 0.52}
LONG_HORIZON_SCALE = {30: 1.0, 60: 0.92, 90: 1.0}
LEVEL_INTERVAL_FACTOR = {"overall": 1.00, "channel": 1.05, "campaign_type": 1.10, "campaign": 1.15}
TREND_WEIGHT = 0.35
MIN_TRAINED_ROWS = 6
MIN_TRAINING_SAMPLES = 12
LOW_SAMPLE_ROWS = 30
STRICT_GAP_PP = 2.0
DEFAULT_SELECTED_WEIGHT = {30: 0.60, 60: 0.0, 90: 0.0}
BLEND_CANDIDATES = (0.0, 0.10, 0.25, 0.40, 0.50, 0.60)
CONFORMAL_TARGET = 0.90
SAFE_BASELINE = "safe_baseline_fallback"
TRAINED = "trained_model"
TRAINED_ANCHORED = "trained_model_baseline_anchored"
TRAINED_ESTIMATED_SPEND = "trained_model_estimated_spend"
NOT_COMPUTABLE = "not_computable"

ANOMALY_Z = 2.5
ANOMALY_CRITICAL_Z = 3.5
ROAS_FALL = -0.20
ROAS_FALL_CRITICAL = -0.35
CUSUM_SLACK_SD = 0.5
CUSUM_THRESHOLD_SD = 5.0
CUSUM_MIN_ROWS = 21
EVENT_WINDOW_DAYS = 14
PARALLEL_GAP_PCT = 8.0
POWER_MIN_DAYS = 10
POWER_MAX_P = 0.15
BOOTSTRAP_EFFECT_DRAWS = 500
BOOTSTRAP_PAIRED_DRAWS = 2000

SPEND_MULTIPLIERS = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0)
ZONE_MIN_WINDOWS = 3
ZONE_SEVERITY = {"SUPPORTED": 0, "CAUTION": 1, "HIGH_EXTRAPOLATION": 2, "UNSUPPORTED": 3}

READINESS_WEIGHTS = {
    "schema_required": 20,
    "completeness_validity": 20,
    "historical_coverage": 20,
    "freshness": 10,
    "channel_campaign_coverage": 10,
    "spend_revenue_consistency": 10,
    "outliers_duplicates": 10,
}
SCHEMA_CONFIDENCE = {
    "canonical": 100.0,
    "ads": 100.0,
    "ga4": 95.0,
    "shopify": 95.0,
    "generic_marketing": 80.0,
    "mixed": 75.0,
    "empty": 0.0,
}
PLACEHOLDER_TEXT = ["", "nan", "none", "null", "unknown channel", "unknown campaign", "unclassified"]
BLANK_TEXT = ["", "nan", "none", "null"]
TEXT_DEFAULTS = {
    "channel": "Unknown Channel",
    "campaign_type": "Unclassified",
    "campaign_name": "Unknown Campaign",
}

# Monday of each retail holiday week, and the Black Fridays.
HOLIDAY_WEEKS = [
    "2024-02-12", "2024-05-27", "2024-07-01", "2024-09-02", "2024-11-25", "2024-12-23",
    "2025-02-10", "2025-05-26", "2025-06-30", "2025-09-01", "2025-11-24", "2025-12-22",
    "2026-02-09", "2026-05-25", "2026-06-29", "2026-09-07", "2026-11-23", "2026-12-21",
]
BLACK_FRIDAYS = ["2024-11-29", "2025-11-28", "2026-11-27"]

# Accepted header names per canonical field, after header normalisation.
FIELD_ALIASES = {
    "date": [
        "date", "day", "dt", "ds", "report_date", "reporting_date", "order_date", "orderdate",
        "transaction_date", "transactiondate", "created_at", "createdat", "event_date", "eventdate",
        "date_start", "datestart", "reportdate", "segments_date", "timeperiod", "time_period",
    ],
    "channel": [
        "channel", "platform", "platform_label", "platformlabel", "source", "traffic_source",
        "marketing_channel", "media_channel", "ad_channel", "network", "publisher", "sessionsource",
        "session_source", "source_medium",
    ],
    "campaign_type": [
        "campaign_type", "campaign_category", "type", "objective", "campaign_objective", "funnel_stage",
        "advertising_channel_type", "campaign_advertising_channel_type", "ad_type", "product_type",
        "campaigntype", "sessionmedium", "session_medium",
    ],
    "campaign_name": [
        "campaign", "campaign_name", "campaignname", "campaign_id", "ad_campaign", "sessioncampaignname",
        "session_campaign_name", "product_title", "product_name", "product_type",
    ],
    "spend": [
        "spend", "cost", "amount_spent", "amountspent", "ad_spend", "adspend", "ad_cost", "adcost",
        "advertiser_ad_cost", "advertiseradcost", "media_spend", "mediaspend", "investment",
        "metrics_cost_micros", "cost_micros",
    ],
    "clicks": ["clicks", "click", "link_clicks", "ad_clicks", "sessions", "metrics_clicks"],
    "impressions": ["impressions", "impression", "impr", "views", "ad_impressions"],
    "conversions": [
        "conversions", "conversion", "metrics_conversions", "purchases", "orders", "transactions", "leads",
    ],
    "revenue": [
        "revenue", "sales", "conversion", "conversion_value", "conversions_value",
        "metrics_conversions_value", "purchaserevenue", "purchase_revenue", "eventvalue", "event_value",
        "purchase_value", "total_price", "total_revenue", "gross_revenue", "value",
    ],
    "roas": ["roas", "return_on_ad_spend"],
}
# Headers that identify a source system; two matches are enough.
SOURCE_SIGNATURES = {
    "ga4": [
        "sessions", "conversions", "sessionsource", "session_source", "sessionmedium", "session_medium",
        "purchaserevenue", "purchase_revenue", "eventvalue", "event_value",
    ],
    "shopify": ["created_at", "total_price", "sales", "orders", "product_type"],
    "ads": [
        "spend", "cost", "metrics_cost_micros", "clicks", "metrics_clicks", "impressions",
        "metrics_impressions", "conversions", "metrics_conversions", "conversion", "conversion_value",
        "metrics_conversions_value", "revenue",
    ],
}
CHANNEL_TOKENS = {
    "Google Ads": ["google"],
    "Meta Ads": ["facebook", "instagram", "meta"],
    "Microsoft Ads": ["bing", "microsoft"],
    "Shopify": ["shopify"],
}
# The feature contract, in its order; horizon stands for the horizon in days.
FEATURES = [
    "horizon", "history_days", "recent_spend_7", "recent_spend_28", "recent_spend_56", "projected_spend_horizon",
    "planned_spend_delta_7_28", "planned_spend_delta_28_horizon", "recent_revenue_7", "recent_revenue_14",
    "recent_revenue_28", "recent_revenue_56", "recent_roas_7", "recent_roas_14", "recent_roas_28", "recent_roas_56",
    "rps_7", "rps_14", "rps_28", "rps_trend_7_28", "baseline_revenue_forecast", "baseline_roas_forecast", "recent_clicks_28",
    "recent_impressions_28", "recent_conversions_28", "ctr_28", "conversion_rate_28", "cpc_28",
    "revenue_per_conversion_28", "spend_trend_28", "revenue_trend_28", "roas_trend_28", "spend_trend_56",
    "revenue_trend_56", "roas_trend_56", "revenue_momentum_14_56", "revenue_momentum_28_56", "roas_momentum_14_56",
    "roas_momentum_28_56", "conversion_rate_14", "conversion_rate_56", "conversion_rate_stability_14_56",
    "ctr_stability_14_56", "dow_end", "month_end", "sin_7", "cos_7", "sin_30", "cos_30", "sin_365", "cos_365",
    "sin_year_end", "cos_year_end", "quarter_end", "dow_channel_interaction", "dow_campaign_type_interaction", "month_channel_interaction",
    "month_campaign_type_interaction", "sin_year_x_channel_code", "rev_std_14", "rev_std_28", "rev_std_56", "roas_std_56",
    "spend_share_28", "spend_share_drift_28_56", "channel_roas_56", "campaign_type_roas_56",
    "segment_vs_channel_roas_56", "segment_vs_campaign_type_roas_56", "campaign_spend_share_of_channel_28",
    "spend_x_sin7", "level_code", "channel_code", "campaign_type_code", "unique_campaigns",
]
# --- end of fixed values ---------------------------------------------------------------------------
