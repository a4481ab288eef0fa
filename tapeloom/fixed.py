"""Names, texts and thresholds that results must agree on."""

from __future__ import annotations

# Columns of a normalized bar file and the vendor column names.
BAR_COLUMNS = ["date", "open", "high", "low", "close", "volume"]
VENDOR_COLUMNS = {
    "akshare": {"日期": "date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume"},
    "tushare": {"trade_date": "date", "vol": "volume"},
    "yfinance": {"Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"},
}

# Issue texts of the layer checks.
BAD_PRICE_ORDER = "价格关系异常"
BAD_VOLUME = "成交量异常"
BAD_TURNOVER = "成交额异常"
BAD_VWAP = "VWAP异常"
BAD_QFQ = "前复权因子异常"
BAD_HFQ = "后复权因子异常"
NEGATIVE_REVENUE = "营收为负数"
ZERO_PROFIT = "营收为正但净利润为0"
BAD_ASSETS = "总资产无效"
NEGATIVE_PE = "市盈率为负数"
NEGATIVE_PB = "市净率为负数"
BAD_CAP = "市值无效"
FLOAT_OVER_CAP = "流通市值大于总市值"

# Advice texts.
ADVICE_CRITICAL = "发现严重数据质量问题，建议立即修复"
ADVICE_POOR = "发现数据质量问题，建议尽快处理"
ADVICE_COMPLETENESS = "建议检查数据源，确保数据完整性"
ADVICE_ACCURACY = "建议验证数据准确性，检查价格关系"
ADVICE_WIDE_IMPACT = "该数据集影响范围较大，修改前请谨慎评估"
ADVICE_MANY_DEPENDENCIES = "该数据集依赖较多，建议检查上游数据质量"
ADVICE_UNUSED = "该数据集未被其他组件使用，可以考虑归档"
ADVICE_PROVIDER_WIDE = "该数据提供者影响范围很大，建议建立备用方案"
ADVICE_PROVIDER_UNUSED = "该数据提供者未被使用，可以考虑移除"

# Trend and correlation words.
TREND_UP, TREND_DOWN, TREND_FLAT = "上升", "下降", "平稳"
CORR_POSITIVE, CORR_NEGATIVE = "强正相关", "强负相关"

# Retention days per policy (None = kept for ever).
RETENTION_DAYS = {
    "permanent": None,
    "years_7": 2555,
    "years_3": 1095,
    "years_1": 365,
    "months_6": 180,
    "months_3": 90,
    "days_30": 30,
}

# Alert rules (rule, metric, threshold, comparison, level, message).
ALERT_RULES = [
    ("data_quality_low", "data_quality_score", 0.8, "<", "warning", "数据质量分数过低"),
    ("data_freshness_old", "data_age_hours", 24.0, ">", "error", "数据更新延迟"),
    ("storage_space_low", "storage_usage_percent", 90.0, ">", "critical", "存储空间不足"),
    ("api_error_rate_high", "api_error_rate", 0.1, ">", "error", "API错误率过高"),
]

# Health checks (component, metric, healthy bound, degraded bound, comparison).
HEALTH_CHECKS = [
    ("data_service", "data_quality_score", 0.9, 0.7, ">="),
    ("storage_service", "storage_usage_percent", 80.0, 90.0, "<"),
    ("provider_service", "api_error_rate", 0.05, 0.1, "<"),
]

# Macro type to series code where the code is not just the upper-case type.
MACRO_CODES = {"gdp": "GDP", "cpi": "CPI", "ppi": "PPI", "money_supply": "M2", "interest_rate": "RATE"}

# Factor weights of the weighted composite score and the model stamp.
FACTOR_WEIGHTS = {"momentum_120": 0.4, "volatility_20": -0.3, "pe_ttm": -0.3}
MODEL_NAME, MODEL_VERSION = "rank_topn_neutral", "v1.0"

# Metric families of the daily fundamentals table.
VALUATION_COLUMNS = ["pe_ratio", "pe_ttm", "pb_ratio", "ps_ratio", "pcf_ratio"]
PROFITABILITY_COLUMNS = ["roe", "roa", "roic", "gross_margin", "net_margin", "operating_margin"]
GROWTH_COLUMNS = ["revenue_growth", "revenue_growth_qoq", "profit_growth", "profit_growth_qoq"]
