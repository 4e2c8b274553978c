"""Fixed values the engine must share with the ad-report analyzer it re-implements.

Everything in the FIXED VALUES block below has to stay exactly as written for
results (labels, thresholds, column aliases) to match; it is data, not logic.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the analyzer's published behaviour)
# ---------------------------------------------------------------------------

# Canonical fact columns, in order.
CANONICAL_COLUMNS = [
    "date",
    "platform",
    "account_name",
    "campaign_name",
    "ad_group_name",
    "keyword",
    "product_name",
    "impressions",
    "clicks",
    "cost",
    "conversions",
    "revenue",
    "orders",
]
DIMENSIONS = ["platform", "account_name", "campaign_name", "ad_group_name", "keyword", "product_name"]
MEASURES = ["impressions", "clicks", "cost", "conversions", "revenue", "orders"]
RATES = ["ctr", "cpc", "cvr", "cpa", "roas"]
CORE_ACTIVITY = ["impressions", "clicks", "cost", "conversions", "revenue"]
LOWER_IS_BETTER = ["cost", "cpc", "cpa"]

# Label used for a missing / blank dimension value ("unclassified").
UNCLASSIFIED = "미분류"

# Segment tables: grain name -> dimension column; top-N cut per table.
SEGMENT_DIMENSIONS = {
    "platform": "platform",
    "campaign": "campaign_name",
    "ad_group": "ad_group_name",
    "keyword": "keyword",
    "product": "product_name",
}
SEGMENT_LIMIT = 20

# Row label precedence for an anomaly target.
LABEL_PRECEDENCE = ["campaign_name", "ad_group_name", "keyword", "product_name", "platform"]

# Calendar label words: year, month, day, ISO week, quarter, halves, seasons.
YEAR_WORD = "년"
MONTH_WORD = "월"
DAY_WORD = "일"
WEEK_WORD = "주차"
QUARTER_WORD = "분기"
FIRST_HALF = "상반기"
SECOND_HALF = "하반기"
SPRING, SUMMER, AUTUMN, WINTER = "봄", "여름", "가을", "겨울"
PERIOD_GRAINS = ["daily", "weekly", "monthly", "quarterly", "half_year", "yearly", "seasonal"]

# Anomaly thresholds.
NO_CONVERSION_COST_QUANTILE = 0.25
NO_CONVERSION_SPEND_SHARE = 0.05
HIGH_IMPRESSION_QUANTILE = 0.75
LOW_CTR_QUANTILE = 0.25
LOW_CTR_FLOOR = 0.001
SCALE_ROAS = 4.0

# Action issues.
MIN_ROWS_FOR_JUDGMENT = 3
SAVING_FACTOR = 0.15
SEVERITY_BASE_SCORE = {"high": 100, "medium": 70, "opportunity": 60, "low": 20}
OTHER_SEVERITY_SCORE = 40
COST_PER_SCORE_POINT = 100_000
COST_SCORE_CAP = 30
HIGH_ZERO_ROAS_PENALTY = 20
NO_ANOMALY_SCORE = 10
REPORT_SHARE_SCORE = 5
BENCHMARK_CHECK_SCORE = 4
INSUFFICIENT_DATA_SCORE = 1
MAX_ISSUES_WITH_SUPPORT = 3
REPORT_SEVERITIES = ["high", "medium", "opportunity"]
# Platform names containing this word get the search-ads wording for "no data".
SEARCH_ADS_MEDIA_WORD = "네이버"

# Health score and industry tier.
HEALTH_BASE = 58
HEALTH_ROAS_WEIGHT, HEALTH_ROAS_CAP = 7, 30
HEALTH_CTR_WEIGHT, HEALTH_CTR_CAP = 500, 8
HEALTH_OPPORTUNITY_WEIGHT, HEALTH_OPPORTUNITY_CAP = 2, 8
HEALTH_HIGH_PENALTY, HEALTH_MEDIUM_PENALTY = 10, 4
HEALTH_GOOD, HEALTH_FAIR = 80, 60
INDUSTRY_ROAS = 4.10
INDUSTRY_CPC = 980.0
INDUSTRY_TOP_FACTOR = 1.2

# Channel benchmark ROAS by channel group; default for unknown groups; LTV factor.
CHANNEL_GROUP_TARGET_ROAS = {"광고매체": 4.2, "오픈마켓": 3.6, "커머스 플랫폼": 3.9, "글로벌 채널": 2.8}
DEFAULT_TARGET_ROAS = 3.5
LTV_FACTOR = 2.6

# Freshness windows.
FRESH_HOURS, WARN_HOURS = 24, 72
FRESH_LAG_DAYS, WARN_LAG_DAYS = 1, 7
SUCCESS_WINDOW_DAYS = 30

# Retention limits (days) by storage target, and the file patterns each target keeps.
RETENTION_DAYS = {"raw": 90, "processed": 365, "reports": 365, "logs": 180, "screenshots": 30}
RETENTION_SUFFIXES = {
    "raw": [".csv", ".xlsx", ".xls", ".json"],
    "processed": [".csv", ".xlsx", ".parquet", ".duckdb"],
    "reports": [".md", ".txt", ".xlsx", ".pdf"],
    "logs": [".log", ".txt", ".json"],
    "screenshots": [".png", ".jpg", ".jpeg", ".webp"],
}
# Download detection: partial-download suffixes and accepted report suffixes.
PARTIAL_DOWNLOAD_SUFFIXES = [".crdownload", ".tmp", ".part"]
REPORT_DOWNLOAD_SUFFIXES = [".xlsx", ".xls", ".csv"]

# Header similarity cut-off for fuzzy column matching.
MIN_HEADER_SIMILARITY = 0.88

# Default null tokens of a CSV reader (pandas defaults), compared before trimming.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Column aliases per canonical column (normalised at lookup time; later entries win).
COLUMN_ALIASES = {
    "date": ["date", "day", "일자", "날짜", "기간", "보고일", "집행일", "집계일", "기준일", "광고일자", "보고기간", "월", "년월"],
    "platform": ["platform", "media", "channel", "publisher", "매체", "플랫폼", "채널", "광고매체", "매체명", "사이트",
                 "사이트명", "마켓", "마켓명", "판매채널", "광고채널"],
    "account_name": ["account", "account name", "advertiser", "client", "계정", "계정명", "광고주", "광고주명", "회원사",
                     "광고계정", "광고계정명", "판매자", "판매자명", "셀러", "셀러명", "상점명", "브랜드명"],
    "campaign_name": ["campaign", "campaign name", "캠페인", "캠페인명", "광고명", "광고캠페인", "광고 캠페인", "광고캠페인명"],
    "ad_group_name": ["ad group", "adgroup", "ad group name", "ad_group", "광고그룹", "광고그룹명", "그룹", "그룹명",
                      "광고 그룹", "광고 그룹명"],
    "keyword": ["keyword", "query", "search term", "키워드", "검색어", "검색 키워드", "키워드명", "입찰키워드", "입찰 키워드",
                "구매키워드", "구매 키워드"],
    "product_name": ["product", "product name", "item", "sku", "상품", "상품명", "소재", "광고소재", "광고상품", "광고상품명",
                     "광고 상품명", "노출상품명", "노출 상품명"],
    "impressions": ["impressions", "impr", "views", "노출", "노출수", "조회", "광고노출수", "광고 노출수", "노출 횟수", "노출수(회)"],
    "clicks": ["clicks", "click", "클릭", "클릭수", "광고클릭수", "광고 클릭수", "클릭 횟수", "클릭수(회)"],
    "cost": ["cost", "spend", "amount spent", "ad cost", "광고비", "비용", "소진금액", "집행금액", "사용금액", "광고 비용",
             "광고비(원)", "총광고비", "총 광고비", "소진 광고비", "과금액", "과금금액"],
    "conversions": ["conversions", "conversion", "purchase", "전환", "전환수", "구매", "구매수", "전환건수", "전환 건수",
                    "구매건수", "구매 건수", "전환주문수", "전환 주문수"],
    "revenue": ["revenue", "sales", "conversion value", "purchase value", "매출", "매출액", "전환매출", "구매금액", "광고매출",
                "광고 매출", "광고매출액", "총매출", "총 매출", "주문금액", "결제금액", "전환매출액", "매출액(원)"],
    "orders": ["orders", "order", "주문", "주문수", "결제수", "주문건수", "주문 건수", "결제건수", "결제 건수"],
}

# Collection-log statuses and channel data statuses.
STATUS_FRESH, STATUS_WARN, STATUS_STALE, STATUS_DISCONNECTED = "최신", "주의", "오래됨", "연결 안됨"

# Search-ads stats payloads: media name, id keys, row-marker keys, container list keys,
# date keys and the keys tried (in order) for each metric.
SEARCH_ADS_MEDIA_NAME = "네이버 검색광고"
STAT_ID_KEYS = ["id", "nccCampaignId", "nccAdgroupId", "nccKeywordId"]
STAT_ROW_MARKERS = ["id", "nccCampaignId", "nccAdgroupId", "nccKeywordId", "impCnt", "clkCnt", "salesAmt"]
STAT_LIST_KEYS = ["data", "rows", "items", "result", "results"]
STAT_DATE_KEYS = ["date", "statDate", "statDt", "period", "baseDate"]
STAT_METRIC_KEYS = {
    "impressions": ["impCnt", "impressions"],
    "clicks": ["clkCnt", "clicks"],
    "cost": ["salesAmt", "cost"],
    "conversions": ["ccnt", "convCnt", "conversionCnt", "conversions"],
    "revenue": ["convAmt", "revenue", "sales"],
    "roas": ["ror", "roas"],
    "cpc": ["cpc"],
    "ctr": ["ctr"],
}

# File audit: optional cart-count header aliases; media inferred from file-name words
# (rules tried in order); alias-candidate substring rules for unmapped headers (in order).
CART_COUNT_ALIASES = ["장바구니", "장바구니수", "장바구니 수", "cart", "cart count", "add to cart"]
MEDIA_NAVER, MEDIA_GMARKET, MEDIA_AUCTION, MEDIA_GMARKET_AUCTION, MEDIA_11ST = "네이버", "G마켓", "옥션", "G마켓/옥션", "11번가"
MEDIA_UNCLASSIFIED = "매체 미분류"
NAVER_WORDS = ["naver", "네이버"]
GMARKET_WORDS = ["gmarket", "g 마켓", "지마켓"]
AUCTION_WORDS = ["auction", "옥션"]
ELEVENST_WORDS = ["11", "11번가"]
MARKETPLACE_MEDIA = [MEDIA_GMARKET, MEDIA_AUCTION, MEDIA_GMARKET_AUCTION]
ALIAS_CANDIDATE_RULES = [
    (["장바구니", "cart"], "cart_count"),
    (["노출", "impression", "impr"], "impressions"),
    (["클릭수", "click"], "clicks"),
    (["광고비", "소진", "비용", "과금", "spend", "cost"], "cost"),
    (["전환수", "구매수", "전환건수", "conversion"], "conversions"),
    (["매출", "주문금액", "결제금액", "revenue", "sales"], "revenue"),
    (["주문수", "주문건수", "결제수", "order"], "orders"),
    (["상품명", "상품", "소재", "product", "item"], "product_name"),
    (["키워드", "검색어", "keyword", "query"], "keyword"),
    (["캠페인", "campaign"], "campaign_name"),
    (["그룹", "adgroup"], "ad_group_name"),
    (["roas", "수익률", "광고수익률"], "roas"),
    (["cpc", "클릭당"], "cpc"),
    (["ctr", "클릭률"], "ctr"),
    (["cvr", "전환율"], "cvr"),
]
# Marketplace metadata headers held back from alias suggestions.
MARKETPLACE_METADATA_HEADERS = ["광고ID", "상품번호", "광고수익률", "클릭당비용", "클릭률", "전환율", "전환당비용", "source_sheet"]
# File-name words marking a marketplace legacy report.
LEGACY_REPORT_WORDS = ["gmarket auction", "gmarket", "auction", "지마켓", "옥션"]

# Preset names accepted by the date-range presets (anything else = last 7 days).
PRESETS = ["last_7_days", "yesterday", "last_week", "last_15_days", "this_month", "last_month",
           "last_quarter", "last_half", "last_season"]

# ---------------------------------------------------------------------------
# Our own codes and wording (not shared with the analyzer).
# ---------------------------------------------------------------------------

RULE_NO_CONVERSION = "spend_without_conversion"
RULE_LOW_CTR = "low_ctr_at_volume"
RULE_SCALE = "scale_candidate"
