"""ANSI SQL (DuckDB dialect) equivalents of the registered queries.

These are the independent oracle for correctness: each string runs over the raw
driver tables (``lineitem``, ``part``, ... registered as views) and must give the
same rows as the Spark DataFrame query of the same name.
"""

from __future__ import annotations

from adlens.constants import MEASURES

# --- shared CTE fragments -----------------------------------------------------

AD_FACT = """ad_fact AS (
  SELECT CAST(l.l_shipdate AS TIMESTAMP) AS date, p.p_type AS platform, s.s_name AS account_name,
         p.p_brand AS campaign_name, p.p_brand || '/' || p.p_type AS ad_group_name, p.p_name AS keyword,
         'P' || CAST(l.l_partkey AS VARCHAR) AS product_name,
         CAST(CAST(l.l_quantity AS BIGINT) * 100
              * (CASE WHEN CAST(regexp_extract(p.p_brand, '([0-9]+)$', 1) AS INTEGER) % 10 = 4 THEN 3 ELSE 1 END)
              AS BIGINT) AS impressions,
         CAST(l.l_linenumber + CAST(round(l.l_discount * 100) AS BIGINT) AS BIGINT) AS clicks,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS cost,
         CAST(CASE WHEN CAST(regexp_extract(p.p_brand, '([0-9]+)$', 1) AS INTEGER) % 8 = 0 OR l.l_returnflag = 'R'
                   THEN 0 ELSE l.l_linenumber END AS BIGINT) AS conversions,
         CAST(l.l_extendedprice * round(l.l_tax * 100) AS DECIMAL(18,2)) AS revenue,
         CAST(l.l_linenumber AS BIGINT) AS orders
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""

EVENT_FACT = """event_fact AS (
  SELECT CAST(ts AS TIMESTAMP) AS date,
         CASE WHEN user_id % 2 = 0 THEN 'app' ELSE 'web' END AS platform,
         'u' || CAST(user_id % 5 AS VARCHAR) AS account_name,
         'c' || json_extract_string(props, '$.k') AS campaign_name,
         '미분류' AS ad_group_name, event_type AS keyword, '미분류' AS product_name,
         CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS BIGINT) AS impressions,
         CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS BIGINT) AS clicks,
         CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS cost,
         CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS conversions,
         CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END
           AS revenue,
         CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS orders
  FROM events)"""


MONTHLY_ACCOUNT_FACT = AD_FACT.replace("ad_fact AS (", "base_fact AS (", 1) + """,
ad_fact AS (
  SELECT date, CASE WHEN month(date) = 3 THEN '네이버 ' || platform ELSE platform END AS platform,
         account_name || strftime(date, '/%Y-%m') AS account_name, campaign_name, ad_group_name, keyword, product_name,
         CASE WHEN month(date) IN (1, 3) THEN CAST(0 AS BIGINT) ELSE impressions END AS impressions,
         CASE WHEN month(date) IN (1, 3) THEN CAST(0 AS BIGINT) ELSE clicks END AS clicks,
         CASE WHEN month(date) IN (1, 3) THEN CAST(0 AS DECIMAL(18,2)) ELSE cost END AS cost,
         CASE WHEN month(date) IN (1, 2, 3) THEN CAST(0 AS BIGINT) ELSE conversions END AS conversions,
         CASE WHEN month(date) IN (1, 2, 3) THEN CAST(0 AS DECIMAL(18,2)) ELSE revenue END AS revenue, orders
  FROM base_fact)"""


UNCONVERTED_FACT = AD_FACT.replace("ad_fact AS (", "base_fact AS (", 1) + """,
ad_fact AS (
  SELECT date, platform, CAST(year(date) AS VARCHAR) AS account_name, campaign_name, ad_group_name, keyword, product_name,
         impressions // 100 * 100 * b AS impressions, impressions // 100 * b * b AS clicks, cost,
         CAST(0 AS BIGINT) AS conversions, CAST(0 AS DECIMAL(18,2)) AS revenue, orders
  FROM (SELECT *, CAST(regexp_extract(campaign_name, '([0-9]+)$', 1) AS BIGINT) AS b FROM base_fact))"""


def over_unconverted(sql: str) -> str:
    """The same statement over the fact without conversions."""
    return sql.replace(AD_FACT, UNCONVERTED_FACT)


def monthly_comments(a0: str, a1: str, b0: str, b1: str) -> str:
    side = lambda p, s, e: ", ".join(
        f"coalesce(sum({m}) FILTER (date >= '{s}' AND date <= '{e}'), 0)::DOUBLE AS {p}_{m}" for m in ("cost", "conversions", "revenue"))
    text = lambda d: f"CASE WHEN {d} > 0 THEN 'up' WHEN {d} < 0 THEN 'down' ELSE 'flat' END"
    return f"""{with_ctes(MONTHLY_ACCOUNT_FACT)},
p AS (SELECT account_name, {side('a', a0, a1)}, {side('b', b0, b1)},
             count(*) FILTER ((date >= '{a0}' AND date <= '{a1}') OR (date >= '{b0}' AND date <= '{b1}')) AS n
      FROM ad_fact GROUP BY account_name),
c AS (SELECT account_name, coalesce(b_revenue / nullif(b_cost, 0), 0) - coalesce(a_revenue / nullif(a_cost, 0), 0) AS roas,
             b_conversions - a_conversions AS conversions, b_cost - a_cost AS cost FROM p WHERE n > 0)
SELECT account_name, unnest([1, 2, 3]) AS comment_no, unnest(['roas', 'conversions', 'cost']) AS metric,
       unnest([{text('roas')}, {text('conversions')}, {text('cost')}]) AS direction FROM c
UNION ALL SELECT account_name, 0, NULL, 'nothing_to_compare' FROM p WHERE n = 0"""


def over_monthly_accounts(sql: str) -> str:
    """The same statement over the monthly account fact."""
    return sql.replace(AD_FACT, MONTHLY_ACCOUNT_FACT)


def sums(prefix: str = "") -> str:
    return ", ".join(f"CAST(COALESCE(SUM({m}), 0) AS DOUBLE) AS {prefix}{m}" for m in MEASURES)


def rates(p: str = "", out: str = "") -> str:
    def d(a, b):
        return f"COALESCE(CAST({p}{a} AS DOUBLE) / NULLIF(CAST({p}{b} AS DOUBLE), 0), 0)"
    return (f"{d('clicks', 'impressions')} AS {out}ctr, {d('cost', 'clicks')} AS {out}cpc, "
            f"{d('conversions', 'clicks')} AS {out}cvr, {d('cost', 'conversions')} AS {out}cpa, "
            f"{d('revenue', 'cost')} AS {out}roas")


def label_sql(grain: str, d: str = "date") -> str:
    y = f"CAST(year({d}) AS VARCHAR)"
    if grain == "daily":
        return f"strftime({d}, '%Y년 %m월 %d일')"
    if grain == "weekly":
        return f"CAST(isoyear({d}) AS VARCHAR) || '년 ' || CAST(week({d}) AS VARCHAR) || '주차'"
    if grain == "monthly":
        return f"strftime({d}, '%Y년 %m월')"
    if grain == "quarterly":
        return f"{y} || '년 ' || CAST(quarter({d}) AS VARCHAR) || '분기'"
    if grain == "half_year":
        return f"{y} || '년 ' || CASE WHEN month({d}) <= 6 THEN '상반기' ELSE '하반기' END"
    if grain == "yearly":
        return f"{y} || '년'"
    if grain == "seasonal":
        return (f"{y} || '년 ' || CASE WHEN month({d}) IN (3,4,5) THEN '봄' WHEN month({d}) IN (6,7,8) THEN '여름' "
                f"WHEN month({d}) IN (9,10,11) THEN '가을' ELSE '겨울' END")
    raise ValueError(grain)


GRAINS = ["daily", "weekly", "monthly", "quarterly", "half_year", "yearly", "seasonal"]
SEGMENTS = {"platform": "platform", "campaign": "campaign_name", "ad_group": "ad_group_name", "keyword": "keyword",
            "product": "product_name"}
METRICS11 = MEASURES + ["ctr", "cpc", "cvr", "cpa", "roas"]


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def kpi_summary(fact_cte: str = AD_FACT, fact: str = "ad_fact", scope: tuple[str, ...] = ()) -> str:
    keys = ", ".join(scope)
    sel = f"{keys}, " if scope else ""
    grp = f" GROUP BY {keys}" if scope else ""
    return (f"{with_ctes(fact_cte)}\nSELECT *, {rates()} FROM (SELECT {sel}CAST(COUNT(*) AS BIGINT) AS rows, {sums()} "
            f"FROM {fact}{grp}) t")


def segment(dim: str, scope: tuple[str, ...] = (), limit: int = 20, fact_cte: str = AD_FACT,
            fact: str = "ad_fact") -> str:
    keys = list(scope)
    inner = f"SELECT {', '.join(keys + [dim])}, {sums()} FROM {fact} GROUP BY {', '.join(keys + [dim])}"
    if not scope:
        return f"{with_ctes(fact_cte)}\nSELECT *, {rates()} FROM ({inner}) t ORDER BY cost DESC, {dim} LIMIT {limit}"
    part = ", ".join(keys)
    return (f"{with_ctes(fact_cte)}\nSELECT * EXCLUDE (rk) FROM (SELECT *, {rates()}, ROW_NUMBER() OVER "
            f"(PARTITION BY {part} ORDER BY cost DESC, {dim}) AS rk FROM ({inner}) t) u WHERE rk <= {limit}")


def segments_all(limit: int = 20) -> str:
    parts = [f"SELECT '{name}' AS segment, {dim} AS segment_value, {sums()} FROM ad_fact GROUP BY {dim}"
             for name, dim in SEGMENTS.items()]
    u = "\nUNION ALL\n".join(parts)
    return (f"{with_ctes(AD_FACT)}\nSELECT * FROM (SELECT *, {rates()}, CAST(ROW_NUMBER() OVER (PARTITION BY segment "
            f"ORDER BY cost DESC, segment_value) AS INTEGER) AS segment_rank FROM ({u}) t) u WHERE segment_rank <= {limit}")


def _period_select(grain: str, with_grain: bool, fact: str = "ad_fact", scope: tuple[str, ...] = ()) -> str:
    g = "".join(f"{k}, " for k in scope) + (f"'{grain}' AS grain, " if with_grain else "")
    lab = label_sql(grain)
    keys = ", ".join([*scope, lab])
    return (f"SELECT {g}{lab} AS period_label, CAST(MIN(date) AS DATE) AS period_start, "
            f"CAST(MAX(date) AS DATE) AS period_end, CAST(COUNT(*) AS BIGINT) AS rows, {sums()} "
            f"FROM {fact} WHERE date IS NOT NULL GROUP BY {keys}")


def period(grain: str, fact_cte: str = AD_FACT, fact: str = "ad_fact", scope: tuple[str, ...] = ()) -> str:
    return f"{with_ctes(fact_cte)}\nSELECT *, {rates()} FROM ({_period_select(grain, False, fact, scope)}) t"


def periods_all() -> str:
    u = "\nUNION ALL\n".join(_period_select(g, True) for g in GRAINS)
    return f"{with_ctes(AD_FACT)}\nSELECT *, {rates()} FROM ({u}) t"


def _unpivot(src: str, left: str, right: str, lname: str, rname: str, scope: tuple[str, ...] = ()) -> str:
    keys = "".join(f"{k}, " for k in scope)
    parts = []
    for i, m in enumerate(METRICS11):
        parts.append(f"SELECT {keys}{i} AS metric_no, '{m}' AS metric, {left}{m} AS {lname}, {right}{m} AS {rname} "
                     f"FROM {src}")
    u = "\nUNION ALL\n".join(parts)
    return (f"SELECT *, {rname} - {lname} AS delta, "
            f"COALESCE(({rname} - {lname}) / NULLIF({lname}, 0), 0) AS change_rate FROM ({u}) z")


def recent_comparison(scope: tuple[str, ...] = (), fact_cte: str = AD_FACT, fact: str = "ad_fact") -> str:
    keys = ", ".join(scope)
    sel = f"{keys}, " if scope else ""
    grp = f" GROUP BY {keys}" if scope else ""
    join = " USING (" + keys + ")" if scope else " ON TRUE"
    psum = ", ".join(f"CAST(COALESCE(SUM(CASE WHEN date < split THEN {m} END), 0) AS DOUBLE) AS p_{m}" for m in MEASURES)
    csum = ", ".join(f"CAST(COALESCE(SUM(CASE WHEN date >= split THEN {m} END), 0) AS DOUBLE) AS c_{m}" for m in MEASURES)
    return f"""{with_ctes(fact_cte)},
b AS (SELECT {sel}MIN(date) AS f, MAX(date) AS l FROM {fact} WHERE date IS NOT NULL{grp}),
s AS (SELECT {sel}l - to_days(CAST(GREATEST(CAST(floor(GREATEST(date_diff('day', f, l) + 1, 1) / 2) AS BIGINT), 1) - 1
                                  AS INTEGER)) AS split FROM b),
a AS (SELECT {sel}{psum}, {csum} FROM {fact} JOIN s{join} WHERE date IS NOT NULL{grp}),
r AS (SELECT *, {rates('p_', 'p_')}, {rates('c_', 'c_')} FROM a)
{_unpivot('r', 'p_', 'c_', 'previous', 'current', scope)}"""


def ab_comparison(a0: str, a1: str, b0: str, b1: str) -> str:
    in_a = f"(date >= TIMESTAMP '{a0}' AND date <= TIMESTAMP '{a1}')"
    in_b = f"(date >= TIMESTAMP '{b0}' AND date <= TIMESTAMP '{b1}')"
    asum = ", ".join(f"CAST(COALESCE(SUM(CASE WHEN {in_a} THEN {m} END), 0) AS DOUBLE) AS a_{m}" for m in MEASURES)
    bsum = ", ".join(f"CAST(COALESCE(SUM(CASE WHEN {in_b} THEN {m} END), 0) AS DOUBLE) AS b_{m}" for m in MEASURES)
    return f"""{with_ctes(AD_FACT)},
a AS (SELECT {asum}, {bsum} FROM ad_fact WHERE date IS NOT NULL AND ({in_a} OR {in_b})),
r AS (SELECT *, {rates('a_', 'a_')}, {rates('b_', 'b_')} FROM a),
u AS ({_unpivot('r', 'a_', 'b_', 'first_period', 'second_period')})
SELECT *, CASE WHEN abs(delta) < 1e-12 THEN 'no_change'
               WHEN (CASE WHEN metric IN ('cost', 'cpc', 'cpa') THEN delta < 0 ELSE delta > 0 END) THEN 'improved'
               ELSE 'worsened' END AS status FROM u"""


def comparison_comments(a0: str, a1: str, b0: str, b1: str) -> str:
    return f"""WITH cmp AS ({ab_comparison(a0, a1, b0, b1)})
SELECT CASE WHEN metric = 'roas' THEN 1 WHEN metric = 'conversions' THEN 2 ELSE 3 END AS comment_no, metric,
       CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'flat' END AS direction
FROM cmp WHERE metric IN ('roas', 'conversions', 'cost')"""


def season_start_sql(d: str) -> str:
    return (f"CASE WHEN month({d}) IN (3,4,5) THEN make_date(year({d}), 3, 1) "
            f"WHEN month({d}) IN (6,7,8) THEN make_date(year({d}), 6, 1) "
            f"WHEN month({d}) IN (9,10,11) THEN make_date(year({d}), 9, 1) "
            f"WHEN month({d}) = 12 THEN make_date(year({d}), 12, 1) ELSE make_date(year({d}) - 1, 12, 1) END")


def half_start_sql(d: str) -> str:
    return f"make_date(year({d}), CASE WHEN month({d}) <= 6 THEN 1 ELSE 7 END, 1)"


def preset_sql(preset: str, a: str = "anchor") -> tuple[str, str]:
    def minus(x, n):
        return f"CAST({x} - INTERVAL {n} DAY AS DATE)"
    if preset == "yesterday":
        return minus(a, 1), minus(a, 1)
    if preset == "last_15_days":
        return minus(a, 14), a
    if preset == "this_month":
        return f"CAST(date_trunc('month', {a}) AS DATE)", a
    if preset == "last_month":
        first = f"CAST(date_trunc('month', {a}) AS DATE)"
        return f"CAST({first} - INTERVAL 1 MONTH AS DATE)", minus(first, 1)
    if preset == "last_week":
        end = minus(f"CAST(date_trunc('week', {a}) AS DATE)", 1)
        return minus(end, 6), end
    if preset == "last_quarter":
        end = minus(f"CAST(date_trunc('quarter', {a}) AS DATE)", 1)
        return f"CAST(date_trunc('quarter', {end}) AS DATE)", end
    if preset == "last_half":
        end = minus(half_start_sql(a), 1)
        return half_start_sql(end), end
    if preset == "last_season":
        end = minus(season_start_sql(a), 1)
        return season_start_sql(end), end
    return minus(a, 6), a


PRESETS = ["last_7_days", "yesterday", "last_week", "last_15_days", "this_month", "last_month",
           "last_quarter", "last_half", "last_season"]


def preset_ranges() -> str:
    parts = []
    for i, p in enumerate(PRESETS):
        s, e = preset_sql(p)
        parts.append(f"SELECT anchor, {i} AS preset_no, '{p}' AS preset, {s} AS start_date, {e} AS end_date FROM an")
    u = "\nUNION ALL\n".join(parts)
    return f"""{with_ctes(AD_FACT)},
an AS (SELECT CAST(MAX(date) AS DATE) AS anchor FROM ad_fact WHERE date IS NOT NULL)
{u}"""


def preset_kpis() -> str:
    parts = []
    for p in PRESETS:
        s, e = preset_sql(p)
        parts.append(f"SELECT '{p}' AS preset, CAST(COUNT(*) FILTER (WHERE date >= CAST({s} AS TIMESTAMP) AND "
                     f"date <= CAST({e} AS TIMESTAMP)) AS BIGINT) AS rows, "
                     + ", ".join(f"CAST(COALESCE(SUM(CASE WHEN date >= CAST({s} AS TIMESTAMP) AND "
                                 f"date <= CAST({e} AS TIMESTAMP) THEN {m} END), 0) AS DOUBLE) AS {m}" for m in MEASURES)
                     + " FROM ad_fact JOIN an ON TRUE WHERE date IS NOT NULL")
    u = "\nUNION ALL\n".join(parts)
    return f"""{with_ctes(AD_FACT)},
an AS (SELECT CAST(MAX(date) AS DATE) AS anchor FROM ad_fact WHERE date IS NOT NULL),
k AS ({u})
SELECT *, {rates()} FROM k"""


def _base(scope: tuple[str, ...] = (), limit: int = 20) -> str:
    keys = list(scope)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    grp = ", ".join(keys + ["campaign_name"])
    return f"""base AS (
  SELECT * FROM (SELECT *, {rates()}, CAST(ROW_NUMBER() OVER ({part}ORDER BY cost DESC, campaign_name) AS INTEGER)
                 AS base_rank FROM (SELECT {grp}, {sums()} FROM ad_fact GROUP BY {grp}) t) u
  WHERE base_rank <= {limit}),
thr AS (
  SELECT *,
    GREATEST(quantile_cont(cost, 0.25) OVER w, SUM(cost) OVER w * 0.05) AS no_conversion_cost_threshold,
    quantile_cont(impressions, 0.75) OVER w AS high_impression_threshold,
    GREATEST(quantile_cont(ctr, 0.25) OVER w, 0.001) AS low_ctr_threshold,
    (SUM(impressions) OVER w <= 0 AND SUM(clicks) OVER w <= 0 AND SUM(cost) OVER w <= 0
     AND SUM(conversions) OVER w <= 0 AND SUM(revenue) OVER w <= 0) AS inactive
  FROM base WINDOW w AS ({part.strip()}))"""


def thresholds(scope: tuple[str, ...] = ()) -> str:
    keys = ", ".join(scope)
    sel = f"{keys}, " if scope else ""
    grp = f" GROUP BY {keys}" if scope else ""
    return f"""{with_ctes(AD_FACT, _base(scope))}
SELECT {sel}round(first(no_conversion_cost_threshold), 6) AS no_conversion_cost_threshold,
       round(first(high_impression_threshold), 6) AS high_impression_threshold,
       round(first(low_ctr_threshold), 9) AS low_ctr_threshold FROM thr{grp}"""


def _anomalies_body(scope: tuple[str, ...] = ()) -> str:
    keys = "".join(f"{k}, " for k in scope)
    target = "CASE WHEN campaign_name IS NOT NULL AND trim(campaign_name) <> '' AND campaign_name <> '미분류' " \
             "THEN campaign_name ELSE '미분류' END"
    common = f"{target} AS target, cost, ctr, cvr, roas FROM thr WHERE NOT inactive"
    return f"""SELECT {keys}base_rank, 1 AS rule_seq, 'high' AS severity, 'spend_without_conversion' AS rule_code, {common}
  AND cost >= no_conversion_cost_threshold AND conversions <= 0
UNION ALL
SELECT {keys}base_rank, 2, 'medium', 'low_ctr_at_volume', {common}
  AND impressions >= high_impression_threshold AND ctr <= low_ctr_threshold
UNION ALL
SELECT {keys}base_rank, 3, 'opportunity', 'scale_candidate', {common}
  AND cost > 0 AND roas >= 4 AND conversions > 0"""


def anomalies(scope: tuple[str, ...] = ()) -> str:
    return f"{with_ctes(AD_FACT, _base(scope))}\n{_anomalies_body(scope)}"


RECS = {"spend_without_conversion": ("P1", "lower bids or budget, or exclude the search terms", "cut wasted spend"),
        "low_ctr_at_volume": ("P2", "review creative copy, product names and keyword match types",
                              "lift click-through rate"),
        "scale_candidate": ("P2", "raise the daily budget or extend to similar keywords and products",
                            "grow conversion volume")}


def _case(col: str, pos: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v[pos]}'" for k, v in RECS.items())
    return f"CASE {col} {whens} END"


def recommendations(scope: tuple[str, ...] = ()) -> str:
    keys = ", ".join(scope)
    sel = f"{keys}, " if scope else ""
    grp = f" GROUP BY {keys}" if scope else ""
    using = f" USING ({keys})" if scope else " ON TRUE"
    return f"""{with_ctes(AD_FACT, _base(scope))},
an AS ({_anomalies_body(scope)}),
cn AS (SELECT {sel}COUNT(*) AS n FROM an{grp}),
sm AS (SELECT {sel}COUNT(*) AS rows, SUM(impressions) AS impressions, SUM(clicks) AS clicks, SUM(cost) AS cost,
              SUM(conversions) AS conversions, SUM(revenue) AS revenue FROM ad_fact{grp}),
gate AS (SELECT {sel}NOT (rows <= 0 OR (COALESCE(impressions,0) <= 0 AND COALESCE(clicks,0) <= 0 AND COALESCE(cost,0) <= 0
                     AND COALESCE(conversions,0) <= 0 AND COALESCE(revenue,0) <= 0)) AS active,
                COALESCE(n, 0) AS n, sm.cost, sm.conversions FROM sm LEFT JOIN cn{using})
SELECT {sel}base_rank AS rec_no, rule_seq, {_case('rule_code', 0)} AS priority, target, rule_code AS issue,
       {_case('rule_code', 1)} AS recommended_action, {_case('rule_code', 2)} AS expected_effect, severity AS risk_level
FROM an JOIN (SELECT {sel}active FROM gate) g{using} WHERE active
UNION ALL
SELECT {sel}0, 0, CASE WHEN cost > 0 AND conversions = 0 THEN 'P1' ELSE 'P3' END, 'all',
       CASE WHEN cost > 0 AND conversions = 0 THEN 'no_conversion_data' ELSE 'no_urgent_point' END,
       CASE WHEN cost > 0 AND conversions = 0 THEN 'check conversion tracking and the raw data by period and media'
            ELSE 'review top-spend and top-ROAS campaigns' END,
       CASE WHEN cost > 0 AND conversions = 0 THEN 'trustworthy analysis' ELSE 'find improvement candidates' END,
       CASE WHEN cost > 0 AND conversions = 0 THEN 'high' ELSE 'low' END
FROM gate WHERE active AND n = 0"""


def health_score(scope: tuple[str, ...] = ()) -> str:
    keys = ", ".join(scope)
    sel = f"{keys}, " if scope else ""
    grp = f" GROUP BY {keys}" if scope else ""
    join = f" LEFT JOIN c USING ({keys})" if scope else " LEFT JOIN c ON TRUE"
    return f"""{with_ctes(AD_FACT, _base(scope))},
an AS ({_anomalies_body(scope)}),
c AS (SELECT {sel}COUNT(*) FILTER (WHERE severity = 'high') AS n_high,
             COUNT(*) FILTER (WHERE severity = 'medium') AS n_medium,
             COUNT(*) FILTER (WHERE severity = 'opportunity') AS n_opportunity FROM an{grp}),
s AS (SELECT *, {rates()} FROM (SELECT {sel}{sums()} FROM ad_fact{grp}) t),
j AS (SELECT {sel}COALESCE(n_high, 0) AS n_high, COALESCE(n_medium, 0) AS n_medium,
             COALESCE(n_opportunity, 0) AS n_opportunity,
             CAST(GREATEST(0, LEAST(round_even(58 + LEAST(roas * 7, 30) + LEAST(ctr * 500, 8)
                  + LEAST(COALESCE(n_opportunity, 0) * 2, 8) - COALESCE(n_high, 0) * 10 - COALESCE(n_medium, 0) * 4, 0),
                  100)) AS INTEGER) AS health_score FROM s{join})
SELECT {sel}health_score, CASE WHEN health_score >= 80 THEN 'good' WHEN health_score >= 60 THEN 'fair' ELSE 'risk' END
       AS health_label, CAST(n_high AS BIGINT) AS n_high, CAST(n_medium AS BIGINT) AS n_medium,
       CAST(n_opportunity AS BIGINT) AS n_opportunity FROM j"""


def industry_tier() -> str:
    return f"""{with_ctes(AD_FACT)},
s AS (SELECT *, {rates()} FROM (SELECT {sums()} FROM ad_fact) t)
SELECT roas, cpc, roas - 4.1 AS roas_gap, (cpc - 980.0) / 980.0 AS cpc_gap,
       CASE WHEN roas >= 4.1 * 1.2 THEN 'top_15_percent' WHEN roas >= 4.1 THEN 'above_average' ELSE 'needs_check' END
       AS tier FROM s"""


def row_rates() -> str:
    return f"{with_ctes(AD_FACT)}\nSELECT *, {rates()} FROM ad_fact"


def money(x: str) -> str:
    return f"(format('{{:,.0f}}', CAST({x} AS DOUBLE)) || '원')"


def pct(x: str) -> str:
    return f"(format('{{:,.2f}}', CAST({x} AS DOUBLE) * 100) || '%')"


ISSUE_TEXT = {
    "spend_without_conversion": ("spend without conversions", "keyword intent mismatch, landing page or missing tracking",
                                 "cut budget, add negative keywords, check landing page and conversion tracking"),
    "low_ctr_at_volume": ("weak click response", "creative fatigue or copy not matching keywords",
                          "refresh creatives and align copy per core keyword"),
    "scale_candidate": ("strong results, budget can grow", "ROAS and conversions are both healthy",
                        "raise budget step-wise by 10-20 %"),
}


def _issue_case(pos: int, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v[pos]}'" for k, v in ISSUE_TEXT.items())
    return f"COALESCE(CASE rule_code {whens} END, {default})"


def action_issues(scope: tuple[str, ...] = (), top: int | None = None) -> str:
    keys = list(scope)
    sel = "".join(f"{k}, " for k in keys)
    grp = f" GROUP BY {', '.join(keys)}" if keys else ""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    using = f" USING ({', '.join(keys)})" if keys else " ON TRUE"
    score = ("(CASE severity WHEN 'high' THEN 100.0 WHEN 'medium' THEN 70.0 WHEN 'opportunity' THEN 60.0 "
             "WHEN 'low' THEN 20.0 ELSE 40.0 END + LEAST(cost / 100000, 30.0) "
             "+ CASE WHEN severity = 'high' AND roas <= 0 THEN 20.0 ELSE 0.0 END)")
    evidence = (f"'cost ' || {money('cost')} || ', ctr ' || {pct('ctr')} || ', cvr ' || {pct('cvr')} || "
                f"', roas ' || {pct('roas')}")
    effect = (f"CASE rule_code WHEN 'spend_without_conversion' THEN 'about ' || {money('cost * 0.15')} || "
              f"' monthly saving' WHEN 'low_ctr_at_volume' THEN 'CTR +10-20 %' WHEN 'scale_candidate' "
              f"THEN 'revenue +8-12 %' ELSE 'less wasted spend' END")
    cols = ("severity, priority_score, media, target, problem, evidence, cause_hypothesis, recommended_action, "
            "expected_effect, report_include")
    where_top = f" WHERE issue_rank <= {top}" if top else ""
    return f"""{with_ctes(AD_FACT, _base(scope))},
an AS ({_anomalies_body(scope)}),
sm AS (SELECT *, {rates()} FROM (SELECT {sel}CAST(COUNT(*) AS BIGINT) AS rows, {sums()} FROM ad_fact{grp}) t),
cn AS (SELECT {sel}COUNT(*) AS n_anomalies FROM an{grp}),
pl AS (SELECT {sel}platform, ROW_NUMBER() OVER ({part}ORDER BY c DESC, platform) AS rk
       FROM (SELECT {sel}platform, SUM(cost) AS c FROM ad_fact GROUP BY {sel}platform) t),
st AS (SELECT sm.*, COALESCE(cn.n_anomalies, 0) AS n_anomalies, pl.platform AS primary_platform,
              (rows < 3 OR (cost <= 0 AND impressions <= 0 AND clicks <= 0)) AS insufficient,
              LEAST(GREATEST(3 - GREATEST(COALESCE(cn.n_anomalies, 0), 1), 0), 2) AS support_n
       FROM sm LEFT JOIN cn{using} LEFT JOIN (SELECT * FROM pl WHERE rk = 1) pl{using}),
iss AS (
  SELECT {sel}base_rank * 10 + rule_seq AS _src, severity, {score} AS priority_score, 'undetermined' AS media, target,
         {_issue_case(0, 'rule_code')} AS problem, {evidence} AS evidence,
         {_issue_case(1, "'needs review'")} AS cause_hypothesis,
         {_issue_case(2, "'review by campaign, ad group and keyword'")} AS recommended_action,
         {effect} AS expected_effect, severity IN ('high', 'medium', 'opportunity') AS report_include
  FROM an JOIN (SELECT {sel}insufficient FROM st) g{using} WHERE NOT insufficient
  UNION ALL
  SELECT {sel}100000, 'low', 10.0, 'all_media', 'all', 'no urgent issue',
         'total roas ' || {pct('roas')} || ', cost ' || {money('cost')}, 'no clear waste signal in the current data',
         'keep checking top-spend and top-performing campaigns', 'keep results, find candidates', false
  FROM st WHERE NOT insufficient AND n_anomalies = 0
  UNION ALL
  SELECT {sel}100001, 'low', 5.0, 'all_media', 'this analysis', 'share the advertiser report',
         'total roas ' || {pct('roas')}, 'summarise key changes and next actions first',
         'send the report from the report centre', 'less reporting time', false
  FROM st WHERE NOT insufficient AND support_n >= 1
  UNION ALL
  SELECT {sel}100002, 'low', 4.0, 'all_media', 'industry benchmark', 'compare with the industry average',
         'cpc ' || {money('cpc')} || ', roas ' || {pct('roas')}, 'a high CPC can erode efficiency even with good ROAS',
         'check ROAS and CPC against the industry average', 'easier performance explanation', false
  FROM st WHERE NOT insufficient AND support_n >= 2
  UNION ALL
  SELECT {sel}0, 'low', 1.0, COALESCE(NULLIF(trim(primary_platform), ''), 'all_media'), 'all', 'insufficient data',
         'rows ' || format('{{:,.0f}}', CAST(rows AS DOUBLE)) || ', cost ' || {money('cost')},
         'too little data to infer a cause',
         CASE WHEN impressions <= 0 AND clicks <= 0 AND cost <= 0 AND conversions <= 0 AND revenue <= 0 THEN
              CASE WHEN COALESCE(NULLIF(trim(primary_platform), ''), 'all_media') LIKE '%네이버%'
                   THEN 'no search-ads performance data for the period' ELSE 'no ad performance data for the period' END
              ELSE 'upload recent data per media and re-run' END,
         'trustworthy analysis', false
  FROM st WHERE insufficient)
SELECT * FROM (SELECT {sel}{cols}, CAST(ROW_NUMBER() OVER ({part}ORDER BY priority_score DESC, _src) AS INTEGER)
               AS issue_rank FROM iss) z{where_top}"""
