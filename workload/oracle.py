"""The registered queries as SQL text over the raw test tables, for a second engine to run."""

from __future__ import annotations

VIEWS = """
first_order AS (
  SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS signup_date FROM orders GROUP BY o_custkey
),
accounts AS (
  SELECT c_custkey AS account_id, c_name AS account_name, c_mktsegment AS industry, n_name AS country, signup_date,
    CASE n_regionkey WHEN 0 THEN 'organic' WHEN 1 THEN 'ads' WHEN 2 THEN 'event' WHEN 3 THEN 'partner'
      WHEN 4 THEN 'other' END AS referral_source,
    CASE c_custkey % 3 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Pro' ELSE 'Enterprise' END AS plan_tier,
    CAST(1 + c_custkey % 50 AS INTEGER) AS seats,
    c_custkey % 7 = 0 AS is_trial,
    c_custkey * 7919 % 100 < 22 AS churn_flag
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN first_order ON c_custkey = o_custkey
),
priced_orders AS (
  SELECT *, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 100) AS BIGINT) END AS mrr FROM orders
),
subscriptions AS (
  SELECT o_orderkey AS subscription_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS start_date,
    CASE o_orderstatus WHEN 'F' THEN 'Basic' WHEN 'O' THEN 'Pro' WHEN 'P' THEN 'Enterprise' END AS plan_tier,
    mrr AS mrr_amount, 12 * mrr AS arr_amount,
    o_orderkey % 6 = 0 AS is_trial, o_orderkey % 10 = 1 AS upgrade_flag, o_orderkey % 20 = 3 AS downgrade_flag,
    o_orderkey % 10 = 5 AS churn_flag,
    CASE WHEN o_orderkey % 2 = 0 THEN 'monthly' ELSE 'annual' END AS billing_frequency,
    o_orderkey % 5 <> 0 AS auto_renew_flag
  FROM priced_orders
),
feature_usage AS (
  SELECT l_orderkey * 10 + l_linenumber AS usage_id, l_orderkey AS subscription_id,
    CAST(l_shipdate AS DATE) AS usage_date, 'feature_' || (l_partkey % 40) AS feature_name,
    CAST(l_quantity AS INTEGER) AS usage_count,
    CAST(floor(l_extendedprice / 10) AS INTEGER) AS usage_duration_secs,
    CAST(round(l_discount * 100) AS INTEGER) AS error_count, l_suppkey % 10 = 0 AS is_beta_feature
  FROM lineitem
),
ev AS (
  SELECT event_id, user_id, ts, event_type, CAST(value AS DECIMAL(18,2)) AS value,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
support_tickets AS (
  SELECT event_id AS ticket_id, user_id AS account_id, ts AS submitted_at, value AS resolution_time_hours,
    CASE event_type WHEN 'error' THEN 'urgent' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium'
      WHEN 'view' THEN 'low' END AS priority,
    k AS first_response_time_minutes, CASE WHEN k % 4 <> 0 THEN 1 + k % 5 END AS satisfaction_score,
    value > 100 AS escalation_flag
  FROM ev WHERE event_type <> 'signup'
),
churn_events AS (
  SELECT event_id AS churn_event_id, user_id AS account_id, CAST(ts AS DATE) AS churn_date,
    CASE k % 6 WHEN 0 THEN 'pricing' WHEN 1 THEN 'support' WHEN 2 THEN 'features' WHEN 3 THEN 'budget'
      WHEN 4 THEN 'competitor' WHEN 5 THEN 'unknown' END AS reason_code,
    CASE WHEN k % 4 = 0 THEN value ELSE 0 END AS refund_amount_usd, k % 10 = 0 AS is_reactivation
  FROM ev WHERE event_type = 'signup'
)"""

SUMMARIES = """
latest_sub AS (
  SELECT account_id, plan_tier AS sub_plan_tier, mrr_amount, arr_amount, billing_frequency, is_trial AS sub_is_trial,
    upgrade_flag, downgrade_flag, churn_flag AS sub_churn_flag, auto_renew_flag
  FROM subscriptions
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY start_date DESC NULLS LAST, subscription_id) = 1
),
support AS (
  SELECT account_id, count(ticket_id) AS ticket_count,
    CAST(sum(resolution_time_hours) AS DOUBLE) / count(resolution_time_hours) AS avg_resolution_hrs,
    CAST(sum(first_response_time_minutes) AS DOUBLE) / count(first_response_time_minutes) AS avg_first_response_mins,
    CAST(sum(satisfaction_score) AS DOUBLE) / nullif(count(satisfaction_score), 0) AS avg_satisfaction,
    CAST(count(*) FILTER (WHERE escalation_flag) AS BIGINT) AS escalation_count,
    CAST(count(*) FILTER (WHERE priority = 'urgent') AS BIGINT) AS urgent_ticket_count
  FROM support_tickets GROUP BY account_id
),
usage AS (
  SELECT account_id, count(usage_id) AS total_usage_events,
    CAST(coalesce(sum(usage_count), 0) AS BIGINT) AS total_usage_count,
    CAST(sum(usage_duration_secs) AS DOUBLE) / count(usage_duration_secs) AS avg_duration_secs,
    CAST(coalesce(sum(error_count), 0) AS BIGINT) AS total_errors,
    CAST(count(*) FILTER (WHERE is_beta_feature) AS BIGINT) AS beta_feature_uses,
    count(DISTINCT feature_name) AS unique_features
  FROM feature_usage JOIN (SELECT DISTINCT subscription_id, account_id FROM subscriptions) USING (subscription_id)
  GROUP BY account_id
),
churned AS (
  SELECT account_id,
    arg_min(reason_code, (churn_date, churn_event_id)) FILTER (WHERE reason_code IS NOT NULL) AS churn_reason,
    CAST(coalesce(sum(refund_amount_usd), 0) AS DOUBLE) AS refund_usd, bool_or(is_reactivation) AS is_reactivation
  FROM churn_events GROUP BY account_id
)"""

MASTER = """
master AS (
  SELECT a.account_id, account_name, industry, country, signup_date, referral_source, plan_tier, seats, is_trial,
    coalesce(churn_flag, sub_churn_flag) AS churn_flag,
    sub_plan_tier, mrr_amount, arr_amount, billing_frequency, sub_is_trial, upgrade_flag, downgrade_flag,
    sub_churn_flag, auto_renew_flag,
    coalesce(ticket_count, 0) AS ticket_count, avg_resolution_hrs, avg_first_response_mins, avg_satisfaction,
    coalesce(escalation_count, 0) AS escalation_count, coalesce(urgent_ticket_count, 0) AS urgent_ticket_count,
    coalesce(total_usage_events, 0) AS total_usage_events, coalesce(total_usage_count, 0) AS total_usage_count,
    avg_duration_secs, coalesce(total_errors, 0) AS total_errors,
    coalesce(beta_feature_uses, 0) AS beta_feature_uses, unique_features,
    churn_reason, refund_usd, is_reactivation,
    CAST(DATE '1997-01-01' - signup_date AS INTEGER) AS tenure_days,
    CASE WHEN coalesce(churn_flag, sub_churn_flag) THEN 'churned'
      WHEN NOT coalesce(churn_flag, sub_churn_flag) THEN 'retained' END AS churn_label
  FROM accounts a LEFT JOIN latest_sub USING (account_id) LEFT JOIN support USING (account_id)
    LEFT JOIN usage USING (account_id) LEFT JOIN churned USING (account_id)
)"""

DERIVED = """
flagged AS (
  SELECT * REPLACE (CAST(is_trial AS INTEGER) AS is_trial, CAST(sub_is_trial AS INTEGER) AS sub_is_trial,
      CAST(auto_renew_flag AS INTEGER) AS auto_renew_flag, CAST(upgrade_flag AS INTEGER) AS upgrade_flag,
      CAST(downgrade_flag AS INTEGER) AS downgrade_flag),
    CAST(tenure_days AS DOUBLE) / 30.0::DOUBLE AS tenure_months
  FROM master
),
derived AS (
  SELECT *,
    CAST(ticket_count AS DOUBLE) / nullif(tenure_months, 0) AS tickets_per_month,
    CAST(total_usage_events AS DOUBLE) / nullif(tenure_months, 0) AS usage_events_per_month,
    CAST(total_usage_count AS DOUBLE) / nullif(CAST(total_usage_events AS DOUBLE), 0) AS avg_usage_per_event,
    CAST(100 * total_errors AS DOUBLE) / nullif(CAST(total_usage_count AS DOUBLE), 0) AS errors_per_100_usage,
    CAST(total_usage_count AS DOUBLE) / nullif(CAST(unique_features AS DOUBLE), 0) AS usage_per_feature,
    CAST(mrr_amount AS DOUBLE) / nullif(CAST(seats AS DOUBLE), 0) AS revenue_per_seat,
    CAST(escalation_count AS DOUBLE) / nullif(CAST(ticket_count AS DOUBLE), 0) AS escalation_rate
  FROM flagged
)"""

SCORED = """
ranked AS (
  SELECT *, row_number() OVER (ORDER BY coalesce(mrr_amount, 0), account_id) AS r, count(*) OVER () AS n,
    CAST(account_id * 7919 % 1000 AS DOUBLE) / 1000.0::DOUBLE AS churn_probability,
    CAST(churn_flag AS INTEGER) AS label
  FROM master
),
valued AS (
  SELECT *, CASE WHEN 3 * (r - 1) < n - 1 THEN 'Low Value' WHEN 3 * (r - 1) < 2 * (n - 1) THEN 'Mid Value'
    ELSE 'High Value' END AS value_segment
  FROM ranked
),
prioritised AS (
  SELECT *, CASE
      WHEN value_segment = 'High Value' AND churn_probability >= 0.60 THEN 'P1 — High Value, High Risk'
      WHEN value_segment = 'Mid Value' AND churn_probability >= 0.50 THEN 'P2 — Mid Value, High Risk'
      WHEN churn_probability >= 0.40 THEN 'P3 — Low Value, High Risk'
      ELSE 'P4 — Low Risk' END AS retention_priority
  FROM valued
),
spine AS (
  SELECT unnest(['P1 — High Value, High Risk', 'P2 — Mid Value, High Risk', 'P3 — Low Value, High Risk',
    'P4 — Low Risk']) AS retention_priority
),
by_priority AS (
  SELECT retention_priority, count(*) AS accounts, round(avg(churn_probability), 6) AS mean_probability,
    CAST(coalesce(sum(mrr_amount), 0) AS BIGINT) AS mrr
  FROM prioritised GROUP BY retention_priority
)"""

# Numeric and categorical features of the models.
NUMERIC = (
    "tenure_days", "seats", "mrr_amount", "arr_amount", "ticket_count", "avg_resolution_hrs", "avg_first_response_mins", "avg_satisfaction",
    "escalation_count", "urgent_ticket_count", "total_usage_events", "total_usage_count", "avg_duration_secs", "total_errors",
    "beta_feature_uses", "unique_features", "tenure_months", "tickets_per_month", "usage_events_per_month", "avg_usage_per_event",
    "errors_per_100_usage", "usage_per_feature", "revenue_per_seat", "escalation_rate", "is_trial", "sub_is_trial", "auto_renew_flag",
    "upgrade_flag", "downgrade_flag",
)

CATEGORICAL = ("industry", "country", "referral_source", "sub_plan_tier", "billing_frequency")

ROUND_TRIP = """SELECT * REPLACE (round(avg_resolution_hrs, 6) AS avg_resolution_hrs,
  round(avg_first_response_mins, 6) AS avg_first_response_mins, round(avg_satisfaction, 6) AS avg_satisfaction,
  round(avg_duration_secs, 6) AS avg_duration_secs) FROM master"""

PCT_1DP = "floor(CAST(2000 * {a} + {b} AS DOUBLE) / CAST(2 * {b} AS DOUBLE)) / 10.0::DOUBLE"


def _with(select: str, *parts: str) -> str:
    return "WITH " + ",".join((VIEWS, *parts)) + "\n" + select


def _on_master(select: str, *parts: str) -> str:
    return _with(select, SUMMARIES, MASTER, *parts)


def _churn_report(dimension: str) -> str:
    a, b = "count(*) FILTER (WHERE churn_flag)", "count(*)"
    return _with(
        f"SELECT {dimension}, count(*) AS total_customers, CAST({a} AS BIGINT) AS churned_customers, "
        f"{PCT_1DP.format(a=a, b=b)} AS churn_rate_pct FROM accounts GROUP BY {dimension}"
    )


def _churn_rate(dimension: str) -> str:
    return _on_master(
        f"SELECT {dimension}, CAST(sum(CAST(churn_flag AS INTEGER)) AS DOUBLE) / count(churn_flag) * 100 AS churn_rate_pct "
        f"FROM master WHERE {dimension} IS NOT NULL GROUP BY {dimension}"
    )


def _fences(column: str) -> str:
    return f"""
points AS (
  SELECT churn_label, CAST({column} AS DOUBLE) AS v FROM master WHERE churn_label IS NOT NULL AND {column} IS NOT NULL
),
quarters AS (
  SELECT churn_label, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
  FROM points GROUP BY churn_label
),
fenced AS (
  SELECT *, v BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside
  FROM points JOIN quarters USING (churn_label)
)"""


def _box(column: str) -> str:
    return _on_master(
        """SELECT churn_label, count(*) AS n,
  round(least(min(v) FILTER (WHERE inside), q1), 6) AS whisker_low, round(q1, 6) AS q1, round(median, 6) AS median,
  round(q3, 6) AS q3, round(greatest(max(v) FILTER (WHERE inside), q3), 6) AS whisker_high,
  CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS outliers
FROM fenced GROUP BY churn_label, q1, median, q3""",
        _fences(column),
    )


def _outliers(column: str) -> str:
    return _on_master(
        "SELECT churn_label, round(v, 6) AS value, count(*) AS n FROM fenced WHERE NOT inside GROUP BY churn_label, v",
        _fences(column),
    )


def _on_scored(select: str, *parts: str) -> str:
    return _on_master(select, SCORED, *parts)


def _segment(edges_sql: str, name: str) -> str:
    return _on_master(f"SELECT account_id, {edges_sql} AS {name} FROM master")


TENURE = """CASE WHEN tenure_days > -1 AND tenure_days <= 180 THEN 'New (<6m)'
  WHEN tenure_days > 180 AND tenure_days <= 540 THEN 'Mid (6-18m)'
  WHEN tenure_days > 540 AND tenure_days <= 999999 THEN 'Loyal (>18m)' END"""

ENGAGEMENT = """CASE WHEN total_usage_events > -1 AND total_usage_events <= 5 THEN 'Low Engagement'
  WHEN total_usage_events > 5 AND total_usage_events <= 20 THEN 'Mid Engagement'
  WHEN total_usage_events > 20 AND total_usage_events <= 999999 THEN 'High Engagement' END"""

KPIS = """
figures AS (
  SELECT count(*) AS total_accounts,
    CAST(sum(CAST(churn_flag AS INTEGER)) AS DOUBLE) / count(churn_flag) * 100 AS churn_rate_pct,
    100 - CAST(sum(CAST(churn_flag AS INTEGER)) AS DOUBLE) / count(churn_flag) * 100 AS retention_rate_pct,
    avg(mrr_amount) AS avg_mrr, avg(arr_amount) AS avg_arr,
    CAST(coalesce(sum(mrr_amount) FILTER (WHERE churn_flag), 0) AS BIGINT) AS revenue_at_risk,
    avg(avg_resolution_hrs) AS avg_resolution_hrs, avg(avg_first_response_mins) AS avg_first_response_mins,
    avg(avg_satisfaction) AS avg_satisfaction,
    CAST(sum(CAST(churn_flag AS INTEGER)) FILTER (WHERE sub_is_trial) AS DOUBLE)
      / nullif(count(churn_flag) FILTER (WHERE sub_is_trial), 0) * 100 AS trial_churn_rate_pct
  FROM master
)"""

SCORES = """
per_score AS (
  SELECT churn_probability, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM ranked GROUP BY churn_probability
),
cumulated AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS q
  FROM per_score WINDOW w AS (ORDER BY churn_probability DESC ROWS UNBOUNDED PRECEDING)
)"""

CONFUSION = """
cells AS (
  SELECT CAST(count(*) FILTER (WHERE label = 0 AND churn_probability < 0.35) AS DOUBLE) AS tn,
    CAST(count(*) FILTER (WHERE label = 0 AND churn_probability >= 0.35) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (WHERE label = 1 AND churn_probability < 0.35) AS DOUBLE) AS fn,
    CAST(count(*) FILTER (WHERE label = 1 AND churn_probability >= 0.35) AS DOUBLE) AS tp
  FROM ranked
),
per_class AS (
  SELECT 'Retained' AS class_name, coalesce(tn / nullif(tn + fn, 0), 0) AS precision,
    coalesce(tn / nullif(tn + fp, 0), 0) AS recall, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f1_score,
    tn + fp AS support FROM cells
  UNION ALL
  SELECT 'Churned', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM cells
),
lines AS (
  SELECT * FROM per_class
  UNION ALL
  SELECT 'accuracy', a, a, a, s FROM (SELECT (tn + tp) / (tn + fp + fn + tp) AS a, tn + fp + fn + tp AS s FROM cells)
  UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM per_class
  UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1_score * support) / sum(support), sum(support) FROM per_class
)"""

HISTOGRAM = """
points AS (
  SELECT churn_label, CAST(mrr_amount AS DOUBLE) AS v FROM master
  WHERE churn_label IS NOT NULL AND mrr_amount IS NOT NULL
),
ranges AS (
  SELECT churn_label, CASE WHEN min(v) = max(v) THEN min(v) - 0.5::DOUBLE ELSE min(v) END AS low,
    CASE WHEN min(v) = max(v) THEN max(v) + 0.5::DOUBLE ELSE max(v) END AS high
  FROM points GROUP BY churn_label
),
bins AS (
  SELECT churn_label, CAST(b AS INTEGER) AS bin, low + b * ((high - low) / 25) AS bin_left,
    CASE WHEN b = 24 THEN high ELSE low + (b + 1) * ((high - low) / 25) END AS bin_right
  FROM ranges, range(25) AS t(b)
)"""


def _split_sizes() -> str:
    return _on_scored(
        """SELECT label, n, n - test AS train, test FROM (
  SELECT label, n, n - (base + CASE WHEN turn <= n_train - sum(base) OVER () THEN 1 ELSE 0 END) AS test FROM (
    SELECT *, n * n_train // all_n AS base,
      row_number() OVER (ORDER BY n * n_train % all_n DESC, label) AS turn
    FROM (
      SELECT *, all_n - (all_n + 4) // 5 AS n_train FROM (
        SELECT label, n, CAST(sum(n) OVER () AS BIGINT) AS all_n FROM (SELECT label, count(*) AS n FROM ranked GROUP BY label)
      )
    )
  )
)""".replace("SELECT label, n, n - test AS train, test FROM", "SELECT label, n, CAST(n - test AS BIGINT) AS train, CAST(test AS BIGINT) AS test FROM", 1)
    )


def _medians() -> str:
    parts = [f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM derived" for c in NUMERIC]
    return _on_master(
        "SELECT feature, round(quantile_cont(v, 0.5), 6) AS median FROM (\n"
        + "\nUNION ALL ".join(parts)
        + "\n) WHERE v IS NOT NULL GROUP BY feature",
        DERIVED,
    )


def _modes() -> str:
    parts = [f"SELECT '{c}' AS feature, {c} AS v FROM master" for c in CATEGORICAL]
    return _on_master(
        "SELECT feature, v AS mode FROM (SELECT feature, v, count(*) AS n FROM (\n"
        + "\nUNION ALL ".join(parts)
        + "\n) WHERE v IS NOT NULL GROUP BY feature, v) "
        "QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, v) = 1"
    )


def _model_checks() -> str:
    """Expected values from the tables: the sizes, and zero for what must not differ."""
    zero = [("best", "area_differs"), ("best", "is_not_largest"), ("best", "outside_0_1"), ("scored", "outside_0_1"), ("scored", "priority_differs"), ("importance", "top_differs")]
    rows = [
        f"SELECT '{m}' AS subject, 'held_out_rows' AS check_name, CAST((count(*) + 4) // 5 AS DOUBLE) AS value FROM master WHERE churn_flag IS NOT NULL"
        for m in ("logistic_regression", "random_forest", "extra_trees")
    ]
    rows += [f"SELECT '{s}', '{c}', 0.0::DOUBLE" for s, c in zero]
    rows += [f"SELECT 'scored', '{c}', CAST(count(*) AS DOUBLE) FROM master" for c in ("accounts", "distinct_accounts")]
    rows += ["SELECT 'importance', 'sum', 1.0::DOUBLE", "SELECT 'importance', 'top', 15.0::DOUBLE"]
    return _on_master("\nUNION ALL ".join(rows))


def _logistic(steps: int = 14) -> str:
    """Newton's method, one step after the other: sums over the accounts, then the solution of three equations."""
    parts = [
        """
rows_of AS (
  SELECT CAST(seats AS DOUBLE) AS x1, CAST(ticket_count AS DOUBLE) AS x2, CASE WHEN churn_flag THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y,
    CAST(count(*) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY churn_flag)) AS w
  FROM derived WHERE churn_flag IS NOT NULL AND seats IS NOT NULL AND ticket_count IS NOT NULL
),
n0 AS (SELECT 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3)"""
    ]
    for k in range(1, steps + 1):
        parts.append(
            f"""
s{k} AS (
  SELECT any_value(b1) AS b1, any_value(b2) AS b2, any_value(b3) AS b3, any_value(b1) - sum(w * y * m * x1) AS g1, any_value(b2) - sum(w * y * m * x2) AS g2,
    any_value(b3) - sum(w * y * m) AS g3, 1 + sum(w * m * (1 - m) * x1 * x1) AS a, sum(w * m * (1 - m) * x1 * x2) AS b, sum(w * m * (1 - m) * x1) AS c,
    1 + sum(w * m * (1 - m) * x2 * x2) AS d, sum(w * m * (1 - m) * x2) AS e, 1 + sum(w * m * (1 - m)) AS f
  FROM (SELECT *, 1 / (1 + exp(y * (b1 * x1 + b2 * x2 + b3))) AS m FROM rows_of, n{k - 1})
),
n{k} AS MATERIALIZED (
  SELECT b1 - ((d * f - e * e) * g1 + (c * e - b * f) * g2 + (b * e - c * d) * g3) / det AS b1,
    b2 - ((c * e - b * f) * g1 + (a * f - c * c) * g2 + (b * c - a * e) * g3) / det AS b2,
    b3 - ((b * e - c * d) * g1 + (b * c - a * e) * g2 + (a * d - b * b) * g3) / det AS b3
  FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s{k})
)"""
        )
    return _on_master(
        f"SELECT 'seats' AS slot, round(b1, 6) AS weight FROM n{steps} UNION ALL SELECT 'ticket_count', round(b2, 6) FROM n{steps} "
        f"UNION ALL SELECT 'constant', round(b3, 6) FROM n{steps}",
        DERIVED,
        *parts,
    )


def _out_of_fold() -> str:
    return _on_master(
        """SELECT fold, count(*) AS accounts, 0::BIGINT AS outside_0_1,
  CAST((SELECT count(*) FROM folds o WHERE o.churn_flag IS NOT NULL AND o.fold <> f.fold) AS BIGINT) AS trained_on, 0::BIGINT AS in_both
FROM folds f GROUP BY fold""",
        """
folds AS (SELECT churn_flag, CAST(('0x' || md5('fold 42:' || account_id)[1:15])::BIGINT % 5 AS INTEGER) AS fold FROM master)""",
    )


def _split_rows() -> str:
    sizes = _split_sizes().split("\nSELECT label, n, CAST", 1)[1]
    return _on_scored(
        "SELECT account_id, label, row_number() OVER (PARTITION BY label ORDER BY draw, account_id) <= test AS is_test FROM ("
        "SELECT account_id, label, ('0x' || md5('42:' || account_id)[1:15])::BIGINT AS draw FROM ranked) "
        f"JOIN (SELECT label, n, CAST{sizes}) USING (label)"
    )


def _encoded() -> str:
    numbers = [
        f"SELECT account_id, 'num__{c}' AS slot, coalesce(CAST({c} AS DOUBLE), quantile_cont(CAST({c} AS DOUBLE), 0.5) OVER ()) AS v FROM derived"
        for c in NUMERIC
    ]
    categories = [
        f"""SELECT d.account_id, 'cat__{c}_' || k.v AS slot, CAST(CAST(coalesce(d.{c}, m.v) = k.v AS INTEGER) AS DOUBLE) AS v
FROM derived d, (SELECT DISTINCT {c} AS v FROM derived WHERE {c} IS NOT NULL) k,
  (SELECT {c} AS v FROM derived WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) m"""
        for c in CATEGORICAL
    ]
    return _on_master(
        "SELECT account_id, slot, round(v, 6) AS value FROM (\n" + "\nUNION ALL ".join(numbers + categories) + "\n)",
        DERIVED,
    )


# the same faults as in workload/checks.py
DIRTY = """
accounts AS (
  SELECT * REPLACE (CASE WHEN account_id % 11 <> 0 THEN industry END AS industry,
    CASE WHEN account_id % 19 = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(seats AS DOUBLE) END AS seats,
    CASE WHEN account_id % 5 <> 0 THEN churn_flag END AS churn_flag) FROM clean_accounts
),
subscriptions AS (
  SELECT * REPLACE (CASE WHEN subscription_id % 13 <> 0 THEN account_id END AS account_id,
    CAST(mrr_amount + 0.25 AS DECIMAL(18,2)) AS mrr_amount,
    CASE WHEN subscription_id % 17 = 0 THEN 'n/a' ELSE CAST(arr_amount AS VARCHAR) END AS arr_amount) FROM clean_subscriptions
),
support_tickets AS (
  SELECT * REPLACE (CASE WHEN ticket_id % 3 = 0 THEN satisfaction_score + 0.5::DOUBLE ELSE satisfaction_score END AS satisfaction_score)
  FROM clean_support_tickets
),
churn_events AS (
  SELECT * REPLACE (CASE WHEN churn_event_id % 4 <> 0 THEN reason_code END AS reason_code) FROM clean_churn_events
)"""


def _on_dirty(select: str, *parts: str) -> str:
    views = VIEWS
    for name in ("accounts", "subscriptions", "support_tickets", "churn_events"):
        views = views.replace(f"\n{name} AS (", f"\nclean_{name} AS (")
    return "WITH " + ",".join((views, DIRTY, *parts)) + "\n" + select


def _dirty_master() -> str:
    return _on_dirty(
        """SELECT account_id, industry, churn_flag, churn_label, CASE WHEN NOT isinf(seats) THEN seats END AS seats,
  CAST(mrr_amount AS DOUBLE) AS mrr_amount, TRY_CAST(arr_amount AS DOUBLE) AS arr_amount,
  round(avg_satisfaction, 6) AS avg_satisfaction, churn_reason,
  round(CASE WHEN isinf(seats) THEN CASE WHEN mrr_amount IS NOT NULL THEN 0.0::DOUBLE END
    ELSE CAST(mrr_amount AS DOUBLE) / nullif(seats, 0) END, 6) AS revenue_per_seat
FROM master""",
        SUMMARIES,
        MASTER,
    )


def _profile() -> str:
    widths = {"accounts": 10, "subscriptions": 12, "feature_usage": 8, "support_tickets": 8, "churn_events": 6}
    return _with(
        "\nUNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST({w} AS INTEGER) AS n_cols FROM {t}"
            for t, w in widths.items()
        )
    )


def _impact(text: bool) -> str:
    at_risk = "coalesce(sum(mrr_amount) FILTER (WHERE churn_probability >= 0.40), 0)"
    is_p1 = "retention_priority = 'P1 — High Value, High Risk'"
    p1 = f"coalesce(sum(mrr_amount) FILTER (WHERE {is_p1}), 0)"
    count = f"count(*) FILTER (WHERE {is_p1})"
    if text:
        columns = (f"format('${{:,}}', CAST({at_risk} AS BIGINT))", f"format('${{:,}}', CAST({p1} AS BIGINT))", f"CAST({count} AS VARCHAR)")
    else:
        columns = tuple(f"CAST({c} AS BIGINT)" for c in (at_risk, p1, count))
    return _on_scored(
        "SELECT {} AS predicted_revenue_at_risk, {} AS p1_revenue_at_risk, {} AS high_value_customers_at_risk "
        "FROM prioritised".format(*columns)
    )


def _kpi_text() -> str:
    lines = [
        ("Total Accounts", "CAST(total_accounts AS VARCHAR)"),
        ("Churn Rate (%)", "printf('%.1f', churn_rate_pct)"),
        ("Retention Rate (%)", "printf('%.1f', retention_rate_pct)"),
        ("Average MRR (USD)", "format('${:,}', CAST(round_even(avg_mrr, 0) AS BIGINT))"),
        ("Average ARR (USD)", "format('${:,}', CAST(round_even(avg_arr, 0) AS BIGINT))"),
        ("Revenue at Risk (MRR, USD)", "format('${:,}', revenue_at_risk)"),
        ("Avg Support Resolution (hrs)", "printf('%.1f', avg_resolution_hrs)"),
        ("Avg First Response (min)", "printf('%.0f', avg_first_response_mins)"),
        ("Avg Satisfaction Score", "printf('%.2f', avg_satisfaction) || ' / 5'"),
        ("Trial Churn Rate (%)", "coalesce(printf('%.1f', trial_churn_rate_pct), 'N/A')"),
    ]
    return _on_master(
        "\nUNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS position, '{name}' AS kpi, {sql} AS value FROM figures"
            for i, (name, sql) in enumerate(lines, start=1)
        ),
        KPIS,
    )


def oracle_sql() -> dict[str, str]:
    queries = {
        "report_churn_by_plan": _churn_report("plan_tier"),
        "report_churn_by_industry": _churn_report("industry"),
        "report_revenue_at_risk": _with(
            """SELECT CAST(coalesce(sum(held.mrr) FILTER (WHERE accounts.churn_flag), 0) AS BIGINT) AS churned_mrr,
  CAST(coalesce(sum(held.mrr) FILTER (WHERE NOT accounts.churn_flag), 0) AS BIGINT) AS active_mrr,
  CAST(sum(held.mrr) AS BIGINT) AS total_mrr
FROM (SELECT account_id, sum(mrr_amount) AS mrr FROM subscriptions GROUP BY account_id) AS held JOIN accounts USING (account_id)"""
        ),
        "report_sla_breaches": _with(
            """SELECT priority, count(*) AS total_tickets,
  round(CAST(sum(resolution_time_hours) AS DOUBLE) / count(resolution_time_hours), 1) AS avg_resolution_hours,
  CAST(count(*) FILTER (WHERE resolution_time_hours > limits.hours) AS BIGINT) AS sla_breaches
FROM support_tickets LEFT JOIN (VALUES ('low', 48), ('medium', 24), ('high', 8), ('urgent', 4)) AS limits(priority, hours)
  USING (priority)
GROUP BY priority"""
        ),
        "report_feature_errors": _with(
            """SELECT feature_name, CAST(sum(usage_count) AS BIGINT) AS total_usage,
  CAST(sum(error_count) AS BIGINT) AS total_errors,
  round(CAST(100 * sum(error_count) AS DOUBLE) / nullif(CAST(sum(usage_count) AS DOUBLE), 0), 2) AS error_rate_pct
FROM feature_usage GROUP BY feature_name"""
        ),
        "report_churn_reasons": _with(
            """SELECT reason_code, count(*) AS churn_count,
  round(CAST(sum(refund_amount_usd) AS DOUBLE) / count(refund_amount_usd), 2) AS avg_refund_usd
FROM churn_events GROUP BY reason_code"""
        ),
        "report_top_customers": _with(
            """SELECT a.account_name, a.industry, max(s.mrr_amount) AS mrr
FROM accounts a JOIN subscriptions s ON a.account_id = s.account_id
GROUP BY a.account_name, a.industry ORDER BY mrr DESC, a.account_name, a.industry LIMIT 10"""
        ),
        "report_signup_cohorts": _with(
            "SELECT CAST(date_trunc('month', signup_date) AS DATE) AS cohort_month, count(*) AS total_customers, "
            "CAST(count(*) FILTER (WHERE churn_flag) AS BIGINT) AS churned, "
            + PCT_1DP.format(a="count(*) FILTER (WHERE churn_flag)", b="count(*)")
            + " AS churn_rate_pct FROM accounts GROUP BY 1"
        ),
        "churn_reason_counts": _with(
            "SELECT reason_code, count(*) AS n FROM churn_events WHERE reason_code IS NOT NULL GROUP BY reason_code"
        ),
        "latest_subscription": _with("SELECT * FROM latest_sub", SUMMARIES),
        "support_summary": _with("SELECT * FROM support", SUMMARIES),
        "usage_summary": _with("SELECT * FROM usage", SUMMARIES),
        "churn_summary": _with("SELECT * FROM churned", SUMMARIES),
        "master_table": _on_master("SELECT * FROM master"),
        "table_profile": _profile(),
        "kpis": _on_master(
            """SELECT * REPLACE (round(avg_mrr, 6) AS avg_mrr, round(avg_arr, 6) AS avg_arr,
  round(avg_resolution_hrs, 6) AS avg_resolution_hrs, round(avg_first_response_mins, 6) AS avg_first_response_mins,
  round(avg_satisfaction, 6) AS avg_satisfaction) FROM figures""",
            KPIS,
        ),
        "kpi_text": _kpi_text(),
        "churn_rate_by_plan": _churn_rate("sub_plan_tier"),
        "churn_rate_by_industry": _churn_rate("industry"),
        "churn_rate_by_referral": _churn_rate("referral_source"),
        "churn_rate_by_billing": _churn_rate("billing_frequency"),
        "mrr_histogram": _on_master(
            """SELECT b.churn_label, b.bin, round(b.bin_left, 6) AS bin_left, round(b.bin_right, 6) AS bin_right,
  count(p.v) AS n
FROM bins b LEFT JOIN points p ON p.churn_label = b.churn_label AND p.v >= b.bin_left
  AND (p.v < b.bin_right OR (b.bin = 24 AND p.v <= b.bin_right))
GROUP BY b.churn_label, b.bin, b.bin_left, b.bin_right""",
            HISTOGRAM,
        ),
        "derived_features": _on_master(
            """SELECT account_id, is_trial, sub_is_trial, auto_renew_flag, upgrade_flag, downgrade_flag, tenure_months,
  tickets_per_month, usage_events_per_month, avg_usage_per_event, errors_per_100_usage, usage_per_feature,
  revenue_per_seat, escalation_rate FROM derived""",
            DERIVED,
        ),
        "value_segment": _on_scored("SELECT account_id, value_segment FROM valued"),
        "tenure_segment": _segment(TENURE, "tenure_segment"),
        "engagement_segment": _segment(ENGAGEMENT, "engagement_segment"),
        "value_segment_counts": _on_scored("SELECT value_segment, count(*) AS n FROM valued GROUP BY value_segment"),
        "tenure_segment_counts": _on_master(
            f"SELECT {TENURE} AS tenure_segment, count(*) AS n FROM master GROUP BY 1"
        ),
        "retention_priority": _on_scored(
            "SELECT account_id, value_segment, churn_probability, retention_priority FROM prioritised"
        ),
        "priority_counts": _on_scored(
            "SELECT retention_priority, coalesce(accounts, 0) AS accounts FROM spine LEFT JOIN by_priority USING (retention_priority)"
        ),
        "priority_mean_probability": _on_scored(
            "SELECT retention_priority, mean_probability FROM spine LEFT JOIN by_priority USING (retention_priority)"
        ),
        "priority_mrr": _on_scored(
            "SELECT retention_priority, mrr FROM spine LEFT JOIN by_priority USING (retention_priority)"
        ),
        "business_impact": _impact(text=False),
        "business_impact_text": _impact(text=True),
        "retention_actions": _on_scored(
            """SELECT account_name, industry, mrr_amount, churn_probability, retention_priority,
  CASE retention_priority WHEN 'P1 — High Value, High Risk' THEN 'Immediate call + custom discount'
    WHEN 'P2 — Mid Value, High Risk' THEN 'Targeted email + support follow-up'
    WHEN 'P3 — Low Value, High Risk' THEN 'Automated nudges / offers'
    WHEN 'P4 — Low Risk' THEN 'Upsell / loyalty program' END AS recommended_action
FROM prioritised ORDER BY churn_probability DESC, account_id LIMIT 20"""
        ),
        "class_weights": _on_scored(
            """SELECT label, n, CAST(sum(n) OVER () AS DOUBLE) / CAST(count(*) OVER () * n AS DOUBLE) AS weight
FROM (SELECT label, count(*) AS n FROM ranked GROUP BY label)"""
        ),
        "roc_auc": _on_scored(
            "SELECT round(CAST(sum(pos * (2 * (q - fp) + neg)) AS DOUBLE) / (2 * CAST(max(p) AS DOUBLE) * CAST(max(q) AS DOUBLE)), 6) AS roc_auc FROM cumulated",
            SCORES,
        ),
        "roc_curve": _on_scored(
            """SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT churn_probability, CAST(fp AS DOUBLE) / CAST(q AS DOUBLE), CAST(tp AS DOUBLE) / CAST(p AS DOUBLE) FROM (
  SELECT *, row_number() OVER s AS place, lead(pos) OVER s AS next_pos, lead(neg) OVER s AS next_neg FROM cumulated
  WINDOW s AS (ORDER BY churn_probability DESC)
) WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""",
            SCORES,
        ),
        "classification_report": _on_scored(
            """SELECT class_name, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1_score, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM lines""",
            CONFUSION,
        ),
        "stratified_split_sizes": _split_sizes(),
        "impute_median": _medians(),
        "impute_mode": _modes(),
        "split_rows": _split_rows(),
        "model_checks": _model_checks(),
        "logistic_coefficients": _logistic(),
        "out_of_fold_checks": _out_of_fold(),
        "encoded_features": _encoded(),
        "master_preview": _on_master("SELECT * FROM master ORDER BY account_id LIMIT 3"),
        "csv_round_trip": _on_master(ROUND_TRIP),
        "catalog_round_trip": _on_master(ROUND_TRIP),
        "scored_round_trip": _on_scored(
            "SELECT account_id, churn_probability, retention_priority, retention_priority[1:2] AS priority_class FROM prioritised"
        ),
        "dirty_master": _dirty_master(),
        "dirty_reason_counts": _on_dirty(
            "SELECT reason_code, count(*) AS n FROM churn_events WHERE reason_code IS NOT NULL GROUP BY reason_code"
        ),
        "dirty_churn_rate": _on_dirty(
            "SELECT industry, CAST(sum(CAST(churn_flag AS INTEGER)) AS DOUBLE) / count(churn_flag) * 100 AS churn_rate_pct "
            "FROM master WHERE industry IS NOT NULL GROUP BY industry",
            SUMMARIES,
            MASTER,
        ),
    }
    queries["actions_round_trip"] = queries["retention_actions"]
    boxes = {
        "satisfaction": "avg_satisfaction",
        "usage_events": "total_usage_events",
        "resolution": "avg_resolution_hrs",
        "errors": "total_errors",
    }
    for name, column in boxes.items():
        queries[f"box_{name}"] = _box(column)
        queries[f"outliers_{name}"] = _outliers(column)
    return queries
