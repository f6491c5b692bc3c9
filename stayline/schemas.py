"""Schemas of the five business tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ACCOUNTS = _struct(
    account_id=T.StringType(),
    account_name=T.StringType(),
    industry=T.StringType(),
    country=T.StringType(),
    signup_date=T.DateType(),
    referral_source=T.StringType(),
    plan_tier=T.StringType(),
    seats=T.IntegerType(),
    is_trial=T.BooleanType(),
    churn_flag=T.BooleanType(),
)

SUBSCRIPTIONS = _struct(
    subscription_id=T.StringType(),
    account_id=T.StringType(),
    # some sources give a time of day, which decides between subscriptions of one day
    start_date=T.TimestampType(),
    end_date=T.DateType(),
    plan_tier=T.StringType(),
    seats=T.IntegerType(),
    mrr_amount=MONEY,
    arr_amount=MONEY,
    is_trial=T.BooleanType(),
    upgrade_flag=T.BooleanType(),
    downgrade_flag=T.BooleanType(),
    churn_flag=T.BooleanType(),
    billing_frequency=T.StringType(),
    auto_renew_flag=T.BooleanType(),
)

FEATURE_USAGE = _struct(
    usage_id=T.StringType(),
    subscription_id=T.StringType(),
    usage_date=T.DateType(),
    feature_name=T.StringType(),
    usage_count=T.IntegerType(),
    usage_duration_secs=T.IntegerType(),
    error_count=T.IntegerType(),
    is_beta_feature=T.BooleanType(),
)

SUPPORT_TICKETS = _struct(
    ticket_id=T.StringType(),
    account_id=T.StringType(),
    submitted_at=T.TimestampType(),
    closed_at=T.TimestampType(),
    resolution_time_hours=T.DoubleType(),
    priority=T.StringType(),
    first_response_time_minutes=T.IntegerType(),
    # half points occur
    satisfaction_score=T.DoubleType(),
    escalation_flag=T.BooleanType(),
)

CHURN_EVENTS = _struct(
    churn_event_id=T.StringType(),
    account_id=T.StringType(),
    churn_date=T.DateType(),
    reason_code=T.StringType(),
    refund_amount_usd=MONEY,
    preceding_upgrade_flag=T.BooleanType(),
    preceding_downgrade_flag=T.BooleanType(),
    is_reactivation=T.BooleanType(),
    feedback_text=T.StringType(),
)

TABLES = {
    "accounts": ACCOUNTS,
    "subscriptions": SUBSCRIPTIONS,
    "feature_usage": FEATURE_USAGE,
    "support_tickets": SUPPORT_TICKETS,
    "churn_events": CHURN_EVENTS,
}
