"""Field policy, audit rows and request rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions import text as tx
from ..functions.numeric import lookup

CONTEXT_REQUEST = "llm_context"


def removed_fields(request_type: Column, payload: Column) -> Column:
    """Payload keys the policy takes out: personal fields, and for context requests whatever is not allow-listed."""
    keys = F.map_keys(payload)
    personal = F.filter(keys, lambda k: k.isin(*fx.PII_FIELDS))
    unlisted = F.filter(keys, lambda k: ~k.isin(*fx.PII_FIELDS) & ~k.isin(*fx.AGGREGATE_FIELDS))
    return F.when(request_type == CONTEXT_REQUEST, F.concat(personal, unlisted)).otherwise(personal)


def policy_evaluate(requests: DataFrame, request_type: str = "request_type", payload: str = "payload") -> DataFrame:
    """Decision, kept payload, removed keys and risk of a map payload."""
    kind = F.col(request_type)
    blocked = kind.isin(*fx.BLOCKED_REQUEST_TYPES)
    none = F.array().cast("array<string>")
    # A column of its own, so that the four results below share one evaluation
    listed = requests.withColumn(
        "removed", F.when(blocked, none).otherwise(removed_fields(kind, F.col(payload)))
    )
    found = F.size("removed")
    return listed.withColumns(
        {
            "action": F.when(blocked, "block").when(found > 0, "filtered").otherwise("allow"),
            "kept": F.when(~blocked, F.map_filter(payload, lambda k, v: ~F.array_contains(F.col("removed"), k))),
            "risk_level": F.when(blocked, "high").when(found > 2, "medium").otherwise("low"),
        }
    )


def context_payload(payload: Column) -> Column:
    """What a context request may see of a payload."""
    return F.map_filter(payload, lambda k, v: k.isin(*fx.AGGREGATE_FIELDS) & ~k.isin(*fx.PII_FIELDS))


def context_summary(kept: Column) -> Column:
    """'k=v, k=v' of the non-null payload entries."""
    present = F.filter(F.map_entries(kept), lambda e: e.value.isNotNull())
    return F.array_join(F.transform(present, lambda e: F.concat(e.key, F.lit("="), e.value)), ", ")


def context_record(df: DataFrame, farm: str, sensor: str, prediction: str) -> DataFrame:
    """Anonymised farm id with policy-filtered sensor and prediction summaries from two map columns."""
    safe_sensor = context_payload(F.col(sensor))
    safe_prediction = context_payload(F.col(prediction))
    value = lambda k: F.coalesce(F.try_element_at(safe_prediction, F.lit(k)), F.lit("N/A"))
    return df.withColumns(
        {
            "farm_ref": tx.anonymous_id(F.col(farm)),
            "sensor_summary": context_summary(safe_sensor),
            "prediction_summary": F.when(
                F.size(safe_prediction) > 0,
                F.concat(F.lit(fx.CONTEXT_SCORE), value("anomaly_score"), F.lit(fx.CONTEXT_STAGE), value("stage")),
            ).otherwise(""),
        }
    )


def audit_rows(calls: DataFrame, keep: list[str], prompt: str, response: str) -> DataFrame:
    """Hashes in place of the raw texts."""
    return calls.select(
        *keep, tx.content_hash(F.col(prompt)).alias("prompt_hash"), tx.content_hash(F.col(response)).alias("response_hash")
    )


def rate_limit(endpoint: Column) -> Column:
    return lookup(endpoint, fx.RATE_LIMITS, fx.DEFAULT_RATE_LIMIT)


def request_rate(
    requests: DataFrame, keys: list[str], micros: str, window_seconds: int = fx.RATE_WINDOW_SECONDS, slice_seconds: int = 3600
) -> DataFrame:
    """Requests of the same key in the window ending at each request.

    Time slices are the partitions; each request also goes to every later slice that its window reaches, so a very active
    key is spread over its slices. A window may be longer than a slice. Requests without a time are left out.
    """
    span, reach = slice_seconds * 1_000_000, window_seconds * 1_000_000
    home = F.floor(F.col(micros) / F.lit(span))
    last = F.floor((F.col(micros) + F.lit(reach)) / F.lit(span))
    spread = requests.withColumn("_home", home).withColumn("_slice", F.explode(F.sequence(F.col("_home"), last)))
    w = Window.partitionBy(*keys, "_slice").orderBy(micros).rangeBetween(-reach, 0)
    return (
        spread.withColumn("in_window", F.count("*").over(w))
        .filter(F.col("_slice") == F.col("_home"))
        .drop("_slice", "_home")
    )


def request_usage(requests: DataFrame, user: str, endpoint: str, time: str, seconds: int = fx.RATE_WINDOW_SECONDS) -> DataFrame:
    """Current usage per (user, endpoint) in the last ``seconds`` before the newest request."""
    now = requests.select(F.max(time)).scalar()
    recent = F.count_if(F.col(time) >= now - F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    limit = rate_limit(F.col(endpoint))
    return requests.groupBy(user, endpoint).agg(recent.alias("current_requests")).withColumn("limit", limit).withColumn(
        "remaining", F.greatest(F.lit(0), F.col("limit") - F.col("current_requests"))
    )
