"""The extraction grid: requests, replay of recorded responses, validation, outcomes.

Nothing here may import truth tables or scores: what is extracted must not depend on what is right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscope.functions import text as T

FIELDS = ("name", "input_type", "scope", "evidence", "default_kind", "default_value", "default_evidence")
# The closed enumerations of a record.
TYPES = ("BOOLEAN", "BIGINT", "UBIGINT", "INTEGER", "DOUBLE", "FLOAT", "VARCHAR", "VARCHAR[]", "UNKNOWN")
SCOPES = ("GLOBAL", "LOCAL")
DEFAULT_KINDS = ("literal", "machine_dependent", "absent")
OUTCOMES = ("valid_first_pass", "valid_after_repair", "invalid_after_repair", "length_truncated", "unparseable", "provider_error", "provider_unavailable")
UNAVAILABLE_CODES = (402, 403, 404)
LEAST_EVIDENCE = 12


def grid(docs: DataFrame, arms: DataFrame, prompts: DataFrame) -> DataFrame:
    """Documents x arms x prompts. The arm and prompt sides are a handful of rows."""
    return docs.crossJoin(F.broadcast(arms)).crossJoin(F.broadcast(prompts))


def request_key(**fields: Column) -> Column:
    """SHA-256 of a canonical JSON of the named parts, keys sorted; null parts are left out."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def replay(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their recorded ``body``; ``replay`` is hit, failure or miss. A body wins over a failure record."""
    bodies = responses.filter("NOT is_failure").select("arm", "request_key", "body").dropDuplicates(["arm", "request_key"])
    failed = responses.filter("is_failure").select("arm", "request_key", F.col("body").alias("failure")).dropDuplicates(["arm", "request_key"])
    out = requests.join(bodies, ["arm", "request_key"], "left").join(failed, ["arm", "request_key"], "left")
    status = F.when(F.col("body").isNotNull(), "hit").when(F.col("failure").isNotNull(), "failure").otherwise("miss")
    return out.withColumn("replay", status).withColumn("body", F.coalesce("body", "failure")).drop("failure")


def backfill(results: DataFrame, responses: DataFrame) -> DataFrame:
    """Failure records for rows that ended in an error and have no record yet; running it again adds nothing."""
    lost = results.filter("error IS NOT NULL").select("arm", "request_key", "error", "latency_s").dropDuplicates(["arm", "request_key"])
    lost = lost.join(responses, ["arm", "request_key"], "left_anti")
    return lost.select("arm", "request_key", F.to_json(F.struct(F.lit(True).alias("_failure"), F.lit(True).alias("_backfilled"), "error", "latency_s")).alias("body"), F.lit(True).alias("is_failure"), "latency_s")


def parse_body(body: Column) -> dict[str, Column]:
    """A provider body as scalar columns; absent numbers are 0, an error without choices marks the call."""
    get = lambda p: F.get_json_object(body, p)
    number = lambda p, t: F.coalesce(get(p).try_cast(t), F.lit(0).cast(t))
    error = F.when(get("$.choices[0]").isNull(), F.coalesce(get("$.error.message"), get("$.error")))
    code = get("$.error.code").try_cast("int")
    return {
        "error": error,
        "unavailable": error.isNotNull() & F.coalesce(code.isin(*UNAVAILABLE_CODES), F.lit(False)),
        "content": get("$.choices[0].message.content"),
        "finish_reason": get("$.choices[0].finish_reason"),
        "tokens_in": number("$.usage.prompt_tokens", "bigint"),
        "tokens_out": number("$.usage.completion_tokens", "bigint"),
        "reasoning_tokens": number("$.usage.completion_tokens_details.reasoning_tokens", "bigint"),
        "cost": number("$.usage.cost", "double"),
        "latency_s": number("$._latency_s", "double"),
    }


def record_errors(r: Column, document: Column) -> Column:
    """Names of the checks that one record (a map of its fields) fails; ``document`` null skips the verbatim checks."""
    keys_ok = F.size(F.array_except(F.map_keys(r), F.lit(list(FIELDS)))) == 0
    all_ok = F.size(F.array_except(F.lit(list(FIELDS)), F.map_keys(r))) == 0
    inside = lambda span: document.isNull() | T.grounded(span, document)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    absent = r["default_kind"] == "absent"
    default_ok = F.when(absent, r["default_value"].isNull() & r["default_evidence"].isNull()).otherwise(
        ~blank(r["default_value"]) & ~blank(r["default_evidence"]) & inside(r["default_evidence"])
    )
    checks = {
        "extra_field": keys_ok,
        "missing_field": all_ok,
        "name": r["name"].rlike(T.IDENTIFIER),
        "input_type": r["input_type"].isin(*TYPES),
        "scope": r["scope"].isin(*SCOPES),
        "default_kind": r["default_kind"].isin(*DEFAULT_KINDS),
        "evidence_short": F.length(T.norm_space(r["evidence"])) >= LEAST_EVIDENCE,
        "evidence_not_verbatim": inside(r["evidence"]),
        "default": default_ok,
    }
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items())))


def validate(calls: DataFrame, document: str | None = "document") -> DataFrame:
    """Add ``settings`` (array of maps), ``errors`` (array of check names) and ``valid`` to ``calls (content, ...)``."""
    parsed = F.from_json("content", "struct<settings:array<map<string,string>>>")
    doc = F.col(document) if document else F.lit(None).cast("string")
    is_json = F.try_parse_json("content").isNotNull()
    out = calls.withColumn("settings", parsed["settings"])
    names = F.transform("settings", lambda r: r["name"])
    errors = (
        F.when(F.col("content").isNull() | ~is_json, F.array(F.lit("not_json")))
        .when(F.col("settings").isNull() | (F.size(F.array_except(F.json_object_keys("content"), F.array(F.lit("settings")))) > 0), F.array(F.lit("shape")))
        .otherwise(
            F.concat(
                F.array_distinct(F.flatten(F.transform("settings", lambda r: record_errors(r, doc)))),
                F.when(F.size(F.array_distinct(names)) < F.size(names), F.array(F.lit("duplicate_name"))).otherwise(F.array().cast("array<string>")),
            )
        )
    )
    return out.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def outcome(first: dict[str, Column], second: dict[str, Column]) -> Column:
    """The outcome ladder; the first rung that holds. Each call has ``error, unavailable, valid, not_json, finish_reason``."""
    failed = lambda c: F.when(c["unavailable"], "provider_unavailable").otherwise("provider_error")
    return (
        F.when(first["error"].isNotNull(), failed(first))
        .when(first["valid"], "valid_first_pass")
        .when(second["error"].isNotNull(), failed(second))
        .when(second["valid"], "valid_after_repair")
        .when(second["finish_reason"] == "length", "length_truncated")
        .when(second["not_json"], "unparseable")
        .otherwise("invalid_after_repair")
    )


def settle(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per request from ``attempts (keys, attempt, error, unavailable, content, finish_reason, tokens..., document)``.

    A second attempt is the repair. Tokens, cost and latency are sums over the attempts that count.
    """
    checked = validate(attempts).withColumn("not_json", F.array_contains("errors", "not_json"))
    call = F.struct("error", "unavailable", "valid", "not_json", "finish_reason", "settings", "errors")
    rows = checked.groupBy(*keys).agg(
        F.max_by(call, -F.col("attempt")).alias("one"),
        F.max_by(F.when(F.col("attempt") == 2, call), "attempt").alias("two"),
        (F.max("attempt") > 1).alias("repair_used"),
        *(F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cost", "latency_s")),
    )
    name = outcome(*({f: F.col(f"{n}.{f}") for f in ("error", "unavailable", "valid", "not_json", "finish_reason")} for n in ("one", "two")))
    final = lambda f: F.when(F.col("repair_used"), F.col(f"two.{f}")).otherwise(F.col(f"one.{f}"))
    return rows.select(*keys, name.alias("outcome"), "repair_used", final("settings").alias("settings"), final("errors").alias("validation_errors"), "tokens_in", "tokens_out", "cost", "latency_s")


def preceding_text(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, history)``: the request behind each reply is all turns before it, in order."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("history", F.array_join(F.collect_list("text").over(before), "\n"))
