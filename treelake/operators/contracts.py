"""Checks of plans, schemas, responses, replays and reports, and of cookies as they are set."""

from __future__ import annotations

import json
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STEPS = 64
# What a JSON schema's types are in Python.
_TYPES = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}


def schema_error(value: object, schema: object, path: str = "$", depth: int = 0) -> str | None:
    """The first thing in which a value breaks a schema (of the supported keywords), or None."""
    if depth > 12:
        return "schema is too deep"
    if not isinstance(schema, dict):
        return f"schema at {path} must be an object"
    kind = schema.get("type")
    if isinstance(kind, str):
        wanted = _TYPES.get(kind)
        if wanted is None:
            return f"unsupported type at {path}"
        if not isinstance(value, wanted) or isinstance(value, bool) and kind in ("number", "integer"):
            return f"{path} must be {kind}"

    def same(a: object, b: object) -> bool:
        return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)

    if "const" in schema and not same(value, schema["const"]):
        return f"{path} does not match const"
    if isinstance(schema.get("enum"), list) and not any(same(value, c) for c in schema["enum"]):
        return f"{path} is not in enum"
    fits = {k: [schema_error(value, b, path, depth + 1) for b in schema[k]] for k in ("anyOf", "oneOf", "allOf") if isinstance(schema.get(k), list)}
    if "anyOf" in fits and None not in fits["anyOf"]:
        return f"{path} does not match anyOf"
    if "oneOf" in fits and fits["oneOf"].count(None) != 1:
        return f"{path} must match one of oneOf"
    if error := next((e for e in fits.get("allOf", []) if e), None):
        return error
    if isinstance(value, dict) and isinstance(schema.get("properties"), dict):
        if missing := next((k for k in schema.get("required", []) if k not in value), None):
            return f"missing {path}.{missing}"
        below = [(v, schema["properties"][k], f"{path}.{k}") for k, v in value.items() if k in schema["properties"]]
    elif isinstance(value, list) and "items" in schema:
        below = [(v, schema["items"], f"{path}[{i}]") for i, v in enumerate(value)]
    else:
        below = []
    return next((e for v, s, p in below if (e := schema_error(v, s, p, depth + 1))), None)


def plan_errors(steps: DataFrame, tools: list[str], mutating: list[str]) -> DataFrame:
    """(plan_id, error) of plans given as steps (plan_id, step_ord, step_id, tool, confirmed): no row, no error."""
    seen = steps.groupBy("plan_id").agg(
        F.count("*").alias("n"), F.count_distinct("step_id").alias("ids"), F.min_by("tool", "step_ord").alias("first"), F.count_if(F.col("tool") == "open_page").alias("opens"),
        F.count_if(~F.col("tool").isin(*tools)).alias("unknown"), F.count_if(F.col("tool").isin(*mutating) & ~F.coalesce("confirmed", F.lit(False))).alias("unconfirmed"),
    )
    checks = {"too many steps": F.col("n") > MOST_STEPS, "duplicate step id": F.col("ids") < F.col("n"), "first step must open the page": F.col("first") != "open_page", "exactly one open_page": F.col("opens") != 1, "unsupported tool": F.col("unknown") > 0, "mutating step needs approval": F.col("unconfirmed") > 0}
    found = F.array_compact(F.array(*(F.when(c, F.lit(e)) for e, c in checks.items())))
    return seen.select("plan_id", F.explode(found).alias("error"))


def expectation(response: Column, is_error: Column, path: Column, equals: Column) -> Column:
    """Outcome of a step's expectation on its JSON response; ``path`` is a JSON path into the payload."""
    result = F.get_json_object(response, "$.result")
    wrong = F.coalesce(F.get_json_object(response, "$.result.isError") == "true", F.lit(False)) != F.coalesce(is_error, F.lit(False))
    payload = F.get_json_object(response, "$.result.content[0].text")
    actual = F.try_variant_get(F.try_parse_json(payload), path, "string")
    return F.when(result.isNull(), "missing_result").when(wrong, "tool_error_expectation").when(path.isNotNull() & actual.isNull(), "expectation_path_missing").when(path.isNotNull() & equals.isNotNull() & (actual != equals), "expectation_mismatch").otherwise("ok")


def replay_status(joined: DataFrame, targets: str = "matching_targets") -> DataFrame:
    """``joined`` with the verdict of a replay request against its recorded event and the page as it is.

    Columns: trace_id, log_trace_id, event_action (null: not retained), origin, event_origin, url_key,
    event_url_key, has_target, the count of matching targets, target_offers, state_key,
    event_state_key, confirmed. The first thing that doesn't hold names the verdict.
    """
    c = F.col
    verdict = (
        F.when(~c("trace_id").eqNullSafe(c("log_trace_id")), "cross_session")
        .when(c("event_action").isNull(), "event_not_retained")
        .when(c("event_action").isin("open_page", "close_page", "evaluate", "set_cookies", "clear_cookies"), "unsupported_action")
        .when(~c("origin").eqNullSafe(c("event_origin")), "origin_drift")
        .when(~c("url_key").eqNullSafe(c("event_url_key")), "page_drift")
        .when(c("has_target") & (c(targets) == 0), "target_missing")
        .when(c("has_target") & (c(targets) > 1), "target_ambiguous")
        .when(c("has_target") & ~c("target_offers"), "action_unavailable")
        .when(~c("state_key").eqNullSafe(c("event_state_key")), "state_drift")
        .when(~F.coalesce(c("confirmed"), F.lit(False)), "confirmation_required")
        .otherwise("validated")
    )
    return joined.withColumn("status", verdict)


def report_violations(results: DataFrame, summary: DataFrame) -> DataFrame:
    """(rule) of every invariant that a run's summary (one row) breaks against its results (input_url, status)."""
    counts = results.agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "blocked", "failed")), F.count_if(~F.col("status").isin("ok", "blocked", "failed") | F.col("status").isNull()).alias("n_other"), F.count_distinct("input_url").alias("urls"))
    both = counts.crossJoin(summary)  # one row each
    rules = {"total": F.col("n") != F.col("total"), "ok": F.col("n_ok") != F.col("ok"), "blocked": F.col("n_blocked") != F.col("blocked"), "failed": F.col("n_failed") != F.col("failed"), "status": F.col("n_other") > 0, "urls": F.col("urls") != F.col("n")}
    return both.select(F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))).alias("rule"))


def set_cookie(header: str, url: str, now: float) -> dict | None:
    """The cookie that a Set-Cookie header makes for the page that sent it; None if it makes none."""
    host = urlsplit(url).hostname
    first, *rest = header.split(";")
    name, eq, value = (x.strip() for x in first.partition("="))
    if not host or not eq or not name:
        return None
    given = {k.strip().lower(): v.strip() for k, _, v in (p.partition("=") for p in rest) if k.strip()}
    path = urlsplit(url).path
    out = {"name": name, "value": value, "domain": host, "path": path.rpartition("/")[0] or "/", "expires": None, "secure": "secure" in given, "http_only": "httponly" in given}
    out["same_site"] = {"strict": "Strict", "none": "None"}.get(given.get("samesite", "").lower(), "Lax")
    if given.get("domain"):
        out["domain"] = "." + given["domain"].lstrip(".")
    if given.get("path"):
        out["path"] = given["path"]
    if "expires" in given:
        try:
            out["expires"] = parsedate_to_datetime(given["expires"].replace("-", " ")).timestamp()
        except (ValueError, TypeError):
            pass
    if given.get("max-age", "").lstrip("-").isdigit():
        out["expires"] = now + int(given["max-age"])
    return out
