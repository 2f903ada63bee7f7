"""Scalar functions over columns: text, error families, identifiers, digests, durations, retry delays."""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import let
from .vocab import BUILT_IN_CODES, ERROR_FAMILIES


def normalize_text(c: Column) -> Column:
    """Without white space at both ends; empty is null."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def error_category(c: Column) -> Column:
    code = normalize_text(c)
    out = F.when(code.isNull(), F.lit(None).cast("string"))
    for family, codes in ERROR_FAMILIES.items():
        out = out.when(code.isin(codes), family)
    return out.otherwise("DOMAIN")


def in_categories(c: Column, families: list[str]) -> Column:
    """OR of the families; DOMAIN is any non-empty code that isn't built in."""
    out = F.lit(False)
    for f in families:
        out = out | ((c.isNotNull() & (c != "") & ~c.isin(BUILT_IN_CODES)) if f == "DOMAIN" else c.isin(ERROR_FAMILIES[f]))
    return out


def identifier_ok(c: Column, most_bytes: int = 63) -> Column:
    return c.rlike("^[a-z_][a-z0-9_]*$") & (F.octet_length(c) <= most_bytes)


def partition_name(parent: Column, at: Column, hourly: bool = False) -> Column:
    return F.concat_ws("_", parent, F.date_format(at, "yyyy_MM_dd_HH" if hourly else "yyyy_MM_dd"))


def elapsed_s(start: Column, end: Column) -> Column:
    """Whole seconds, toward zero."""
    return F.timestamp_diff("SECOND", start, end)


def span_s(start: Column, end: Column, live: Column, as_of: Column) -> Column:
    """Null unless it has ended or is live."""
    return F.when(end.isNotNull(), elapsed_s(start, end)).when(live, elapsed_s(start, as_of))


def queue_s(as_of: Column) -> Column:
    """Of a live task: from enqueue to start, or to the end; to now while it waits."""
    return span_s(F.col("enqueued_at"), F.coalesce("started_at", "completed_at", "failed_at"), F.col("status").isin("PENDING", "CLAIMED"), as_of)


def exec_s(as_of: Column) -> Column:
    return span_s(F.col("started_at"), F.coalesce("completed_at", "failed_at"), F.col("status") == "RUNNING", as_of)


def node_exec_s(as_of: Column) -> Column:
    done = F.col("status").isin("COMPLETED", "FAILED", "SKIPPED", "CANCELLED") & F.col("completed_at").isNotNull()
    return F.when(F.col("status") == "RUNNING", elapsed_s(F.col("started_at"), as_of)).when(done, elapsed_s(F.col("started_at"), F.col("completed_at")))


def framed_digest(domain: str, *parts: Column) -> Column:
    """SHA-256 of the domain and the parts, each after its length as four bytes, big-endian. Hex."""
    framed = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 8, "0")), p.cast("binary")) for p in (F.lit(domain), *parts)]
    return F.sha2(F.concat(*framed), 256)


def fingerprint(*parts) -> str:
    """SHA-256 of a JSON array in canonical form, for a command. Hex."""
    return hashlib.sha256(json.dumps(list(parts), separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def strict_json(value) -> str:
    """JSON; NaN and infinities at any depth raise ValueError."""
    return json.dumps(value, allow_nan=False)


def slot_id(namespace: uuid.UUID, schedule: str, slot: str) -> str:
    """The same id for the same slot of a schedule (UUID version 5)."""
    return str(uuid.uuid5(namespace, f"{schedule}:{slot}"))


def uuid7_birth(c: Column) -> Column:
    """The time in the first 48 bits of a version-7 UUID; null for other versions."""
    plain = F.replace(c, F.lit("-"), F.lit(""))
    return F.when(F.substring(plain, 13, 1) == "7", F.timestamp_millis(F.conv(F.substring(plain, 1, 12), 16, 10).cast("long")))


def retry_eligible(retry_count: Column, max_retries: Column, options: Column, code: Column, good_until: Column, as_of: Column) -> Column:
    """Retries left, in time, and the code is in auto_retry_for (at the top, or else under retry_policy)."""
    codes = F.coalesce(F.get_json_object(options, "$.auto_retry_for"), F.get_json_object(options, "$.retry_policy.auto_retry_for"))
    listed = F.coalesce(F.array_contains(F.from_json(codes, "array<string>"), code), F.lit(False))
    return (max_retries > 0) & (retry_count < max_retries) & (good_until.isNull() | (as_of < good_until)) & listed


def max_retries(options: Column) -> Column:
    """3 by default if there is a retry policy, else 0."""
    policy = F.get_json_object(options, "$.retry_policy")
    return F.when(policy.isNull(), 0).otherwise(F.coalesce(F.get_json_object(options, "$.retry_policy.max_retries").cast("int"), F.lit(3)))


def exception_type(error: Column) -> Column:
    return F.coalesce(F.get_json_object(error, "$.exception.type"), F.get_json_object(error, "$.exception.exception_type"), F.get_json_object(error, "$.exception"))


def retry_delay(attempt: Column, intervals: Column, exponential: Column, cap: Column, jitter: Column | None = None) -> Column:
    """Seconds: the attempt's interval (the last for later ones), or the first times a power of two; at least 1, then
    up to a quarter more by jitter (0..1), then the cap."""
    first = F.coalesce(F.try_element_at(intervals, F.lit(1)), F.lit(60)).cast("double")
    fixed = F.coalesce(F.try_element_at(intervals, F.greatest(F.lit(1), F.least(attempt, F.size(intervals)))), F.lit(60)).cast("double")
    base = F.greatest(F.when(exponential, first * F.pow(F.lit(2.0), attempt - 1)).otherwise(fixed), F.lit(1.0))
    spread = base if jitter is None else base + base * 0.25 * jitter
    return F.when(cap > 0, F.least(spread, cap.cast("double"))).otherwise(spread)


def reconnect_delay_ms(attempt: Column, initial_ms: int, most_ms: int, jitter: Column | None = None) -> Column:
    base = F.least(F.lit(float(most_ms)), F.lit(float(initial_ms)) * F.pow(F.lit(2.0), attempt - 1))
    return F.greatest(base if jitter is None else base * (0.75 + 0.5 * jitter), F.lit(100.0))


def dependency_error(status: Column, result: Column) -> Column:
    """The code of the error that stands for a dependency's result; null where the stored result itself is used. A node
    that isn't there has a null status."""
    ended = F.coalesce(status.isin("COMPLETED", "FAILED"), F.lit(False))
    return F.when(result.isNotNull(), F.when(F.try_parse_json(result).isNull(), "RESULT_DESERIALIZATION_ERROR")).when(ended, "RESULT_NOT_AVAILABLE").otherwise("UPSTREAM_SKIPPED")


def merge_results(kwargs: Column, name: str, status: Column, result: Column) -> Column:
    """kwargs, a JSON object, with a dependency's result under `name`, keys in order. What is stored passes as the JSON
    value it is, whatever the state; what is missing, skipped or unreadable becomes an error object."""
    # what begins with a letter that begins no JSON needn't be parsed to fail; what has no value is read no second time
    value = F.when(~F.coalesce(result.rlike("^[A-HJ-MO-Za-eg-mo-su-z]"), F.lit(False)), F.try_parse_json(result))
    code = F.when(result.isNotNull(), "RESULT_DESERIALIZATION_ERROR").otherwise(dependency_error(status, F.lit(None).cast("string")))
    error = F.to_json(F.struct(F.struct(code.alias("error_code")).alias("err")))
    base = F.coalesce(F.parse_json(kwargs).cast("map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    merged = F.map_concat(F.map_filter(base, lambda k, _: k != name), F.create_map(F.lit(name), F.coalesce(value, F.parse_json(error))))
    ordered = lambda m: let(F.sort_array(F.map_keys(m)), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(m, k))))
    every = F.to_json(let(merged, ordered), {"ignoreNullFields": "false"})
    if not re.fullmatch("[A-Za-z0-9_]+", name):
        return every
    # Plain ASCII kwargs without the name become a canonical text with a place for the value, computed once if they are constant.
    key, place = f'"{name}":', f'"{name}":0'
    plain = kwargs.rlike(r'^ *\{ *"[ -\[\]-~]*$') & ~F.contains(kwargs, F.lit(f'"{name}"'))
    frame = F.to_json(F.parse_json(F.concat(F.lit("{" + place + ","), F.regexp_replace(kwargs, r"^ *\{", ""))))
    text = F.concat(F.substring_index(frame, place, 1), F.lit(key), F.coalesce(F.to_json(value), error), F.substring_index(frame, place, -1))
    return F.when(plain, text).otherwise(every)


def duration_text(micros: Column) -> Column:
    """A positive duration as Python prints it, like timedelta_text(); null for others."""
    seconds = F.floor(micros / 1_000_000)
    days, rest = F.floor(seconds / 86_400), seconds % 86_400
    clock = F.concat(F.floor(rest / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(rest / 60 % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((rest % 60).cast("string"), 2, "0"))
    fraction = F.when(micros % 1_000_000 != 0, F.concat(F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0"))).otherwise("")
    day = F.when(days == 0, "").when(days == 1, "1 day, ").otherwise(F.concat(days.cast("string"), F.lit(" days, ")))
    return F.when(micros > 0, F.concat(day, clock, fraction))


def timedelta_text(d: timedelta) -> str:
    """As Python prints it; it must be positive."""
    if d <= timedelta(0):
        raise ValueError("duration must be positive")
    return str(d)


def capacity(*, hard_cap: bool, processes: int, prefetch: int, max_per_worker: int, cluster_cap: int | None, claimed: Column, running: Column, mine: Column, everyone: Column) -> Column:
    """How many tasks a worker may claim now."""
    most = max_per_worker if max_per_worker > 0 else processes + max(prefetch, 0)
    local = F.lit(processes) - mine if hard_cap else F.lit(processes + prefetch) - running - claimed
    room = F.greatest(F.lit(0), F.lit(cluster_cap) - everyone) if cluster_cap is not None else F.lit(math.inf)
    return F.greatest(F.lit(0), F.least(F.greatest(local, F.lit(0)), F.lit(most) - claimed, room)).cast("long")
