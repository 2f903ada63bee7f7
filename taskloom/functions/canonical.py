"""Canonical JSON, command fingerprints and name-based ids, in columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: version of a command's fingerprint.
FINGERPRINT_VERSION = 1
# The short escapes of JSON strings; other control characters become \u00xx.
SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def json_string(c: Column) -> Column:
    """A text as a JSON string in its shortest form, `null` for null."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controls = plain
    for code in range(32):
        controls = F.replace(controls, F.lit(chr(code)), F.lit(SHORT.get(code, f"\\u{code:04x}")))
    body = F.when(c.rlike("[\\x00-\\x1F]"), controls).otherwise(plain)
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def _cell(c: Column, kind: str) -> Column:
    if kind == "text":
        return json_string(c)
    shown = F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('+00:00"')) if kind == "time" else c.cast("string")
    return F.coalesce(shown, F.lit("null"))


#: The cells of a command after the version, in order, and their kinds. Fixed values.
COMMAND = {
    "task_name": "text", "queue_name": "text", "priority": "number", "args": "text", "kwargs": "text", "good_until": "time", "delay_s": "number",
    "options": "text", "class_key": "text", "retain_input": "number", "rerun_of": "text", "rerun_root": "text",
}


def command_json(**columns: Column) -> Column:
    """A command as a JSON array: the version, then the cells of COMMAND; missing ones are null."""
    cells = [_cell(columns.get(n, F.lit(None).cast("timestamp_ntz" if k == "time" else "string")), k) for n, k in COMMAND.items()]
    return F.concat(F.lit(f"[{FINGERPRINT_VERSION},"), F.concat_ws(",", *cells), F.lit("]"))


def command_fault(**columns: Column) -> Column:
    """What keeps a command from having a fingerprint, the first that holds; null if nothing does."""
    c = lambda n, kind="string": columns.get(n, F.lit(None).cast(kind))
    empty = lambda n: F.coalesce(c(n), F.lit("")) == ""
    return (F.when(empty("task_name"), "EMPTY_TASK_NAME").when(empty("queue_name"), "EMPTY_QUEUE_NAME").when(~F.coalesce(c("priority", "int").between(1, 100), F.lit(False)), "INVALID_PRIORITY")
            .when(c("delay_s", "long") < 0, "INVALID_DELAY").when(empty("class_key"), "EMPTY_CLASS").when(c("rerun_of").isNull() != c("rerun_root").isNull(), "INCOMPLETE_LINEAGE"))


def command_fingerprint(**columns: Column) -> Column:
    """SHA-256 of command_json(), as hex; null for a command with a fault."""
    return F.when(command_fault(**columns).isNull(), F.sha2(command_json(**columns).cast("binary"), 256))


def canonical_json(text: Column) -> Column:
    """A JSON text with keys in order at every depth, no white space, and numbers in one form: 1.50 and 1.5 are the same;
    those with an exponent are floating point and stay apart (1e2 is 100.0). Null for what isn't JSON; NaN and infinities aren't."""
    return F.to_json(F.try_parse_json(text), {"ignoreNullFields": "false"})


def strict_fault(text: Column) -> Column:
    """NON_FINITE for JSON but for a NaN or an infinity outside of its strings, NOT_JSON for other faults, else null."""
    bare = F.regexp_replace(text, r"\\.", "_")  # no quote is escaped any more
    tamed = F.regexp_replace(bare, r'-?\b(?:NaN|Infinity|inf|nan)\b(?=(?:[^"]*"[^"]*")*[^"]*$)', "0")
    return F.when(F.try_parse_json(text).isNotNull() | text.isNull(), F.lit(None).cast("string")).when(F.try_parse_json(tamed).isNotNull() & (tamed != bare), "NON_FINITE").otherwise("NOT_JSON")


def config_digest(text: Column) -> Column:
    """SHA-256 of the canonical JSON, as hex: what says the same has the same digest."""
    return F.sha2(canonical_json(text).cast("binary"), 256)


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The UUID version 5 of a name: SHA-1 over namespace and name, with the bits of version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def slot_uuid(namespace: uuid.UUID, schedule: Column, slot: Column) -> Column:
    """The same id for the same slot (UTC) of a schedule, whoever makes it."""
    return uuid5(namespace, F.concat(schedule, F.lit(":"), F.date_format(slot, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))
