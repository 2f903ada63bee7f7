"""Archived attempts: positional JSON rows in order of attempt, with a digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of a row, in order, and their types.
FIELDS = {
    "attempt": "int", "outcome": "string", "will_retry": "boolean", "started_at": "long", "finished_at": "long", "error_code": "string",
    "error_message": "string", "failed_reason": "string", "worker_id": "string", "worker_hostname": "string", "worker_pid": "int", "worker_process_name": "string",
}
TIMES = {"started_at", "finished_at"}


def encode(attempts: Column) -> Column:
    """array<struct> with FIELDS to JSON text; times as microseconds since 1970. No attempts are an empty list."""
    def cell(x: Column, f: str) -> Column:
        # as a list of one, whose brackets are cut off
        listed = F.to_json(F.array(F.unix_micros(x[f].cast("timestamp")) if f in TIMES else x[f]))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    row = lambda x: F.concat(F.lit("["), F.concat_ws(",", *(cell(x, f) for f in FIELDS)), F.lit("]"))
    ordered = F.array_sort(F.transform(attempts, lambda x: F.struct(x["attempt"].alias("attempt"), row(x).alias("row"))))
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(ordered, F.array()), lambda x: x["row"]), ","), F.lit("]"))


def _rows(text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")


def fault(text: Column, digest: Column) -> Column:
    """Null if the text is a whole snapshot that fits its digest (null digests aren't looked at), or what is wrong."""
    rows = _rows(text)
    cells = F.transform(rows, lambda r: F.try_variant_get(r, "$", "array<variant>"))
    whole = F.forall(cells, lambda c: F.coalesce(F.size(c) == len(FIELDS), F.lit(False)))
    numbers = F.transform(rows, lambda r: F.try_variant_get(r, "$[0]", "int"))
    counted = F.when(F.size(rows) == 0, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1))))
    return (F.when(text.isNull(), "MISSING").when(F.sha2(text.cast("binary"), 256) != digest, "DIGEST_MISMATCH")
            .when(F.try_parse_json(text).isNull(), "NOT_JSON").when(rows.isNull() | ~whole, "FIELD_COUNT")
            .when(~numbers.eqNullSafe(counted), "NOT_CONTIGUOUS"))


def decode(text: Column) -> Column:
    """array<struct> with FIELDS, times as microseconds; for texts without a fault()."""
    def field(r: Column, i: int, f: str) -> Column:
        return F.try_variant_get(r, f"$[{i}]", FIELDS[f]).alias(f)

    return F.transform(_rows(text), lambda r: F.struct(*(field(r, i, f) for i, f in enumerate(FIELDS))))
