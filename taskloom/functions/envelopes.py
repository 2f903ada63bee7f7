"""Result envelopes: a payload as bytes with version, codec, content type and digest, written, checked and read in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What version 1 holds.
VERSION, CODEC, CONTENT_TYPE = 1, "json-utf8", "application/json"


def encode(result: Column) -> Column:
    """struct(version, codec, content_type, payload, digest) of a JSON text; null for null and for what isn't JSON."""
    payload = result.cast("binary")
    made = F.struct(F.lit(VERSION).cast("smallint").alias("version"), F.lit(CODEC).alias("codec"), F.lit(CONTENT_TYPE).alias("content_type"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    return F.when(F.try_parse_json(result).isNotNull(), made)


def fault(e: Column) -> Column:
    """UNKNOWN_VERSION, UNKNOWN_CODEC, UNKNOWN_CONTENT_TYPE, DIGEST_MISMATCH or CORRUPT, the first that holds; null for a
    whole envelope and for none. CORRUPT: the payload isn't UTF-8, or isn't JSON."""
    text = F.try_validate_utf8(e["payload"].cast("string"))
    return (F.when(e.isNull(), F.lit(None).cast("string")).when(~e["version"].eqNullSafe(F.lit(VERSION)), "UNKNOWN_VERSION").when(~e["codec"].eqNullSafe(F.lit(CODEC)), "UNKNOWN_CODEC")
            .when(~e["content_type"].eqNullSafe(F.lit(CONTENT_TYPE)), "UNKNOWN_CONTENT_TYPE").when(~F.unhex(F.sha2(e["payload"], 256)).eqNullSafe(e["digest"]), "DIGEST_MISMATCH")
            .when(F.try_parse_json(text).isNull(), "CORRUPT"))


def decode(e: Column) -> Column:
    """The JSON text; null where the envelope has a fault."""
    return F.when(e.isNotNull() & fault(e).isNull(), e["payload"].cast("string"))


def of_ended(result: Column, cancelled: Column) -> Column:
    """struct(canonical, prior, digest) of a task that ended: what an administrator cancelled keeps its output as `prior`,
    all else as `canonical`; one digest covers whichever is there."""
    payload = result.cast("binary")
    return F.struct(F.when(~cancelled, payload).alias("canonical"), F.when(cancelled, payload).alias("prior"), F.unhex(F.sha2(payload, 256)).alias("digest"))


def selected(canonical: Column, prior: Column) -> Column:
    """struct(payload, source, fault): the canonical payload, or the one from before an administrator's cancellation. Both at once is a fault."""
    both = canonical.isNotNull() & prior.isNotNull()
    source = F.when(both, F.lit(None).cast("string")).when(canonical.isNotNull(), "CANONICAL").when(prior.isNotNull(), "ADMINISTRATIVE_PRIOR").otherwise("NONE")
    return F.struct(F.when(~both, F.coalesce(canonical, prior)).alias("payload"), source.alias("source"), F.when(both, "CANONICAL_AND_PRIOR").alias("fault"))
