"""Digest and fingerprint expressions (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    """A JSON number as canonical text: integers as written, others by the fewest digits
    (15, 16 or 17, without trailing zeros) that give their double, with a point up to 16
    digits before and 4 zeros after it, else with an exponent of two digits or more."""
    d = text.cast("double")
    tries = [F.format_string(f"%.{n}e", d) for n in (14, 15, 16)]
    s = F.coalesce(*[F.when(t.cast("double") == d, t) for t in tries], d.cast("string"))
    power = F.regexp_extract(s, "e([+-][0-9]+)$", 1).try_cast("int")
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    exponent = F.concat(F.regexp_replace(s, r"\.?0*e.*$", ""), F.regexp_extract(s, "(e[+-][0-9]+)$", 1))
    point = F.when(d == 0, F.when(text.startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0"))).when(power.isNull(), s).when(power.between(-4, 15), plain).otherwise(exponent)
    return F.when(text == "-0", F.lit("0")).when(text.rlike("^-?[0-9]+$"), text).otherwise(point)


def _ascii(json: Column) -> Column:
    """Compact JSON with all but printable ASCII as lower-case escapes of four digits."""
    parts = F.regexp_extract_all(json, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\.|[^\x20-\x7E]+|[\x20-\x5B\x5D-\x7E]+)"), F.lit(1))

    def escaped(part: Column) -> Column:
        units = F.lower(F.hex(F.encode(part, "UTF-16BE")))
        return (F.when(part.rlike(r"^\\u"), F.lower(part))
                .when(part.rlike(r"^[^\x20-\x7E]"), F.regexp_replace(units, "(.{4})", r"\\u$1")).otherwise(part))

    return F.array_join(F.transform(parts, escaped), "")


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys, no spaces, canonical numbers and ASCII only; null for
    null and for text that is no JSON (an object that repeats a key among them).

    Variant objects keep their keys sorted, but Variant prints 95.0 as 95.  So numbers
    travel through it as texts that start with ``n``, while texts and keys get an ``s``.
    """
    token = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*|[^"0-9-]+|["-])'
    tokens = F.regexp_extract_all(text, F.lit(token), F.lit(1))
    valid = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
    marked = F.transform(tokens, lambda t: F.when(t.startswith('"'), F.concat(F.lit('"s'), F.substring(t, 2, 1 << 30)))
                         .when(t.rlike(valid), F.concat(F.lit('"n'), _number(t), F.lit('"'))).otherwise(t))
    printed = F.to_json(F.try_parse_json(F.array_join(marked, "")))
    # an opening quote follows one of [ { : , or nothing, and none of these comes right before
    # a quote and an n or s inside a text, where quotes are escaped
    numbers = F.regexp_replace(printed, r'(^|[\[:,])"n([^"]*)"', "$1$2")
    return _ascii(F.regexp_replace(numbers, r'(^|[\[{:,])"s', '$1"'))


def params_fingerprint(params_json: Column) -> Column:
    """SHA-256 of the parameter object as sorted, compact JSON (null: no JSON)."""
    return F.sha2(canonical_json(params_json), 256)


def cache_key(payload_json: Column, version: Column) -> Column:
    """SHA-256 of ``{"p":payload,"v":version}`` with the payload's keys sorted; a payload's
    ``95``, ``95.0`` and ``"95"`` are three keys (null: the payload is no JSON)."""
    v = _ascii(F.to_json(F.struct(F.coalesce(version, F.lit("")).alias("v"))))
    return F.sha2(F.concat(F.lit('{"p":'), canonical_json(payload_json), F.lit(","), F.substring(v, 2, 1 << 30)), 256)


def git_blob_digest(content: Column) -> Column:
    """SHA-256 over git blob framing: ``b"blob <len>\\0" + content``."""
    header = F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha2(F.concat(header, F.unhex(F.lit("00")), content), 256)


def content_path(digest: Column) -> Column:
    """Object path of a digest: ``aa/bb/rest``."""
    return F.concat_ws("/", digest.substr(1, 2), digest.substr(3, 2), digest.substr(5, 1 << 20))


def schema_fingerprint(feature_order: Column, model_version: Column) -> Column:
    """SHA-256 of ``{"feature_order":[...],"model_version":"..."}`` (keys sorted)."""
    return F.sha2(F.to_json(F.struct(feature_order.alias("feature_order"), model_version.alias("model_version"))), 256)


def lineage_token(parent: Column, version: Column, ring: Column) -> Column:
    """SHA-256 of ``parent-or-ROOT|version|ring``."""
    return F.sha2(F.concat_ws("|", F.coalesce(parent, F.lit("ROOT")), version, ring), 256)


def md5_bucket(key: Column, buckets: int = 100) -> Column:
    """Deterministic bucket 0..buckets-1 from the first 8 hex digits of md5.

    Same number in every engine (DuckDB: ``('0x' || left(md5(k), 8))::bigint``),
    and independent of partitioning, unlike ``rand`` or ``randomSplit``.
    """
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets
