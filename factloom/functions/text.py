"""Scalar functions on text, as Column expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def simple_name(c: Column | str) -> Column:
    """Simple type name: no generics or array marks, nothing before the last dot or dollar sign. NULL stays NULL."""
    plain = F.regexp_replace(_c(c), r"<.*>|\[\]", "")
    return F.trim(F.regexp_replace(plain, r"^.*[.$]", ""))


def receiver_root(c: Column | str) -> Column:
    """The part of a receiver before its first `.`, `[` or `(`, without a leading this. or super."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"^(this|super)\.", ""), r"[.\[(].*$", "")


def unix_path(c: Column | str) -> Column:
    """Separators as /, no leading ./ or /."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"\\", "/"), r"^(\./|/)+", "")


def project_of(path: Column | str) -> Column:
    """The project of a file: the first part of its path."""
    return F.substring_index(unix_path(path), "/", 1)


def join_paths(a: Column | str, b: Column | str) -> Column:
    """/a/b with repeated separators collapsed and none at the end (but / alone)."""
    joined = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(_c(a), F.lit("")), F.lit("/"), F.coalesce(_c(b), F.lit(""))), r"/+", "/")
    return F.when(joined == "/", joined).otherwise(F.regexp_replace(joined, r"/$", ""))


def java_hash(c: Column | str) -> Column:
    """Java's String.hashCode of a text (code units outside the basic plane excepted), as an unsigned 32-bit number."""
    chars = F.transform(F.filter(F.split(_c(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, x: (h * 31 + x).bitwiseAND(F.lit(0xFFFFFFFF)))


def entry_id(protocol: str, operations: str, route: str, class_name: str, method: str, path: str) -> Column:
    """First 24 hex digits of SHA-256 over the newline-joined parts of an entry point; operations are sorted and shown as [A, B]; a NULL part counts as blank."""
    ops = F.concat(F.lit("["), F.array_join(F.sort_array(operations), ", "), F.lit("]"))
    parts = [F.coalesce(x, F.lit("")) for x in (F.upper(protocol), ops, F.col(route), F.col(class_name), F.col(method), unix_path(path))]
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 24)


def cache_key(c: Column | str) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(_c(c), 256), 1, 16)


def confidence(c: Column | str) -> Column:
    """HIGH, MEDIUM, LOW as .90, .70, .50; else the number; else 0."""
    t = F.upper(F.trim(_c(c)))
    return F.when(t == "HIGH", 0.9).when(t == "MEDIUM", 0.7).when(t == "LOW", 0.5).otherwise(F.coalesce(t.try_cast("double"), F.lit(0.0)))


def half_up(c: Column, places: int) -> Column:
    """Rounds half up as floor(x * 10^places + 0.5) / 10^places."""
    return F.floor(c * 10**places + 0.5) / 10**places


def byte_size(c: Column | str) -> Column:
    """N B below 1,024, else x.y KB, ties to the even digit."""
    n = _c(c)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.1f", F.bround(n / 1024, 1)), F.lit(" KB")))


def preview(c: Column | str, limit: int) -> Column:
    """One line of at most `limit` characters and an ellipsis; line breaks show as ` | `."""
    flat = F.regexp_replace(_c(c), r"\r?\n", " | ")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def instant(c: Column | str) -> Column:
    """The timestamp of an ISO instant such as 2024-01-02T03:04:05.678Z; NULL for anything else."""
    t = _c(c)
    return F.when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,9})?Z$"), F.try_to_timestamp(t))


def instant_text(c: Column | str) -> Column:
    """A timestamp as ISO instant in UTC: no fraction if it is whole, else 3 or 6 digits of it. The session's time zone must be UTC."""
    t = _c(c).cast("timestamp")
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    tail = F.when(micros == 0, "").when(micros % 1000 == 0, F.format_string(".%03d", (micros / 1000).cast("long"))).otherwise(F.format_string(".%06d", micros))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), tail, F.lit("Z"))
