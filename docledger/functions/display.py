"""What a viewer sees: sizes, dates, statuses, audit columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V


def one_decimal(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.1f", c))


def human_size(c: Column) -> Column:
    """Bytes as B, KB or MB; NULL is ``Unknown`` (FMT1)."""
    kb, mb = F.lit(1024.0), F.lit(1024.0 * 1024.0)
    return (
        F.when(c.isNull(), "Unknown")
        .when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024 * 1024, F.concat(one_decimal(c / kb), F.lit(" KB")))
        .otherwise(F.concat(one_decimal(c / mb), F.lit(" MB")))
    )


def parse_local_time(c: Column) -> Column:
    """Zoneless timestamp from server text; NULL when malformed."""
    return F.try_to_timestamp(F.replace(F.replace(c, F.lit(" "), F.lit("T")), F.lit("Z"), F.lit(""))).cast(
        "timestamp_ntz"
    )


def display_date(c: Column, fmt: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    """Formatted date, ``Never`` when missing or malformed (FMT2)."""
    return F.coalesce(F.date_format(parse_local_time(c), fmt), F.lit("Never"))


def scan_info(status: Column, message: Column, scanned_at: Column) -> Column:
    """``title, status, description, date`` for a scan status (FMT3)."""
    message = F.nullif(message, F.lit(""))

    def part(pick, default: str) -> Column:
        chain = None
        for name, row in V.SCAN_TEXTS.items():
            chain = F.when(status == name, pick(row)) if chain is None else chain.when(status == name, pick(row))
        return chain.otherwise(F.lit(default))

    title, label, text = V.SCAN_TEXT_DEFAULT
    return F.struct(
        part(lambda r: F.lit(r[0]), title).alias("title"),
        part(lambda r: F.lit(r[1]), label).alias("status"),
        part(lambda r: F.coalesce(message, F.lit(r[2])) if r[3] else F.lit(r[2]), text).alias("description"),
        part(
            lambda r: F.when(scanned_at.isNotNull(), display_date(scanned_at.cast("string"))).otherwise("-")
            if r[4]
            else F.lit("-"),
            "-",
        ).alias("date"),
    )


def audit_display(user_id: Column, role: Column, action: Column, ip: Column) -> Column:
    """Shortened user id, role without prefix, defaults and readable loopback (FMT4)."""

    def or_na(c: Column, shown: Column) -> Column:
        return F.when(c.isNull() | (c == ""), "N/A").otherwise(shown)

    short = F.when(F.length(user_id) <= 10, user_id).otherwise(
        F.concat(F.substring(user_id, F.lit(1), F.lit(10)), F.lit("..."))
    )
    return F.struct(
        or_na(user_id, short).alias("user_id"),
        or_na(role, F.regexp_replace(role, "^(.*?)ROLE_", "$1")).alias("role"),
        or_na(action, action).alias("action"),
        F.when(ip == "0:0:0:0:0:0:0:1", "127.0.0.1").otherwise(ip).alias("ip"),
    )


def percent_display(c: Column) -> Column:
    """``0.2534`` -> ``25.3%``, NULL -> ``N/A`` (FMT5)."""
    return F.coalesce(F.concat(one_decimal(c * 100), F.lit("%")), F.lit("N/A"))


def ratio_display(c: Column) -> Column:
    """Two decimals, NULL -> ``N/A`` (FMT5)."""
    return F.when(c.isNull(), "N/A").otherwise(F.format_string("%.2f", c))


def client_ip(forwarded: Column, remote: Column) -> Column:
    """First forwarded address, else the remote one (FMT6)."""
    first = F.trim(F.get(F.split(forwarded, ",", -1), F.lit(0)))
    return F.when(F.trim(forwarded) != "", first).otherwise(remote)


def http_status(exception: Column, own_status: Column) -> Column:
    """Status of a failed request: the exception's own, a fixed one, else 500 (FMT7)."""
    chain = F.when(exception == "AppException", own_status)
    for name, code in V.EXCEPTION_STATUS.items():
        chain = chain.when(exception == name, F.lit(code))
    return chain.otherwise(F.lit(500))


def elapsed_seconds(since: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", since, now)


def progress(uploaded: Column, now: Column) -> Column:
    """Percent shown while a document is processed, at most 95 (FMT8)."""
    return F.least(F.lit(95.0), elapsed_seconds(uploaded, now) / F.lit(float(V.EXPECTED_SECONDS)) * 100)


def identity_defaults(
    user_id: Column, name: Column, email: Column, role: Column, method: Column, path: Column
) -> Column:
    """Who and what of an audit entry when the caller is unknown (FMT9)."""
    known = email.isNotNull() & (email != "anonymousUser")

    def who(c: Column, default: str) -> Column:
        return F.when(known, F.coalesce(c, F.lit(default))).otherwise(default)

    return F.struct(
        who(user_id, "anonymous").alias("user_id"),
        who(name, "anonymous").alias("name"),
        who(email, "anonymous").alias("email"),
        who(role, "NONE").alias("role"),
        F.coalesce(method, F.lit("N/A")).alias("method"),
        F.coalesce(path, F.lit("N/A")).alias("path"),
    )


def display_list(c: Column) -> Column:
    """Array value as text (FMT10)."""
    return F.array_join(c, ", ")


def field_label(c: Column) -> Column:
    """Field key as a label (FMT10)."""
    return F.replace(c, F.lit("_"), F.lit(" "))
