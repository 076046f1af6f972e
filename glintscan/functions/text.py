"""Scalar functions of matched values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of the checksum alphabet; severities that each report level takes.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def entropy(v: Column) -> Column:
    """Shannon entropy of the characters, in bits; frequencies are taken over the number of bytes."""
    n = F.octet_length(v).cast("double")
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    share = lambda c: (F.length(v) - F.length(F.replace(v, c, F.lit("")))) / n
    shares = F.transform(F.array_distinct(chars), share)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(F.lit(0.0))


def classes(v: Column) -> Column:
    """How many of lower case, upper case, digits and ``_-.+/=`` occur."""
    return sum((v.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", r"[_\-.+/=]")), F.lit(0))


def redact(v: Column) -> Column:
    """Stars but for two bytes at either end from 9 bytes on, four from 17 on."""
    n, raw = F.octet_length(v), F.encode(v, "UTF-8")
    part = lambda at, size: F.substring(raw, at, size).cast("string")
    ends = lambda k: F.concat(part(1, k), F.repeat(F.lit("*"), n - 2 * k), part(-k, k))
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).when(n <= 16, ends(2)).otherwise(ends(4))


def value_hash(v: Column) -> Column:
    return F.substring(F.sha2(v, 256), 1, 16)


def base62_crc32(v: Column) -> Column:
    """CRC-32 as six digits in base 62."""
    c = F.crc32(v.cast("binary"))
    digit = lambda k: F.substr(F.lit(BASE62), (F.floor(c / F.lit(62**k)) % 62 + 1).cast("int"), F.lit(1))
    return F.concat(*(digit(k) for k in range(5, -1, -1)))


def host(url: Column) -> Column:
    """Host of an http(s) address without its port, in lower case; null for anything else."""
    found = F.regexp_extract(url, r"(?i)\Ahttps?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def base_domain(h: Column) -> Column:
    """The last two labels of a host; IPv4 addresses and single labels as they are."""
    labels = F.split(h, r"\.")
    return F.when(h.rlike(r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}\z") | (F.size(labels) < 2), h).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def report_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").when(severity == "low", "note").otherwise("none")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 5).when(severity == "high", 4).when(severity == "medium", 3).when(severity == "low", 2).when(severity == "info", 1).otherwise(0)


def public_target(url: Column, allow_internal: bool = False) -> Column:
    """Whether an address may be fetched: http(s) with a host that is neither local nor a private IPv4 literal."""
    h = host(url)
    inside = h.rlike(r"\A(localhost|.*\.localhost|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|\[::1?\]|\[f[cd].*|\[fe80.*)\z")
    return h.isNotNull() & (F.lit(allow_internal) | ~inside)


def retry_after(value: Column, now: Column) -> Column:
    """Seconds that a server asks to wait, given as a number or as a date; 0 for anything else and for the past."""
    date = F.try_to_timestamp(F.regexp_extract(value, r"(?i)\A[a-z]{3}, (\d{2} [a-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT\z", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    left = F.unix_timestamp(date) - F.unix_timestamp(now)
    return F.greatest(F.lit(0), F.coalesce(F.when(value.rlike(r"\A\+?[0-9]{1,9}\z"), value.cast("long")), left, F.lit(0)).cast("long"))


def backoff(attempt: Column, chance: Column) -> Column:
    """Seconds before a retry: two to the power of the attempt (0 to 6), a quarter less or more as ``chance`` in [0, 1) says."""
    base = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(attempt, F.lit(6))))
    return base * (0.75 + chance / 2)


def mask_errors(v: Column) -> Column:
    return F.regexp_replace(v, r"(token=|Bearer )[^\s&]+", "$1***")
