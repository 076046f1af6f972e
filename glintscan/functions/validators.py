"""Offline checks of provider formats, as column expressions by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glintscan.functions.text import base62_crc32, classes, entropy


def _json(part: Column) -> Column:
    """A base64url segment as text, or null."""
    standard = F.translate(F.regexp_replace(part, "=+$", ""), "-_", "+/")
    padded = F.concat(standard, F.repeat(F.lit("="), F.pmod(-F.length(standard), F.lit(4))))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def _jwt(v: Column) -> Column:
    parts = F.split(v, r"\.")
    head, body = _json(F.get(parts, F.lit(0))), _json(F.get(parts, F.lit(1)))
    keys = F.json_object_keys(head)
    return (F.size(parts) == 3) & F.coalesce(F.array_contains(keys, "alg"), F.lit(False)) & F.json_object_keys(body).isNotNull()


def _slack(v: Column) -> Column:
    parts = F.split(v, "-")
    n = F.size(parts)
    inner = F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0)))
    return (n >= 3) & F.forall(inner, lambda p: p.rlike(r"\A[0-9]+\z")) & (F.octet_length(F.element_at(parts, -1)) >= 16)


#: Validators of the user's own.
USER: dict[str, Callable[[Column], Column]] = {}
VALIDATORS = {
    "AWSAccessKeyID": lambda v: v.rlike(r"\A(AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|A3T[A-Z])[A-Z2-7]{16}\z"),
    "AWSSecretKey": lambda v: (F.octet_length(v) == 40) & (entropy(v) >= 4.0) & (classes(v) >= 3),
    "StripeKey": lambda v: v.rlike(r"\A[srp]k_(live|test)_[0-9A-Za-z]{20,}\z"),
    "GitHubToken": lambda v: v.rlike(r"\Agh[pousr]_") & (F.lower(base62_crc32(F.left(v, F.length(v) - 6))) == F.lower(F.right(v, F.lit(6)))),
    "SlackToken": _slack,
    "TwilioSK": lambda v: v.rlike(r"\ASK[0-9a-fA-F]{32}\z") & (entropy(F.substr(v, F.lit(3))) >= 3.5),
    "JWT": _jwt,
}


# What a passed check says.
APPROVALS = {
    "AWSAccessKeyID": "AWS prefix + base32 body OK", "AWSSecretKey": "40-char base64 body, high entropy", "GitHubToken": "GitHub CRC32 checksum verified",
    "SlackToken": "Slack hyphen-segment structure OK", "TwilioSK": "32-hex Twilio SK body", "JWT": "JWT structurally valid (alg present, JSON header+payload)",
}


def valid(validator: Column, value: Column, checks: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """True where there is no validator; the check is only computed for rows that name it.

    ``checks`` adds validators of the user's own, by name; an unknown name is never valid.
    """
    found = F.when(validator == "", True)
    for name, check in {**VALIDATORS, **USER, **(checks or {})}.items():
        found = found.when(validator == name, F.coalesce(check(value), F.lit(False)))
    return found.otherwise(F.lit(False))


def approval(validator: Column, value: Column) -> Column:
    """What a validator says of a value that it has passed; null without one."""
    found = F.when(validator == "StripeKey", F.concat(F.lit("Stripe "), F.regexp_extract(value, r"\A[srp]k_(?:live|test)_", 0), F.lit(" key, base62 body")))
    for name, text in APPROVALS.items():
        found = found.when(validator == name, text)
    return found.when((validator != "") & validator.isin(*USER), F.concat(validator, F.lit(" passed"))) if USER else found


def register(name: str, check: Callable[[Column], Column]) -> None:
    """Adds a validator of the user's own: a function from the value's column to a boolean column."""
    if name in VALIDATORS or not name:
        raise ValueError(f"validator {name!r} exists")
    USER[name] = check
