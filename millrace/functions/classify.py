"""Which columns are sensitive, and which generator suits a column, by name and type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from millrace.plans.schema import Column

#: A column whose lower-cased name holds one of these is sensitive.
SENSITIVE_PATTERNS = (
    "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key",
    "private_key", "ssn", "social_security", "tax_id", "national_id", "credit_card", "card_number", "cvv",
    "cvc", "bank_account", "iban", "routing_number", "pin", "otp", "mfa", "totp",
)
#: Fixed values, first match wins: (generator, names that decide it, how they must match).
#: A name matches as part of the column name ("part"), as the whole of it ("whole"), or as one
#: or more of its words between underscores ("word"), where a part would hit other words.
NAME_RULES: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("email", ("email",), "part"),
    ("first_name", ("first_name", "firstname"), "part"),
    ("last_name", ("last_name", "lastname"), "part"),
    ("full_name", ("name",), "whole"),
    ("full_name", ("full_name",), "part"),
    ("username", ("username", "user_name"), "part"),
    ("phone", ("phone", "mobile"), "part"),
    ("phone", ("tel",), "word"),
    ("avatar_url", ("avatar",), "part"),
    ("url", ("url", "link", "website"), "part"),
    ("password", ("password", "passwd"), "part"),
    ("slug", ("slug",), "part"),
    ("sentence", ("title", "subject"), "part"),
    ("paragraph", ("description", "bio", "about", "body", "content"), "part"),
    ("company", ("company", "organization"), "part"),
    ("uuid", ("uuid",), "part"),
    ("token", ("token", "secret", "api_key"), "part"),
    # Ahead of the rule for codes, so that a short country or currency code is no SKU.
    ("country_code", ("country_code",), "part"),
    ("currency_code", ("currency",), "part"),
    ("sku", ("sku",), "part"),
    ("sku", ("code",), "short"),
    ("money", ("price", "amount", "cost", "total", "fee"), "part"),
    ("latitude", ("latitude",), "part"),
    ("latitude", ("lat",), "word"),
    ("longitude", ("longitude",), "part"),
    ("longitude", ("lng", "lon"), "word"),
    ("city", ("city",), "part"),
    ("country", ("country",), "part"),
    ("postal_code", ("zip", "postal"), "part"),
    ("ipv4", ("ip_address",), "part"),
    ("street_address", ("address",), "part"),
    ("hex_color", ("color", "colour"), "part"),
    ("ipv4", ("ip",), "word"),
)
SHORT = 50


def is_sensitive(name: str, patterns: Sequence[str] = SENSITIVE_PATTERNS) -> bool:
    return any(p in name.lower() for p in patterns)


def sensitive_column(name: SparkColumn, patterns: Sequence[str] = SENSITIVE_PATTERNS) -> SparkColumn:
    """As ``is_sensitive``, for a column of names."""
    return F.lower(name).rlike("|".join(patterns))


def qualified(table: str, column: str, listed: Sequence[str]) -> bool:
    return f"{table}.{column}" in listed


def _matches(name: str, part: str, how: str, max_length: int | None) -> bool:
    if how == "whole":
        return name == part
    if how == "word":
        return part in name.split("_")
    return part in name and (how == "part" or (max_length is not None and max_length <= SHORT))


def by_name(name: str, max_length: int | None = None) -> str | None:
    name = name.lower()
    return next((g for g, parts, how in NAME_RULES if any(_matches(name, p, how, max_length) for p in parts)), None)


def classified(name: SparkColumn, max_length: SparkColumn) -> SparkColumn:
    """As ``by_name``, for columns of names and lengths; null where no rule matches."""
    low, out = F.lower(name), None
    for generator, parts, how in NAME_RULES:
        hit = F.lit(False)
        for p in parts:
            one = {"whole": low == p, "word": F.array_contains(F.split(low, "_"), p), "part": low.contains(p), "short": low.contains(p) & F.coalesce(max_length <= SHORT, F.lit(False))}[how]
            hit = hit | one
        out = F.when(hit, generator) if out is None else out.when(hit, generator)
    return out


def by_type(column: Column) -> tuple[str, dict]:
    """Generator and its options for a type."""
    kind = column.type.typeName()
    if column.labels:
        return "enum_pick", {"labels": column.labels}
    if kind == "decimal" and column.type.scale == 2:
        return "money", {}
    table = {
        "boolean": "bool", "short": "random_int", "integer": "random_int", "long": "random_int", "byte": "random_int",
        "float": "random_float", "double": "random_float", "decimal": "random_float", "date": "datetime_past", "timestamp": "datetime_past",
        "timestamp_ntz": "datetime_past", "variant": "json_empty",
    }
    if kind in ("string", "varchar", "char"):
        return ("random_string", {"max_length": column.max_length}) if column.max_length else ("paragraph", {})
    return table.get(kind, "null"), {}


def detect(column: Column) -> tuple[str, dict] | None:
    """Generator of a column; None for generated and identity columns, which are skipped."""
    if column.generated or column.identity:
        return None
    if column.labels:
        return by_type(column)
    named = by_name(column.name, column.max_length)
    return (named, {}) if named else by_type(column)
