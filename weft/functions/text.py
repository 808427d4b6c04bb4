"""Normalisation, keys and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalized(x: Column | str) -> Column:
    """Trimmed text; null becomes empty."""
    return F.coalesce(F.trim(_c(x).cast("string")), F.lit(""))


def non_blank(x: Column | str) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(F.trim(_c(x).cast("string")), F.lit(""))


def first_non_blank(*xs: Column | str) -> Column:
    return F.coalesce(*[non_blank(x) for x in xs])


def distinct_non_blank(xs: Column | str) -> Column:
    """An array's trimmed non-blank values, each where it first stands."""
    return F.filter(F.array_distinct(F.transform(_c(xs), normalized)), lambda x: x != "")


def stable_uid(prefix: str, *parts: Column | str) -> Column:
    """prefix_ and 12 hex digits of the SHA-1 of the parts; a missing part keeps its place."""
    joined = F.concat_ws("||", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(joined.cast("binary")), 1, 12))


def slug(x: Column | str, default: str = "unknown") -> Column:
    bare = F.trim(F.regexp_replace(F.lower(F.trim(_c(x))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(default))


def norm_key(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(_c(x), F.lit("")))), "[^a-z0-9]+", "")


def coerced(x: Column | str, names: list[str], default: str) -> Column:
    """The listed name that x is in another case of; x itself if none; the default if blank."""
    table = F.create_map(*[F.lit(v) for n in names for v in (n.lower(), n)])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(_c(x)))), non_blank(x), F.lit(default))


def file_of(location: Column | str) -> Column:
    """What stands before the first colon."""
    return F.split_part(normalized(location), F.lit(":"), F.lit(1))


def line_of(location: Column | str) -> Column:
    """The number behind the last colon, or null."""
    return F.nullif(F.regexp_extract(_c(location), "^.*:(-?[0-9]+)$", 1), F.lit("")).cast("int")


def resource_name(x: Column | str) -> Column:
    """`R.id.x` stays, `package:id/x` becomes it, anything else is null."""
    t = normalized(x)
    tail = F.regexp_extract(t, ":id/([A-Za-z0-9_]+)$", 1)
    return F.when(t.startswith("R.id."), t).when(tail != "", F.concat(F.lit("R.id."), tail))


def suffixed(base: Column, *order: Column | str):
    """base for its first row in the order, then base_2, base_3 and so on."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return F.when(n == 1, base).otherwise(F.concat_ws("_", base, n.cast("string")))


def method_prefix(full_name: Column | str) -> Column:
    """The name before its signature."""
    return F.split_part(_c(full_name), F.lit(":"), F.lit(1))


def short_method(full_name: Column | str) -> Column:
    """Last two dotted parts of the name, with the signature."""
    parts = F.split(method_prefix(full_name), r"\.")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    signature = F.when(_c(full_name).contains(":"), F.concat(F.lit(":"), F.substring_index(_c(full_name), ":", -1))).otherwise("")
    return F.concat(tail, signature)


def constructor_owner(full_name: Column | str) -> Column:
    """`owner` of `owner.<init>`, else null."""
    return F.nullif(F.regexp_extract(_c(full_name), r"^(.*)\.<init>", 1), F.lit(""))


def lambda_host(full_name: Column | str) -> Column:
    """The method in which a lambda stands, as `owner.method`, else null."""
    f = _c(full_name)
    named = F.regexp_extract(f, r"^(.*)\.lambda\$([A-Za-z0-9_]+)\$[0-9]+", 1)
    host = F.regexp_extract(f, r"^(.*)\.lambda\$([A-Za-z0-9_]+)\$[0-9]+", 2)
    return F.when(named != "", F.concat_ws(".", named, host)).when(f.contains(".<lambda>"), F.split_part(f, F.lit(".<lambda>"), F.lit(1)))


def missing_body_reason(full_name: Column | str) -> Column:
    f = _c(full_name)
    return (
        F.when(f.rlike(r"lambda\$|<lambda>|<anonymous>"), F.lit("lambda_or_anonymous_body_omitted"))
        .when(f.contains("<init>"), F.lit("constructor_body_omitted"))
        .otherwise(F.lit("method_body_missing"))
    )


def snake_to_camel(x: Column | str, upper_first: bool = False, suffix: str = "") -> Column:
    parts = F.filter(F.split(_c(x), "_"), lambda p: p != "")
    big = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    joined = F.array_join(big, "")
    if not upper_first:
        joined = F.concat(F.lower(F.substring(joined, 1, 1)), F.substr(joined, F.lit(2)))
    return F.concat(joined, F.lit(suffix))


def camel_to_snake(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(x), "([a-z0-9])([A-Z])", "$1_$2"))


def is_test_source_set(path: Column | str) -> Column:
    """Whether the segment after `src` names a test source set."""
    part = F.regexp_extract(_c(path), r"(?:^|/)src/([^/]+)/", 1)
    return part.rlike("^(test|androidTest)") | part.rlike("Test$")


def contains_token(text: Column | str, token: Column | str) -> Column:
    """Whether the token stands in the text between characters that are not part of identifiers."""
    escaped = F.regexp_replace(_c(token), r"([^A-Za-z0-9_])", r"\\\\$1")
    return F.regexp_like(_c(text), F.concat(F.lit("(^|[^A-Za-z0-9_$])"), escaped, F.lit("([^A-Za-z0-9_$]|$)")))


def type_arguments(name: Column | str) -> Column:
    """A generic type's outer name and arguments as an array."""
    return F.filter(F.transform(F.split(_c(name), "[,<>]"), lambda p: F.trim(F.regexp_replace(p, r"\?$", ""))), lambda p: p != "")


def backoff(attempt: Column | str, base: float, most: float, retry_after: Column | str | None = None) -> Column:
    """base * 2^(attempt - 1), at least what the server asks for, at most `most`."""
    wait = F.lit(base) * F.pow(F.lit(2.0), _c(attempt) - 1)
    if retry_after is not None:
        wait = F.greatest(wait, F.coalesce(_c(retry_after), F.lit(0.0)))
    return F.least(wait, F.lit(most))


def retryable(kind: Column | str, status: Column | str) -> Column:
    # Error types and statuses that are worth another attempt.
    kinds = ["APITimeoutError", "APIConnectionError", "InternalServerError", "RateLimitError"]
    statuses = [408, 409, 429, 520, 522, 524]
    return F.coalesce(_c(kind).isin(kinds), F.lit(False)) | F.coalesce(_c(status).isin(statuses) | (_c(status) >= 500), F.lit(False))


def digest(x: Column | str) -> Column:
    return F.sha2(_c(x), 256)


def cache_key(*parts: Column | str) -> Column:
    """Parts joined by colons; the last one as the first 12 digits of its SHA-256."""
    return F.concat_ws(":", *[_c(p).cast("string") for p in parts[:-1]], F.substring(digest(parts[-1]), 1, 12))


def numbered(letter: str, n: Column | str) -> Column:
    return F.format_string(letter + "%03d", _c(n))
