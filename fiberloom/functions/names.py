"""Expressions over names, paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(name: Column) -> Column:
    """Lower-case words joined by underscores: breaks at ``_ - . : space`` and between lower and upper case."""
    joined = F.regexp_replace(F.regexp_replace(name, r"[\-.: ]+", "_"), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.lower(joined), r"^_+|_+$", "")


def tokens(name: Column) -> Column:
    """The distinct tokens of the normalized name, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normalized(name), "_"), lambda t: t != "")))


def variants(name: Column, suffixes: tuple[str, ...]) -> Column:
    """The normalized name, and it without a class suffix, as a sorted set."""
    whole = normalized(name)
    cut = F.regexp_replace(whole, "_(?:" + "|".join(suffixes) + ")$", "")
    return F.array_sort(F.array_distinct(F.array(whole, cut)))


def public_name(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))), "")


def common_prefix(low: Column, high: Column) -> Column:
    """The longest common prefix; of a whole set when given its least and greatest member."""
    sizes = F.sequence(F.lit(0), F.least(F.length(low), F.length(high)))
    fits = F.filter(sizes, lambda n: F.substr(low, F.lit(1), n) == F.substr(high, F.lit(1), n))
    return F.substr(low, F.lit(1), F.array_max(fits))


def stable_id(*parts: Column) -> Column:
    """Ten hexadecimal digits that depend on the parts alone."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 10)


def fingerprint_text(text: Column) -> Column:
    """Text with case, digits and spacing taken out of it, hashed."""
    return F.md5(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "#"), r"[ \t\n\r]+", " "))


def symbol_root(symbol: Column) -> Column:
    return F.substring_index(F.translate(symbol, ":", "."), ".", 1)


def parents(path: Column) -> Column:
    """All directories above a path, longest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|testing)/") | path.rlike(r"(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$")
