"""Column expressions for names, identities and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(c: Column) -> Column:
    return F.lower(c)


def alnum_key(c: Column) -> Column:
    """Folded letters and digits only, of any script."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def lexical(c: Column) -> Column:
    """Folded words, one space between them."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def edge_id(*parts: Column) -> Column:
    return F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def fingerprint(*parts: Column) -> Column:
    """Digest of values; a null differs from an empty string."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("~")) for p in parts]), 256)


def noisy_or(weights: Column) -> Column:
    """1 - product of (1 - w), to six places; an exact 1 stays exact."""
    return F.round(1 - F.aggregate(weights, F.lit(1.0), lambda a, w: a * (1 - w)), 6)


def name_style(c: Column) -> Column:
    return (
        F.when(c.rlike("^[A-Z][a-z0-9]*( [A-Z0-9][a-z0-9]*)+$"), "title")
        .when(c.rlike("^[a-z0-9]+(_[a-z0-9]+)+$"), "snake")
        .when(c.rlike("^[A-Z0-9]+([ _#][A-Z0-9]+)*$"), "upper")
        .when(c.rlike("^[a-z0-9]+( [a-z0-9]+)*$"), "lower")
        .when(c.rlike("^[A-Z][A-Za-z0-9]*$"), "pascal")
        .when(c.rlike("^[a-z][A-Za-z0-9]*$"), "camel")
        .otherwise("other")
    )
