"""Names: classes, variants, fixed-decimal texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalise_class(name: Column | str) -> Column:
    """Lower case, words joined by ``_``."""
    words = F.split(F.lower(_col(name)), r"\s+")
    return F.array_join(F.filter(words, lambda w: w != ""), "_")


def clean_text(value: Column | str) -> Column:
    return F.trim(_col(value).cast("string"))


def fixed(value: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, ``-inf`` for silence."""
    return F.when(value == float("-inf"), "-inf").otherwise(F.format_string(f"%.{digits}f", F.bround(value, digits)))


# Suffix pattern of every kind of variant.
VARIANT_SUFFIX = {
    "pitch": "_ps%+.1f",
    "stretch": "_ts%.1f",
    "noise": "_noise%.0fdB",
    "volume": "_vol%+.0fdB",
    "pitch_hz": "_%+.0fHz",
}


def variant_name(base: Column | str, kind: Column, param: Column) -> Column:
    """Base name plus the suffix of its variant; ``reversed`` has no parameter."""
    base = _col(base)
    chain = F.when(kind == "reversed", F.concat(base, F.lit("_reversed")))
    for name, pattern in VARIANT_SUFFIX.items():
        chain = chain.when(kind == name, F.concat(base, F.format_string(pattern, param.cast("double"))))
    return chain


def stem(file_name: Column | str) -> Column:
    return F.regexp_replace(_col(file_name), r"\.[^.]*$", "")
