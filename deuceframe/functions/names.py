"""Expressions and UDFs on names of players and events."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def strip_accents(values: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks. Spark has no such function; Arrow hands over whole batches."""
    fold = lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
    return values.map(lambda v: None if v is None else fold(v))


def plain_name(name: Column) -> Column:
    """Lower case, without accents, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(name)), "[^a-z0-9]+", " "))


def surname_signature(name: Column) -> Column:
    """struct<surname, initials> of `Surname X.Y.`; null where the text has another form."""
    pattern = r"^(.*?)\s+((?:[^\s.]{1,2}\.)+)$"
    text = F.trim(name)
    fits = F.regexp_like(text, F.lit(pattern))
    return F.when(
        fits,
        F.struct(
            F.lower(F.regexp_extract(text, pattern, 1)).alias("surname"),
            F.lower(F.regexp_replace(F.regexp_extract(text, pattern, 2), r"\.", "")).alias("initials"),
        ),
    )


def full_name_signatures(name: Column) -> Column:
    """array<struct<surname, initials>>: every split of a full name into given names and surname."""
    words = F.split(F.lower(F.trim(name)), r"\s+")
    cuts = F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1)))
    return F.when(
        F.size(words) > 1,
        F.transform(
            cuts,
            lambda i: F.struct(
                F.array_join(F.slice(words, i + 1, F.size(words)), " ").alias("surname"),
                F.array_join(F.transform(F.slice(words, F.lit(1), i), lambda w: F.substring(w, 1, 1)), "").alias("initials"),
            ),
        ),
    )


def without_disambiguator(name: Column) -> Column:
    """A name without a bracketed addition at its end."""
    return F.regexp_replace(name, r"\s*\([^()]*\)\s*$", "")


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The gestalt pattern matching ratio of two texts (not an edit distance)."""
    return pd.Series(
        [None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)],
        dtype="float64",
    )
