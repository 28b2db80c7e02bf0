"""Functions that need Unicode tables, as Arrow batches, and their registration for SQL."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def normal_form(text: Column, form: str = "NFKD") -> Column:
    """A text in a Unicode normal form; null for null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return run(text)


def normalize_token(text: Column) -> Column:
    """Compatibility decomposition, lower case, one letter for е and ё."""
    return F.translate(F.lower(normal_form(text)), "ё", "е")


def slug_words(text: Column) -> Column:
    """The words of two or more letters and digits of a text, decomposed and without marks, in order."""
    low = F.regexp_replace(F.lower(normal_form(text)), "[̀-ͯ]", "")
    return F.filter(F.split(F.regexp_replace(low, r"[^0-9a-zа-я]+", " "), " "), lambda w: F.length(w) > 1)


def register(spark: SparkSession, terms: tuple[str, ...] = (), exceptions: tuple[str, ...] = ()) -> None:
    """Make ``normalize_token``, ``stem_token`` and ``inspect_text`` (the terms in a text, joined by bars) known to SQL."""
    from kvasir.operators.moderate import inspect, term_list

    @F.pandas_udf("string")
    def normalize(values: pd.Series) -> pd.Series:
        return values.map(lambda t: unicodedata.normalize("NFKD", t).lower().replace("ё", "е"), na_action="ignore")

    @F.pandas_udf("string")
    def rules(values: pd.Series) -> pd.Series:
        listed = term_list(terms, exceptions)
        return values.map(lambda t: "|".join(inspect(t, listed).rules), na_action="ignore")

    spark.udf.register("normalize_token", normalize)
    spark.udf.register("inspect_text", rules)
    spark.sql("create or replace temporary function stem_token(word string) returns string return " + _stem_sql("word"))


def _stem_sql(word: str) -> str:
    from kvasir.functions.text import LEAST_STEM, SUFFIXES

    return f"regexp_replace({word}, '^(.{{{LEAST_STEM},}}?)(?:{'|'.join(SUFFIXES)})$', '$1')"
