"""The test for texts that say nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that programs print for a missing value.
MISSING_WORDS = ("null", "none", "nan", "undefined", "nil", "na", "n/a")
LONGEST = max(map(len, MISSING_WORDS))

# Neither a letter nor a digit nor a symbol that carries meaning of its own: separators, controls, formats, marks, punctuation.
IDLE = r"[\p{Z}\p{C}\p{P}\p{M}\s`|<>~^+=$]+"


def is_blank(text: Column) -> Column:
    """True for null, for a text of white space, invisible and punctuation characters alone, and for a missing-value word.

    Never null. A missing-value word counts in any letter case and within punctuation (``<null>``, ``"None"``).
    """
    bare = F.lower(F.regexp_replace(text, IDLE, ""))
    missing = bare.isin("", *(w.replace("/", "") for w in MISSING_WORDS))
    # A run of letters longer than any such word settles most texts at their first words.
    return F.coalesce(~text.rlike(r"[\p{L}\p{N}]{%d}" % (LONGEST + 1)) & missing, F.lit(True))
