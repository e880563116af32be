"""Words as the tables define them: longest runs of letters and digits, case ignored."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Runs of letters and digits for Python's ``re``.
RUN = re.compile(r"[^\W_]+")


def words(text) -> Column:
    """Array of the lower-case words of a text, in order; null for a null text."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(found, lambda w: F.lower(w))
