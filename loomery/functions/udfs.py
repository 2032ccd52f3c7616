"""Scalars that built-in expressions can't give, as vectorised functions on the standard library."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F


def vectorised(kind: str) -> Callable:
    """A function of Series as one of columns; it becomes a pandas UDF when it is used, so that importing needs no session."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap


@vectorised("string")
def url_join(base: pd.Series, ref: pd.Series) -> pd.Series:
    """The absolute URL of a reference, dot segments included; null where a part is null or no URL."""

    def one(b, r):
        try:
            return None if b is None or r is None else urljoin(b, r)
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)
