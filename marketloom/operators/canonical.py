"""A normal form of JSON, so that documents that say the same have the same hash whatever the order of their keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_form(text: str | None) -> str | None:
    """JSON with keys sorted at every depth, without white space, letters beyond ASCII as escapes; empty for null, blank, text
    that is no JSON, and empty objects or arrays. Numbers keep what a reader takes them for; of repeated keys the last counts."""
    if text is None or not text.strip():
        return ""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return ""
    return json.dumps(value, sort_keys=True, separators=(",", ":")) if value else ""


def canonical(text: Column) -> Column:
    """normal_form of a column. Sorting keys at any depth has no built-in function; texts go to Python in Arrow batches."""

    @F.pandas_udf("string")
    def form(x: pd.Series) -> pd.Series:
        return x.map(normal_form, na_action=None)

    return form(text)


def content_hash(payload: Column, html: Column | None = None) -> Column:
    """SHA-256 of a payload's normal form and of the page behind it."""
    page = F.coalesce(html, F.lit("")) if html is not None else F.lit("")
    return F.sha2(F.concat(canonical(payload), page), 256)
