"""Splitting texts into lists and lists into rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_on(c: Column, separators: str) -> Column:
    """List of the parts between any of the separator characters, empty parts included; null stays null."""
    if not separators:
        return F.when(c.isNotNull(), F.array(c))
    return F.split(c, "[" + re.sub(r"([\\\[\]^&~\-])", r"\\\1", separators) + "]", -1)


def ungroup(df: DataFrame, lists: Column, out: str, place: str) -> DataFrame:
    """A row per element in ``out``, its place in the list in ``place``; null and empty lists give no row."""
    return df.select("*", F.posexplode(lists).alias(place, out))
