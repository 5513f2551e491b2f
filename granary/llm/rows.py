"""Input rows as one column, so that an operator's own names can't clash with theirs, and a key of their texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(df: DataFrame, but: Sequence[str] = ()) -> Column:
    """All columns of ``df`` other than ``but`` (whatever their case) as a struct."""
    left_out = {c.lower() for c in but}
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in left_out))


def text_key(df: DataFrame) -> Column:
    """16 bytes that stand for the text of a row; a null text is an empty one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(df["text"], F.lit("")), 256), 1, 32))
