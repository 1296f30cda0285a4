"""Columns by name, whatever characters the name has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(names: Iterable[str]) -> list[Column]:
    """Names that came from a file may hold dots, which a bare name would split at."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]
