"""Doing only what is not done: pending rows and keep-newest merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.functions.text import is_error, present


def pending(work: DataFrame, done: DataFrame, key: Sequence[str], answer: str) -> DataFrame:
    """Rows of ``work`` without a usable answer in ``done``."""
    usable = done.filter(present(answer).isNotNull() & ~is_error(answer)).select(*key)
    return work.join(usable, list(key), "left_anti")


def upsert(done: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """All keys, the fresh row where there is one."""
    return done.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh)
