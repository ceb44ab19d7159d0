"""Column expressions that are built once in a session: putting a large one together takes seconds, using it again none."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column

_kept: dict[tuple, Column] = {}


def built_once(make: Callable[..., Column]) -> Callable[..., Column]:
    """For functions without side effects, of hashable arguments that are no columns."""

    @wraps(make)
    def kept(*args) -> Column:
        context = SparkContext._active_spark_context
        key = (context.applicationId if context else "", make.__module__, make.__qualname__, args)
        if key not in _kept:
            for old in [k for k in _kept if k[0] != key[0]]:
                del _kept[old]
            _kept[key] = make(*args)
        return _kept[key]

    return kept
