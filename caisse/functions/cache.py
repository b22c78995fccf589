"""Reuse of pure Column expressions.

A ``Column`` built from ``pyspark.sql.functions`` is an unresolved expression
tree living in the JVM; it can be used in any number of DataFrames. Large
builders (dashboard fold, insight and answer templates) depend only on a few
static parameters, so they are built once per JVM instead of once per query:
building them costs thousands of Python-to-JVM calls, executing them nothing
extra.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


def _jvm_key() -> str | None:
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    return sc.applicationId if sc is not None else None


def jvm_cached(fn: Callable[..., T]) -> Callable[..., T]:
    """Memoise a Column builder per JVM; its arguments must be hashable."""
    cache: dict[tuple, T] = {}

    @functools.wraps(fn)
    def wrapper(*args):
        key = (_jvm_key(), args)
        if key not in cache:
            cache[key] = fn(*args)
        return cache[key]

    return wrapper
