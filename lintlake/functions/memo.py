"""Build large column expressions once per Spark application."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import TypeVar

from pyspark import SparkContext

T = TypeVar("T")


def per_application(fn: Callable[..., T]) -> Callable[..., T]:
    """Cache ``fn``'s result by its arguments for the running Spark application.

    A column is an immutable description, but building one with many higher-order functions costs
    hundreds of calls into the JVM; the checks are used by many jobs of one application.
    """
    cache: dict[tuple, T] = {}

    @functools.wraps(fn)
    def wrapper(*args: object) -> T:
        context = SparkContext._active_spark_context
        key = (id(context), getattr(context, "applicationId", None), *map(repr, args))
        if key not in cache:
            cache[key] = fn(*args)
        return cache[key]

    return wrapper
