"""Operators for preparing training data; nothing outside this package imports it."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def shipped(module: str) -> None:
    """Send a module's functions to the executors with the jobs that use them; it need not be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
