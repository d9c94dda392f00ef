"""Counters of a run, taken while it is written, and the log they go to."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("sieveline")


def setup_log(path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """Log lines with their time to the console and, if given, a file of the driver. Calling it again changes nothing."""
    if not log.handlers:
        form = logging.Formatter("%(asctime)s [%(levelname)s] %(message)s")
        for handler in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
            handler.setFormatter(form)
            log.addHandler(handler)
    log.setLevel(level)
    return log


def observed(df: DataFrame, write: Callable[[DataFrame], object], name: str = "run", **counters: Column) -> dict[str, object]:
    """Write `df` and return `rows` and these aggregates of it, measured in the same pass and logged."""
    seen = Observation(name)
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counters.items()]))
    got = seen.get
    log.info("%s: %s", name, ", ".join(f"{k} {v}" for k, v in got.items()))
    return got
