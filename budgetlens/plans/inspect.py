"""Plan checks: read what Catalyst planned, from ``explain`` output.

Used by the tests (and handy interactively) to assert that filters reach the
scan, columns are pruned, top-k is fused, per-group limits run before the
shuffle, and exchanges are reused.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*)\]", plan_text(df))


def partition_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PartitionFilters: \[(.*)\]", plan_text(df))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*>)", plan_text(df))


def count_nodes(df: DataFrame, name: str, text: str | None = None) -> int:
    """How many plan nodes of ``name`` (e.g. 'Exchange', 'WindowGroupLimit')
    the formatted plan's tree lists."""
    text = text if text is not None else plan_text(df)
    tree = text.split("\n\n")[0]
    return len(re.findall(rf"\b{name}\b", tree))
