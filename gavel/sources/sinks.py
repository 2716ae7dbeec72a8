"""Report sink: tab-separated report lines, one tag per report.

`latency_ccdf\\t<value>\\t<fraction>\\t<count>` and
`summary_timeline\\t<slot>\\t<p25>...` as plain text, written by the
executors (no collect to the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_lines(df: DataFrame, tag: str, order_by: list[str] | None = None) -> DataFrame:
    """One `value` string per row: tag, then the columns, tab separated."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    lines = df.select(*(order_by or []), F.concat_ws("\t", F.lit(tag), *cols).alias("value"))
    if order_by:
        lines = lines.orderBy(*order_by)
    return lines.select("value")


def write_report(df: DataFrame, path: str, tag: str, order_by: list[str] | None = None,
                 mode: str = "overwrite") -> None:
    report_lines(df, tag, order_by).write.mode(mode).text(path)
