"""HTML tables of results for notebooks, and a plot of performance over time."""

from __future__ import annotations

import html
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame


def cell(value) -> str:
    return f"{value:.6g}" if isinstance(value, float) else html.escape(str(value))


def html_table(headers: Sequence[str], rows: Iterable[Sequence]) -> str:
    head = "".join(f"<th>{html.escape(h)}</th>" for h in headers)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in row) + "</tr>" for row in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def plot_over_time(report: DataFrame, time_col: str = "middle"):
    """Draws auc and ks, and psi with its 0.25 line if there is one, of performance_over_time(): a row for each window is gathered. Needs matplotlib."""
    import matplotlib.pyplot as plt

    rows = report.orderBy(time_col).collect()
    figure, axis = plt.subplots()
    at = [r[time_col] for r in rows]
    for name in ("auc", "ks"):
        axis.plot(at, [r[name] for r in rows], marker="o", label=name)
    if "psi" in report.columns:
        other = axis.twinx()
        other.plot(at, [r["psi"] for r in rows], color="gray", label="psi")
        other.axhline(0.25, linestyle="--", color="gray")
    axis.legend()
    return figure
