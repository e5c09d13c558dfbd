"""A small HTML report over aggregates; what it collects is bounded by the number of runs and chosen documents."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

#: Rows that a report may show; more are refused rather than cut.
MAX_ROWS = 10_000


def _rows(df: DataFrame) -> list:
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows in a report")
    return rows


def _cell(value: object, mark: str = "") -> str:
    text = f"{value:.3f}" if isinstance(value, float) else "" if value is None else escape(str(value))
    return f'<td class="{mark}">{text}</td>' if mark else f"<td>{text}</td>"


def html(leaderboard: DataFrame, viewer: DataFrame, metrics: list[str]) -> str:
    """The leaderboard with best and worst marked, then each document's answers side by side."""
    board, cells = _rows(leaderboard.orderBy("rank")), _rows(viewer.orderBy("doc_id", "model_id", "run_id"))
    out = ["<!doctype html><meta charset=utf-8><title>Runs</title><style>.best{background:#cfc}.worst{background:#fcc}td,th{padding:2px 8px;text-align:left}</style><table><tr><th>model<th>quant<th>budget"]
    out += [f"<th>{escape(m)}" for m in metrics] + ["<th>badges"]
    for r in board:
        out.append("<tr>" + _cell(r["model_id"]) + _cell(r["quant"]) + _cell(r["thinking_budget"]) + "".join(_cell(r[m], "best" if m in r["best"] else "worst" if m in r["worst"] else "") for m in metrics) + _cell(", ".join(r["badges"])))
    out.append("</table><table><tr><th>document<th>model<th>run<th>verdict<th>answer")
    out += ["<tr>" + "".join(_cell(r[c]) for c in ("doc_id", "model_id", "run_id", "verdict", "answer")) for r in cells]
    return "\n".join([*out, "</table>"])
