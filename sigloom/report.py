"""Reports of small results: Markdown, and an HTML page with a sortable table."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

#: Rows of a report's table; reports are for reading, results themselves stay in Spark.
MOST_ROWS = 1000


def _rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    """Columns and rows; where there are more than ``MOST_ROWS``, a last row says so."""
    rows = [tuple(r) for r in df.limit(MOST_ROWS + 1).collect()]
    more = [(f"only the first {MOST_ROWS} rows are shown", *[None] * (len(df.columns) - 1))] if len(rows) > MOST_ROWS else []
    return df.columns, rows[:MOST_ROWS] + more


def _cell(value) -> str:
    return "" if value is None else f"{value:.4g}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame) -> str:
    columns, rows = _rows(df)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(_cell, r)) + " |" for r in rows)])


def document(title: str, tables: dict[str, DataFrame]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown(df)}" for name, df in tables.items())]) + "\n"


_SCRIPT = """document.querySelectorAll('th').forEach(h=>h.onclick=()=>{const t=h.closest('table'),i=h.cellIndex,b=t.tBodies[0],d=h.dataset.d=h.dataset.d==='1'?'-1':'1';
[...b.rows].sort((x,y)=>{const p=x.cells[i].innerText,q=y.cells[i].innerText;return d*(isNaN(p)||isNaN(q)?p.localeCompare(q):p-q)}).forEach(r=>b.append(r))})"""


def page(title: str, tables: dict[str, DataFrame]) -> str:
    """One HTML page; a click on a column's head sorts by it."""
    parts = []
    for name, df in tables.items():
        columns, rows = _rows(df)
        head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(parts)}<script>{_SCRIPT}</script>"
