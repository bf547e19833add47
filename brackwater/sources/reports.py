"""Reports with content: pages and text tables over small aggregates. Nothing is collected but figures, one row a check, and top lists."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from brackwater.sources.writers import STATUSES

# Colours of states and tiers.
COLOURS = {"PASS": "#2e7d32", "WARN": "#f9a825", "WARNING": "#f9a825", "FAIL": "#c62828", "ERROR": "#c62828", "CRITICAL": "#b71c1c", "HIGH": "#e65100", "SUSPICIOUS": "#f9a825", "CLEAN": "#2e7d32"}
TIERS = ("CRITICAL", "HIGH", "SUSPICIOUS", "CLEAN")
TYPES = ("ipv4", "domain", "url", "hash")
_STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}.card{display:inline-block;border:1px solid #ccc;padding:.6em 1.2em;margin:.3em}.card b{font-size:1.6em;display:block}.badge{color:#fff;padding:.1em .5em;border-radius:.3em}.bar{display:inline-block;height:1em}"


def badge(status: str) -> str:
    return f'<span class="badge" style="background:{COLOURS.get(status, "#555")}">{html.escape(status)}</span>'


def cards(figures: dict[str, object]) -> str:
    return "".join(f'<div class="card"><b>{html.escape(str(v))}</b>{html.escape(k)}</div>' for k, v in figures.items())


def bars(figures: dict[str, int], width: int = 300) -> str:
    most = max([*figures.values(), 1])
    return "".join(f'<div>{html.escape(k)} <span class="bar" style="width:{width * v // most}px;background:{COLOURS.get(k, "#555")}"></span> {v}</div>' for k, v in figures.items())


def rows_table(rows: Sequence[Row], columns: Sequence[str], badges: Sequence[str] = ("status",)) -> str:
    cell = lambda r, c: badge(str(r[c])) if c in badges else html.escape("" if r[c] is None else f"{r[c]:.4g}" if isinstance(r[c], float) else str(r[c]))
    return f"<table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in columns)}</tr>" + "".join(f"<tr>{''.join(f'<td>{cell(r, c)}</td>' for c in columns)}</tr>" for r in rows) + "</table>"


def page(title: str, *parts: str) -> str:
    t = html.escape(title)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{t}</title><style>{_STYLE}</style></head><body><h1>{t}</h1>{''.join(parts)}</body></html>"


CHECK_COLUMNS = ("check_name", "status", "details", "affected", "total", "recommendation")


def quality_report(checks: DataFrame, title: str = "Dataset quality") -> str:
    """Counts by state, worst state first in the table, and what to do about each check that did not pass."""
    rows = sorted(checks.select(*CHECK_COLUMNS).collect(), key=lambda r: (("FAIL", "WARN", "PASS").index(r.status), r.check_name))
    n = {s: sum(r.status == s for r in rows) for s in ("PASS", "WARN", "FAIL")}
    todo = "".join(f"<li>{badge(r.status)} {html.escape(r.check_name)}: {html.escape(r.recommendation)}</li>" for r in rows if r.status != "PASS")
    return page(title, cards({"checks": len(rows), **n}), f"<h2>To do</h2><ul>{todo or '<li>Nothing.</li>'}</ul>", "<h2>Checks</h2>", rows_table(rows, CHECK_COLUMNS))


def evaluation_report(name: str, rates: DataFrame, sweep: DataFrame | None = None, contributions: DataFrame | None = None, missed: DataFrame | None = None) -> str:
    """One row of rates with the confusion matrix, and if given the threshold sweep (its best F1 marked), the top features and the
    categories with most errors."""
    r = rates.first()
    parts = [cards({k: f"{r[k]:.3f}" for k in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")})]
    parts.append(f"<h2>Confusion matrix</h2><table><tr><th></th><th>predicted 0</th><th>predicted 1</th></tr><tr><th>0</th><td>{r['tn']}</td><td>{r['fp']}</td></tr><tr><th>1</th><td>{r['fn']}</td><td>{r['tp']}</td></tr></table>")
    if sweep is not None:
        rows = sweep.orderBy("threshold").collect()
        best = max(rows, key=lambda x: x["f1"])["threshold"] if rows else None
        parts += [f"<h2>Thresholds</h2><p>Best F1 at {best}</p>", rows_table(rows, ("threshold", "precision", "recall", "f1", "fpr", "fnr"))]
    if contributions is not None:
        parts += ["<h2>Features</h2>", rows_table(contributions.orderBy(F.desc("mean_abs"), "feature").limit(10).collect(), ("feature", "mean_abs"))]
    if missed is not None:
        parts += ["<h2>Errors by category</h2>", rows_table(missed.orderBy(F.desc(F.col("false_negatives") + F.col("false_positives")), "category").limit(10).collect(), ("category", "false_positives", "false_negatives"))]
    return page(name, *parts)


def store_figures(store: DataFrame) -> dict[str, dict[str, int]]:
    """Counts of the store: all, by state, by tier (of active ones; an unknown tier counts as clean) and by type (others together)."""
    count = lambda c, n: F.count_if(F.coalesce(c, F.lit(False))).alias(n)
    tier = F.when(F.col("risk_tier").isin(*TIERS), F.col("risk_tier")).otherwise("CLEAN")
    kind = F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("other")
    active = F.col("status") == "active"
    wanted = [count(F.lit(True), "all/all"), count(active & (F.col("confidence") >= 70), "all/confident")]
    wanted += [count(F.col("status") == s, f"status/{s}") for s in STATUSES]
    wanted += [count(active & (tier == t), f"tier/{t}") for t in TIERS] + [count(kind == k, f"type/{k}") for k in (*TYPES, "other")]
    row = store.agg(*wanted).first().asDict()
    out: dict[str, dict[str, int]] = {}
    for name, n in row.items():
        group, _, own = name.partition("/")
        out.setdefault(group, {})[own] = n
    return out


def executive_report(store: DataFrame, title: str = "Indicators", top: int = 10) -> str:
    """Key figures, bars by tier and type, and the active indicators with the highest risk, then confidence."""
    n = store_figures(store)
    first = store.filter("status = 'active'").orderBy(F.desc("risk_score"), F.desc("confidence"), "indicator").limit(top).collect()
    columns = ("indicator", "type", "risk_tier", "risk_score", "confidence")
    return page(title, cards({"indicators": n["all"]["all"], **n["status"], "high confidence": n["all"]["confident"]}), "<h2>Tiers</h2>", bars(n["tier"]), "<h2>Types</h2>", bars(n["type"]), "<h2>First to act on</h2>", rows_table(first, columns, ("risk_tier",)))


def text_table(df: DataFrame, columns: Sequence[str], most_rows: int = 50) -> str:
    """A table for a terminal: columns as wide as their widest cell."""
    rows = [tuple(columns), *(tuple("" if v is None else str(v) for v in r) for r in df.select(*columns).limit(most_rows).collect())]
    wide = [max(len(r[i]) for r in rows) for i in range(len(columns))]
    line = lambda r: "  ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip()
    return "\n".join([line(rows[0]), "  ".join("-" * w for w in wide), *map(line, rows[1:])])


def store_lines(store: DataFrame) -> str:
    """The store's figures for a terminal."""
    return "\n".join(f"{group}: " + ", ".join(f"{k} {v}" for k, v in own.items()) for group, own in store_figures(store).items())
