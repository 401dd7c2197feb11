"""Reports from small aggregates: Markdown, and the same escaped as HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from turnloom.functions.spec import MetricSpec, require

LIMITS = (
    "Descriptive: no causal effect is estimated and no student is ranked.",
    "Scores describe the demand of observed questions; they are neither ability nor achievement.",
    "Bounds for missing indicators hold the observed ones fixed; they are not confidence intervals.",
    "Missing labels, admission and sampling may change the results.",
)
CAUSAL_LIMITS = (
    "The audit checks structure and declarations; it proves neither parallel trends nor the absence of selection.",
    "Intervals resample whole clusters within an arm; where a draw loses support there is none.",
    "Strata are exploratory and not adjusted for their number.",
    "Bias bounds are assumptions fixed beforehand, not measured violations.",
)


def cell(v) -> str:
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")


def rows_table(title: str, columns: list[str], rows: list) -> str:
    return "\n".join([f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows], ""])


def section(title: str, df: DataFrame, limit: int = 200) -> str:
    """A table of at most ``limit`` rows; a longer one is an error, not cut."""
    rows = df.limit(limit + 1).collect()
    require(len(rows) <= limit, "REPORT_ROWS_NOT_AGGREGATED")
    return rows_table(title, df.columns, rows)


def page(title: str, markdown: str) -> str:
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><pre>{html.escape(markdown)}</pre>"


def build(title: str, sections: dict[str, DataFrame], limits: list[str] = ()) -> tuple[str, str]:
    md = "\n".join([f"# {title}", "", *[section(k, v) for k, v in sections.items()], *[f"- {x}" for x in limits]])
    return md, page(title, md)


def metrics_report(rollup: DataFrame, spec: MetricSpec, *, synthetic: bool, more: dict[str, DataFrame] | None = None) -> tuple[str, str]:
    """Terms (one row each, also where nobody has a score), the specification, and what
    else is given: observed change, schemes, correlations, label noise."""
    title = "Synthetic demonstration: no real student" if synthetic else "Internal exploratory analysis"
    facts = [("formula", spec.version), ("weights", spec.weights), ("aggregation", spec.aggregation.kind), ("balance", spec.dhi_mode), ("catalogue", "unknown" if spec.catalog is None else len(spec.catalog))]
    parts = [f"# {title}", "", section("Terms", rollup.orderBy("term")), rows_table("Specification", ["field", "value"], facts)]
    parts += [section(name, df) for name, df in (more or {}).items()]
    md = "\n".join([*parts, *[f"- {x}" for x in LIMITS]])
    return md, page(title, md)


def causal_report(found: dict, protocol, *, synthetic: bool, balance: DataFrame | None = None, overlap: DataFrame | None = None) -> tuple[str, str]:
    """What ``workflow.study`` found; a blocked study is reported with its reasons and
    without any estimate."""
    title = "Synthetic validation: no real effect" if synthetic else "Internal study: conditional causal analysis"
    head = [("status", found["status"]), ("term", protocol.term), ("time zero", protocol.time_zero), ("follow-up", " to ".join(protocol.window)), ("scale", (protocol.lower, protocol.upper)), ("clusters by arm", found.get("clusters"))]
    parts = [f"# {title}", "", rows_table("Design", ["field", "value"], head)]
    if found["status"] == "blocked":
        parts.append(rows_table("Blockers", ["code"], [(c,) for c in found["blockers"]]))
    else:
        parts.append(rows_table("Review", ["warning"], [(w,) for w in found["warnings"]]))
        parts += [section(name, df) for name, df in (("Balance", balance), ("Overlap and weights", overlap)) if df is not None]
        parts.append(rows_table("Effect", ["field", "value"], [*found["fit"].items(), *found["inference"].items(), ("threshold exceeded", found["threshold_exceeded"])]))
        parts.append(rows_table("Bias bounds", ["bias", "effect", "interval"], [(b, x["effect"], x["interval"]) for b, x in found["bias_bounds"].items()]))
        parts.append(rows_table("Strata", list(found["subgroups"][0]) if found["subgroups"] else ["stratum"], [list(r.values()) for r in found["subgroups"]]))
    md = "\n".join([*parts, *[f"- {x}" for x in CAUSAL_LIMITS]])
    return md, page(title, md)
