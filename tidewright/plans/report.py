"""Markdown reports of endpoint summaries; one row per model or category reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Text for each interpretation flag.
READINGS = {
    "failed_validation": "Scores are missing, so nothing can be said.",
    "no_context_sensitivity": "The scores hardly move when context is given.",
    "nonspecific_context_inflation": "The scores move as much with another patient's context.",
    "modest_patient_specific_alignment": "The right context moves the scores a little more towards the observers than another one.",
    "strong_patient_specific_alignment": "The right context moves the scores clearly more towards the observers than another one.",
}
LIMIT = 10_000


def shown(value: object) -> str:
    if value is None or isinstance(value, float) and value != value:
        return "N/A"
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown_table(df: DataFrame, order: list[str]) -> str:
    """A table of a small frame; more than LIMIT rows are an error."""
    rows = df.orderBy(*order).limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError("too many rows for a report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in rows])


def endpoint_report(summary: DataFrame, ranking: DataFrame, title: str = "Context study") -> str:
    """The summary per model, the ranking and a reading per model."""
    flags = [f"- {r.model}: {READINGS.get(r.flag, r.flag)}" for r in summary.select("model", "flag").orderBy("model").collect()]
    return "\n\n".join([f"# {title}", "## Models", markdown_table(summary, ["model"]), "## Ranking", markdown_table(ranking, ["rank"]), "## Reading", "\n".join(flags)])
