"""Reports as text, out of small frames: one row, or a few rows by their nature. Only here are results gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codeloom.operators import statistics


def duration(seconds: float | None) -> str:
    """1h02m03s, 2m03s or 3s."""
    if seconds is None or seconds != seconds or seconds < 0:
        return "N/A"
    whole = int(seconds)
    hours, minutes, rest = whole // 3600, whole % 3600 // 60, whole % 60
    return f"{hours}h{minutes:02d}m{rest:02d}s" if hours else f"{minutes}m{rest:02d}s" if minutes else f"{rest}s"


def cell(value: object, digits: int = 2) -> str:
    if value is None or value != value:
        return "N/A"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A table. More than ``most`` rows are an error: a report does not cut off what it shows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: more than {most} rows")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v).replace("|", "\\|") for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def text(df: DataFrame, title: str, width: int = 68, most: int = 1000) -> str:
    """Key and value lines of the columns of each row."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: more than {most} rows")
    wide = max(map(len, df.columns), default=0)
    lines = ["=" * width, title, "=" * width]
    for r in rows:
        lines += [f"  {c:<{wide}}  {cell(r[c])}" for c in df.columns] + ["-" * width]
    return "\n".join(lines) + "\n"


def experiment_report(summary: DataFrame, detail: DataFrame, configuration: dict[str, object], title: str = "Experiment") -> str:
    """A run as Markdown: its configuration, the named figures, stages with what they show, errors, and repair rounds. Every section is
    an aggregate of a few rows."""
    setting = ["| Setting | Value |", "|---|---|", *[f"| {cell(k)} | {cell(v)} |" for k, v in configuration.items()]]
    stages = statistics.stage_success(summary).join(statistics.findings(summary), "stage").orderBy("stage")
    sections = (
        (statistics.summary_table(summary, detail).orderBy("place").select("metric", "value"), "Results"),
        (stages, "Stages"),
        (statistics.top_errors(detail), "Errors"),
        (statistics.repair_distribution_a(summary).orderBy("rounds"), "Repair rounds"),
    )
    return "\n".join([f"# {title}", "", "## Configuration", "", *setting, "", *[markdown(df, name) for df, name in sections]])
