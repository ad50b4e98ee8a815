"""Results for readers: Markdown tables and plain-text listings of collected rows.

Each takes a result that is bounded by what was asked for (a report, the hits of one
question), never a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _cell(v: object) -> str:
    if v is None:
        return "—"
    return f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A title and the rows in order; more than ``most`` rows are an error."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join(map(_cell, r)) + " |" for r in rows)]) + "\n"


def _listing(title: str, rows: list[str]) -> str:
    return "\n".join([title, "-" * len(title), *(rows or ["(nothing)"])]) + "\n"


def hits_text(question: str, hits: DataFrame) -> str:
    return _listing(question, [f"{r['rank']:>3}  {r['score']:.3f}  {r['source_pdf'] or '-'}  {r['source_ref'] or '-'}  {(r['source_quote'] or '')[:120]}" for r in hits.orderBy("rank").collect()])


def trace_text(requirement: DataFrame, matches: DataFrame) -> str:
    r = requirement.first()
    out = [f"{c}: {_cell(r[c])}" for c in ("requirement_id", "source_pdf", "source_ref", "source_quote", "description") if c in requirement.columns]
    if "context_text" in requirement.columns and r["context_text"]:
        out += ["", r["context_text"]]
    return _listing("Requirement", out) + "\n" + _listing("Elsewhere", [f"{m['source_pdf'] or '-'}: {(m['source_quote'] or '')[:120]}" for m in matches.orderBy("source_pdf").take(200)])


def compare_text(query: str, mode: str, rows: DataFrame) -> str:
    order = ["ref_rank", "source_pdf"] if mode == "semantic" else ["source_pdf"]
    return _listing(f"{query} ({mode})", [f"{r['source_ref'] or '-'}  {r['source_pdf'] or '-'}  {(r['source_quote'] or '')[:120]}" for r in rows.orderBy(*order).collect()])


def evidence_text(query: str, groups: DataFrame) -> str:
    return _listing(query, [f"{r['label']}  ({len(r['sources'])} sources)  {(r['description'] or r['source_quote'] or '')[:120]}" for r in groups.orderBy("first_rank").collect()])


def documents_text(docs: DataFrame) -> str:
    return _listing("Documents", [f"{r['n_reqs']:>6}  {r['source_pdf'] or r['doc_key']}" for r in docs.take(1000)])


def status_text(status: dict) -> str:
    indexes = [f"{n}: {x['points'] if x['version'] else 'none'}" for n, x in status["indexes"].items()]
    return _listing("Status", indexes + [f"{n}: {'ready' if ok else 'not ready'}" for n, ok in status["providers"].items()])
