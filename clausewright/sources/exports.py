"""Checklists as CSV, JSON, Markdown and, where the library is there, XLSX."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

COLUMNS = ("item_id", "requirement_id", "source_ref", "source_quote", "description", "section_title_path", "domain_tags", "requirement_type", "pages", "confidence", "requires_human_review", "review_reasons", "source_pdf")
_JOINS = {"section_title_path": " > ", "domain_tags": ", ", "review_reasons": "; ", "pages": ", "}


def csv_columns(items: DataFrame) -> DataFrame:
    """Arrays joined and text guarded against formulas; other columns stay."""
    for c, sep in _JOINS.items():
        items = items.withColumn(c, F.coalesce(F.array_join(F.col(c).cast("array<string>"), sep), F.lit("")))
    for c in COLUMNS:
        if dict(items.dtypes)[c] == "string":
            items = items.withColumn(c, T.csv_safe(F.col(c)))
    return items


def to_csv(items: DataFrame) -> str:
    """CRLF text for one document's checklist; for a corpus write the DataFrame."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(COLUMNS)
    for r in csv_columns(items).select(*COLUMNS).toLocalIterator():
        w.writerow(["" if v is None else v for v in r])
    return out.getvalue()


def to_json(items: DataFrame, header: dict) -> str:
    rows = [json.loads(r[0]) for r in items.select(F.to_json(F.struct(*COLUMNS))).toLocalIterator()]
    return json.dumps(header | {"items": rows}, indent=2, ensure_ascii=False, default=str)


def to_markdown(items: DataFrame, title: str) -> str:
    body = F.format_string("## %s\n\n> %s\n\n- Section: %s\n- Confidence: %.2f\n- Review: %s\n", F.coalesce(F.nullif("source_ref", F.lit("")), F.lit("(no ref)")), "source_quote", F.array_join(F.coalesce("section_title_path", F.array().cast("array<string>")), " > "), F.coalesce("confidence", F.lit(0.0)), F.array_join("review_reasons", ", "))
    return "\n".join([f"# {title}\n", *(r[0] for r in items.select(body).toLocalIterator())])


# Columns of the workbook (heading, item field, width, wrapped), the groups above them, the states of an item.
SHEET = (
    ("Ref", "source_ref", 14, False), ("Section", "section_title_path", 28, False), ("Pages", "pages", 9, False), ("Source Quote", "source_quote", 36, True),
    ("Audit Question", "audit_question", 22, True), ("Status", "status", 15, False), ("Notes", "assessor_notes", 22, True), ("Flag", "requires_human_review", 8, False),
    ("Reasons", "review_reasons", 22, False), ("Conf.", "confidence", 7, False), ("Item ID", "item_id", 26, False), ("Req IDs", "requirement_id", 20, False), ("Tags", "domain_tags", 20, False),
)
GROUPS = (("Locate", 1, 3), ("Ask", 4, 5), ("Record", 6, 7), ("Verify", 8, 10), ("Trace", 11, 13))
STATES = ("not-started", "in-progress", "compliant", "non-compliant", "not-applicable")


def sheet_rows(items: DataFrame) -> list[tuple[list, bool]]:
    """(values, flagged) of each row of the workbook, one document's checklist. Fields
    that only an assessor fills are empty, the state is the first."""
    given = {"audit_question": "", "status": STATES[0], "assessor_notes": ""}
    items = items.withColumns({c: F.lit(v) for c, v in given.items() if c not in items.columns})
    out = []
    for r in csv_columns(items).toLocalIterator():
        flagged = bool(r["requires_human_review"])
        row = [r[f] for _, f, _, _ in SHEET]
        row[7], row[9] = "Yes" if flagged else "No", r["confidence"] or 0.0
        out.append((["" if v is None else v for v in row], flagged))
    return out


def to_xlsx(items: DataFrame, path: str) -> None:
    """A workbook of two header rows, frozen below them and after the first group, with
    a list of states to choose from, flagged rows tinted and confidence in per cent."""
    try:
        from openpyxl import Workbook
        from openpyxl.styles import Alignment, Font, PatternFill
        from openpyxl.utils import get_column_letter
        from openpyxl.worksheet.datavalidation import DataValidation
    except ImportError as e:
        raise RuntimeError("writing XLSX needs the optional library openpyxl") from e
    book = Workbook()
    sheet, last = book.active, get_column_letter(len(SHEET))
    sheet.title = "Checklist"
    bold, grey, amber = Font(bold=True, size=9), PatternFill("solid", fgColor="E2E8F0"), PatternFill("solid", fgColor="FFFBEB")
    rows = sheet_rows(items)
    for label, a, b in GROUPS:
        sheet.cell(1, a, label).alignment = Alignment(horizontal="center")
        sheet.merge_cells(start_row=1, end_row=1, start_column=a, end_column=b)
    for i, (heading, _, width, _) in enumerate(SHEET, 1):
        sheet.cell(2, i, heading)
        sheet.column_dimensions[get_column_letter(i)].width = width
    for row in sheet[f"A1:{last}2"]:
        for cell in row:
            cell.font, cell.fill = bold, grey
    for n, (values, flagged) in enumerate(rows, 3):
        for i, v in enumerate(values, 1):
            cell = sheet.cell(n, i, v)
            cell.alignment = Alignment(vertical="top", wrap_text=SHEET[i - 1][3])
            if flagged:
                cell.fill = amber
        sheet.cell(n, 10).number_format = "0%"
    choice = DataValidation(type="list", formula1=f'"{",".join(STATES)}"', allow_blank=True)
    sheet.add_data_validation(choice)
    if rows:
        choice.add(f"F3:F{len(rows) + 2}")
    sheet.freeze_panes, sheet.auto_filter.ref = "D3", f"A2:{last}{len(rows) + 2}"
    book.save(path)
