"""Texts from tables: field dictionaries, marked blocks, LaTeX, and audits of values still to be filled in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def dictionary(tables: dict[str, StructType], notes: dict[tuple[str, str], str] | None = None) -> str:
    """A Markdown dictionary of tables' fields: name, type, whether it may be null, and what is noted of it."""
    notes = notes or {}
    out = []
    for table, schema in sorted(tables.items()):
        out += [f"## {table}", "", "| field | type | nullable | note |", "|---|---|---|---|"]
        out += [f"| {f.name} | {f.dataType.simpleString()} | {'yes' if f.nullable else 'no'} | {notes.get((table, f.name), '')} |" for f in schema.fields]
        out.append("")
    return "\n".join(out)


def replaced_block(text: str, name: str, body: str) -> str:
    """text with what stands between <!-- name:begin --> and <!-- name:end --> replaced; an error without both marks."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    if text.count(begin) != 1 or text.count(end) != 1 or text.index(begin) > text.index(end):
        raise ValueError(f"no block {name}")
    return text[: text.index(begin) + len(begin)] + "\n" + body.strip("\n") + "\n" + text[text.index(end) :]


def latex_table(rows: list, columns: list[str], digits: int = 3) -> str:
    """A LaTeX tabular: thousands parted, floats with so many digits, nulls as dashes, special characters escaped."""
    def cell(v) -> str:
        if v is None or v != v:
            return "--"
        if isinstance(v, bool):
            return "yes" if v else "no"
        if isinstance(v, int):
            return f"{v:,}".replace(",", "{,}")
        if isinstance(v, float):
            return f"{v:.{digits}f}"
        return re.sub(r"([&%$#_{}])", r"\\\1", str(v))

    body = [" & ".join(cell(r[c]) for c in columns) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", r"\toprule", " & ".join(map(cell, columns)) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])


def pending(text: str, pattern: str = r"\bTBD\b|\?\?\?|XX+") -> list[tuple[int, str]]:
    """(line, what) for each value of a text that is still a placeholder."""
    return [(n, m[0]) for n, line in enumerate(text.splitlines(), 1) for m in re.finditer(pattern, line)]


def section(title: str, df: DataFrame, most: int = 1000) -> str:
    """A section of a report with a table of at most so many rows; says how many more there are."""
    from .summary import markdown

    rows = df.limit(most + 1).collect()
    more = "" if len(rows) <= most else f"\n\nOnly the first {most} rows are shown."
    return f"## {title}\n\n{markdown(rows[:most], df.columns)}{more}\n"
