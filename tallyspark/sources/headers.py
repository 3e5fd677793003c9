"""Header rows of sheets: which row it is, what its columns are called and which fields they stand for."""

from __future__ import annotations

import re

from ..operators.mapping import heuristic_mapping
from ..plans.prompt import plain

# Words that header rows hold.
HEADER_WORDS = ("tarih", "date", "islem", "aciklama", "description", "borc", "debit", "alacak", "credit", "gelir", "income", "gider", "expense", "tutar", "amount", "miktar", "kategori", "category", "bakiye", "balance", "firma", "cari", "hesap")
#: Kinds of cells that are no text to a header.
NUMERIC = ("number", "percent", "boolean")


def _text(cell) -> str | None:
    return cell.text if hasattr(cell, "kind") else cell


def header_score(cells: list) -> float:
    """How much a row of cells, or of their texts, looks like a header: known words count most, then text and filled cells; repeats count against."""
    filled = [c for c in cells if c and _text(c)]
    if not filled:
        return -100.0
    names = [plain(_text(c)) for c in filled]
    words = sum(w == n or w in n.split() for n in names for w in HEADER_WORDS)
    texts = sum(getattr(c, "kind", "") not in NUMERIC and not re.fullmatch(r"[-+]?\d+([.,]\d+)?", _text(c)) for c in filled)
    return 5 * words + 1.5 * texts + len(filled) - (len(filled) - len(set(names)))


def header_at(rows: list[list]) -> int:
    """The best header among the first rows, the first of equals."""
    return max(range(len(rows)), key=lambda k: (header_score(rows[k]), -k))


def unique_names(cells: list) -> list[str]:
    """Column names: blanks numbered, repeats suffixed."""
    out: list[str] = []
    taken: set[str] = set()
    for k, c in enumerate(cells, 1):
        text = _text(c) if c else None
        text = re.sub(r"\s+", " ", text).strip() if text else None
        name = base = text if text and not text.lower().startswith("unnamed") else f"column_{k}"
        n = 1
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        out.append(name)
    return out


def columns_of(names: list[str], fields: list[str]) -> dict[str, str]:
    """The column that stands for each field, by its name; ``*`` takes every column under its own name."""
    if fields == ["*"]:
        return {n: n for n in names}
    return {f: rule.columns[0] for f, rule in heuristic_mapping(names, fields).items() if rule.kind == "column"}
