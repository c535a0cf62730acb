"""Assembly of one statement from named common table expressions."""

from __future__ import annotations

import re


def statement(ctes: dict[str, str], body: str) -> str:
    """The body with every table expression it reaches, in the order they are defined."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in words & ctes.keys() - needed:
            needed.add(name)
            pending.append(ctes[name])
    parts = [f"{name} AS ({sql.strip()})" for name, sql in ctes.items() if name in needed]
    return f"WITH {', '.join(parts)} {body.strip()}" if parts else body.strip()


def rounded(columns: str, digits: int = 4) -> str:
    """`a b` to the select items that round each column under its own name."""
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())
