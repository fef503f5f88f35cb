"""Put the CTEs a query names in front of it."""

from __future__ import annotations

import re

from oracle.model_tables import OPERATORS
from oracle.questions import QUESTIONS
from oracle.tables import CTES


def _needed(body: str) -> list[str]:
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name, cte in CTES.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                visit(cte)

    visit(body)
    return [name for name in CTES if name in wanted]


def with_tables(body: str) -> str:
    ctes = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in _needed(body))
    return f"WITH {ctes}\n{body.strip()}" if ctes else body.strip()


def statements() -> dict[str, str]:
    return {key: with_tables(body) for key, body in {**QUESTIONS, **OPERATORS}.items()}
