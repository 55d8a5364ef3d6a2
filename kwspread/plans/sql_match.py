"""Keyword matching as DuckDB SQL for the oracles, written from its definition: the
dictionary as a list, filtered by containment."""

from __future__ import annotations

from collections.abc import Sequence


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found(text_sql: str, keywords: Sequence[str], ci: bool) -> str:
    listed = "[" + ", ".join(_quoted(k) for k in keywords if k) + "]::VARCHAR[]"
    test = f"contains(lower({text_sql}), lower(k))" if ci else f"contains({text_sql}, k)"
    return f"list_filter({listed}, lambda k: coalesce({test}, false))"


def sql_first_match(text_sql: str, keywords: Sequence[str], ci: bool = True) -> str:
    return f"(CASE WHEN {text_sql} <> '' THEN ({_found(text_sql, keywords, ci)})[1] END)"


def sql_all_matches(text_sql: str, keywords: Sequence[str], ci: bool = True, sep: str = ";") -> str:
    return f"coalesce(array_to_string({_found(text_sql, keywords, ci)}, {_quoted(sep)}), '')"


def sql_any_match(text_sql: str, keywords: Sequence[str], ci: bool = True) -> str:
    return f"(len({_found(text_sql, keywords, ci)}) > 0)"
