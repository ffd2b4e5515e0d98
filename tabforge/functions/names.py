"""Column-name functions (P2, P3).  Names are metadata: they are computed
on the driver and applied with one ``toDF``/``select``, no data moves."""

from __future__ import annotations

import re

_CAPITAL = re.compile(r"(?<!^)(?=[A-Z])")


def snake_name(name: str) -> str:
    """Drop spaces, put ``_`` before every capital except a leading one,
    lower-case.  ``"LAST NAME" -> "l_a_s_t_n_a_m_e"``, ``"travelCode" ->
    "travel_code"``, ``"  First Name  " -> "first_name"``."""
    return _CAPITAL.sub("_", name.replace(" ", "")).lower()


def sanitize_name(name: str) -> str:
    """Spaces to ``_``, lower-case (scoring-time name cleanup)."""
    return name.replace(" ", "_").lower()


def unique_or_raise(names: list[str]) -> list[str]:
    seen, dup = set(), []
    for n in names:
        if n in seen:
            dup.append(n)
        seen.add(n)
    if dup:
        raise ValueError(f"column names collide after renaming: {sorted(set(dup))}")
    return names
