"""Column roles: which physical column plays which part in an event table.

Every operator takes a ``Roles`` so it can run on any event table, not only
one with the canonical column names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Roles:
    company: str = "company"
    location: str = "location"
    country: str = "country"
    industry: str = "industry"
    stage: str = "stage"
    date: str = "date"
    total: str = "total_laid_off"
    pct: str = "percentage_laid_off"
    funds: str = "funds_raised_millions"
    # Columns appended to every ordering that would otherwise tie, so ranks,
    # "first"/"last" rows and top-k cut-offs are deterministic.
    tie_break: tuple[str, ...] = ()

    def with_(self, **kw) -> "Roles":
        return replace(self, **kw)


DEFAULT = Roles()
