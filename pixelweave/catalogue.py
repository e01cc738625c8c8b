"""Every registered query of the library's own operators, and its SQL form."""

from __future__ import annotations

from pixelweave.jobs import filtering, relational, workflows

_MODULES = (relational, filtering, workflows)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
