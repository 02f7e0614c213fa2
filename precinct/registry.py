"""Every registered query of the analytics operators, and the DuckDB SQL that checks it."""

from __future__ import annotations

from precinct.plans import base, cases, core, evaluation, models, network, space, streams, text

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (core, text, evaluation, models, space, network, cases, streams):
    QUERIES |= _module.R.queries
    ORACLE |= _module.R.oracle
__all__ = ["ORACLE", "QUERIES", "base"]
