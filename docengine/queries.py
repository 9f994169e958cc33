"""Registry of the engine's own queries: name -> function, and their DuckDB equivalents."""

from docengine.plans import basic, compare, contexts, exact, findings, flow, geometry, package, sheets, tables

QUERIES: dict = {}
ORACLES: dict = {}
for _plan in (basic, compare, contexts, exact, package, findings, flow, geometry, sheets, tables):
    QUERIES |= _plan.Q
    ORACLES |= _plan.SQL
