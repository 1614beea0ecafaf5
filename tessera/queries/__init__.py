"""Queries over the driver's tables, each with the SQL that gives its rows where SQL can."""

from __future__ import annotations

from tessera.queries import calls, chain, dedup, facts, gates, inference, keys, more, pairs, panel, policy, sequence, states, text, vectors

MODULES = (text, keys, facts, panel, sequence, dedup, pairs, policy, inference, states, chain, more, vectors, calls, gates)

QUERIES = {name: fn for m in MODULES for name, (fn, _) in m.Q.items()}
SQL = {name: sql for m in MODULES for name, (_, sql) in m.Q.items() if sql}
