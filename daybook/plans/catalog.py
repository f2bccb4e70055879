"""All registered queries of the library and their SQL, by section."""

from __future__ import annotations

from daybook.plans import claims, cohorts, coverage, evidence, evidence_graph, exposures, graphs, imports, inference, intervals, models, networks, operations, patterns, readers, rollups, scalars, significance, stats, texts, watchers

SECTIONS = (rollups, scalars, intervals, stats, graphs, cohorts, coverage, models, evidence, significance, evidence_graph, imports, texts, networks, exposures, readers, claims, inference, operations, patterns, watchers)


def _all() -> dict:
    found: dict = {}
    for section in SECTIONS:
        twice = found.keys() & section.REGISTRY.keys()
        if twice:
            raise ValueError(f"queries registered twice: {sorted(twice)}")
        found |= section.REGISTRY
    return found


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
