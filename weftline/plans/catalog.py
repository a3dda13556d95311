"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from weftline.plans import capture_queries, core_queries, repair_queries, search_queries, source_queries, time_queries  # noqa: F401

QUERIES: dict = {
    **core_queries.QUERIES,
    "p4_found": time_queries.p4_found,
    "p4_normalised": time_queries.p4_normalised,
    "p4_instants": time_queries.p4_instants,
    "p4_choices": time_queries.p4_choices,
    "p4_open": time_queries.p4_open,
}
ORACLE_SQL: dict[str, str] = {**core_queries.ORACLE_SQL, "p4_found": time_queries.P4_FOUND_SQL, "p4_instants": time_queries.P4_INSTANTS_SQL}
