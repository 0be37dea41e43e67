"""All queries of the core by name, and the SQL that gives the same results."""

from __future__ import annotations

from . import audit, changes, dependencies, formats, nested, reference  # noqa: F401  audit and formats add their queries to those of reference

QUERIES = {
    "p3_found": nested.p3_found,
    "p4_found": changes.p4_found,
    "p5_found": dependencies.p5_found,
    "p5_hierarchy": dependencies.p5_hierarchy,
    **reference.QUERIES,
}

SQL = {"p3_found": nested.P3_SQL, "p4_found": changes.P4_SQL, "p5_found": dependencies.P5_SQL, "p5_hierarchy": dependencies.P5_HIERARCHY_SQL, **reference.SQL}
