"""All registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from celldag.queries import builds, concepts, curation, dag, recipes, records, regions, relational

QUERIES: dict = {**dag.QUERIES, **relational.QUERIES, **builds.QUERIES, **regions.QUERIES, **curation.QUERIES, **records.QUERIES, **concepts.QUERIES, **recipes.QUERIES}
ORACLES: dict[str, str] = {**dag.ORACLES, **relational.ORACLES, **builds.ORACLES, **regions.ORACLES, **curation.ORACLES, **records.ORACLES, **concepts.ORACLES, **recipes.ORACLES}
