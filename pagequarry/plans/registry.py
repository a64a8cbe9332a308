"""All queries of the library by name, with their DuckDB counterparts.

A plan module holds ``QUERIES`` (name -> function of spark and table folder) and ``ORACLES``
(name -> SQL); this module only puts them together.
"""

from __future__ import annotations

from . import analysis_queries, answer_queries, bilingual_queries, case_queries, curation_queries, evidence_queries, item_queries, page_queries, quality_queries, record_queries, repair_queries, source_queries, stream_queries, tcpool_queries, text_queries

MODULES = [analysis_queries, answer_queries, bilingual_queries, case_queries, tcpool_queries, page_queries, evidence_queries, curation_queries, quality_queries, repair_queries, stream_queries, record_queries, item_queries, text_queries, source_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
