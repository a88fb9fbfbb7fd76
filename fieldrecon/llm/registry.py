"""All queries of the subpackage with their SQL."""

from __future__ import annotations


def load():
    """(queries, oracles) of every operator here."""
    from fieldrecon.llm import (  # noqa: F401
        chat,
        common,
        decontamination,
        exact_dedup,
        hard_negatives,
        lm_scoring,
        mixing,
        near_dedup,
        packing,
        periodic_runs,
        quality_classifier,
        quality_rules,
        url_filter,
        warc,
    )

    return common.QUERIES, common.ORACLES
