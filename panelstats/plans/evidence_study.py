"""Evidence register to inventory, direction counts, claim tables and local subset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from panelstats.operators import evidence


def evidence_tables(
    register: DataFrame,
    flags: Mapping[str, Column],
    subsets: Mapping[str, Column],
    outcomes: Sequence[str],
    claims: Mapping[str, Column],
    local: Column,
    local_columns: Sequence[str],
    study: Sequence[str] = ("study_id", "evidence_tier"),
) -> dict[str, DataFrame]:
    """The register is small and read per table; rules and flags come from the caller."""
    flagged = evidence.add_flags(register, flags)
    matrix = evidence.claim_matrix(register, study, claims)
    return {
        "inventory": evidence.inventory(flagged, list(flags), "total_studies"),
        "directions": evidence.directional_counts(flagged, subsets, outcomes),
        "claims": matrix,
        "claim_summary": evidence.claim_summary(matrix),
        "local": evidence.local_evidence(flagged, local, local_columns),
    }
