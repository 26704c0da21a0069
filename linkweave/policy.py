"""Settings of the evidence engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass

#: Columns that name a build environment, without the optimisation level.
ENV = ("lua_version", "architecture", "strip_mode")


@dataclass(frozen=True)
class Policy:
    # Weights of the score and thresholds of the decision.
    primary_bonus: float = 0.04
    auxiliary_bonus: float = 0.015
    missing_penalty: float = 0.002
    #: For each anchor that a candidate both calls and is called by (an extension, off by default).
    mutual_bonus: float = 0.0
    primary_opt: str = "O0"
    strip_mode: str = "nostrip"
    lua_version: str = "Lua_547"
    accept_margin: float = 0.015
    min_primary_matches: int = 1
    max_tied_top_candidates: int = 1
    expansion_enabled: bool = True
    expansion_prior: float = 0.65
    expansion_limit: int = 80
    #: An anchor with more edges than this on its side is a hub, whose edges are not multiplied by its cases.
    hub_degree: int = 4096
    #: So is one with fewer edges that would be more rows than this when multiplied by its cases.
    hub_rows: int = 1 << 17
    exclude_prefixes: tuple[str, ...] = ()
    allow_visible_names: bool = False
    output_top_candidates: int = 5
    #: Pieces of evidence kept for a candidate; None keeps all.
    evidence_limit: int | None = 30
    #: Evidence for misses and for neighbours without an anchor is written too.
    full_evidence: bool = False
    #: Ties of all scores go to the larger name; else to the earlier candidate.
    larger_name_first: bool = True
    normalize_architecture: bool = True

    @classmethod
    def minimal(cls, **changes: object) -> Policy:
        """Scoring of one query graph, with neighbours known by id."""
        return cls(**({"evidence_limit": None, "full_evidence": True, "larger_name_first": False, "expansion_enabled": False, "normalize_architecture": False} | changes))

    @classmethod
    def hybrid(cls, **changes: object) -> Policy:
        """Evaluation with names that are still visible as anchors; expansion only if asked for."""
        return cls(**({"evidence_limit": 50, "larger_name_first": False, "expansion_enabled": False, "allow_visible_names": True} | changes))
