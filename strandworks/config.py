"""Options of the programs, with the defaults that define behaviour."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class KmerOptions:
    k: int = 23
    min_quality: int = 3
    min_weight: float = 0.10  # observations at or below are dropped
    min_depth: int = 2
    subsample: int = 1
    extension_quality: int = 20


@dataclass(frozen=True)
class VariantOptions:
    sigmas: float = -1.0  # below 0: off
    strong_weight: float = 512.0
    edit_distance: int = 2
    distance_factor: float = 20.0


@dataclass(frozen=True)
class SelectOptions:
    scoring: str = "MAX"  # MAX, MIN, MEDIAN, AVG, SUM
    min_length: float = 0.40  # up to 1: share of the read; above: bases
    min_score: float = 2.0
    min_passing_in_pair: int = 1


@dataclass(frozen=True)
class ArtifactOptions:
    match_length: int = 24
    edit_distance: int = 2
    stride: int = 4


@dataclass(frozen=True)
class DedupOptions:
    mode: int = 1  # 2: both orders of a pair are one fragment
    length: int = 24
    offset: int = 0
    consensus: bool = True
    edit_distance: int = 0
    single: bool = False  # also unpaired reads, by their own starts


@dataclass(frozen=True)
class MatchOptions:
    max_read_matches: int = 450  # of a contig, by hash order
    include_mate: bool = True
    min_overlap: int = 51
    min_identity: float = 0.986
    overlap_only: bool = True
    max_from_edge: int = 500


@dataclass(frozen=True)
class ExtendOptions:
    min_consensus: float = 0.85
    min_coverage: float = 4.8
    max_delta: float = 0.33
    max_steps: int = 50
    max_contig: int = 3000
    max_iterations: int = 1000
