"""Tunable limits of the rules, as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    severity_medium_minor: int = 2_500_000
    severity_high_minor: int = 25_000_000
    severity_critical_minor: int = 100_000_000
    major_loss_minor: int = 50_000_000
    duplicate: float = 0.62
    duplicate_strong: float = 0.85
    policy_high: float = 0.80
    policy_candidate: float = 0.45
    low_confidence: float = 0.60
    cat_match: float = 0.55
    cat_radius_km: float = 250.0
    cat_tolerance_days: int = 2
    fraud_medium: float = 0.35
    fraud_high: float = 0.65
    policy_edge_days: int = 30
    policy_candidates: int = 200
    duplicate_candidates: int = 50
    policies_shown: int = 5


DEFAULT = Thresholds()
