"""Parameters of the moderation operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Thresholds; times are in the unit that the name ends with."""

    confidence_threshold: float = 0.70
    offender_window_days: int = 30
    offender_max: int = 2
    batch_size: int = 20
    retry_max: int = 3
    retry_minutes: int = 5
    failures_before_alert: int = 5
    deadline_hours: int = 24
    lock_days: int = 7
    violation_threshold: int = 20
    counter_cap: int = 255
    dominance_share: float = 0.70
    dominance_from: int = 10
    run_limit: int = 30
    emoji_run_limit: int = 8
    kept_run: int = 3
    emoji_limit: int = 10
    image_min_bytes: int = 10 * 1024
    image_max_bytes: int = 5 * 1024 * 1024
    dark_below: float = 20.0
    flat_below: float = 10.0
    blur_below: float = 1.0
    indicator_score: float = 0.50
    violation_score: float = 0.60
    toy_score: float = 0.60
    intent_pass: float = 0.55
    anchor_weight: float = 1.3
    category_bonus: float = 0.8
    article_min: int = 3000
    article_max: int = 10_000
    reuse_seconds: int = 300


DEFAULT = Settings()

# The statuses and decisions that rows carry.
STATUSES = ("Pending", "Processing", "Approved", "Rejected", "ManualReview", "Failed")
DECISIONS = ("APPROVED", "MANUAL_REVIEW", "REJECTED")  # in order of severity
STATUS_OF = {"APPROVED": "Approved", "REJECTED": "Rejected", "MANUAL_REVIEW": "ManualReview"}
STAFF_ROLES = (2, 3)
