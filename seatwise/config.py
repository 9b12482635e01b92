"""All dates, horizons and weights of a churn run, in one place."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class ChurnConfig:
    """Parameters shared by every stage.

    ``categories`` is the feature vocabulary: the product categories that are both of interest and
    known to the taxonomy. The feature order is all session-time sums, then all session counts, each
    in sorted category order.
    """

    create_from: date
    create_to: date
    event_from: date
    event_to: date
    interest: tuple[str, ...]
    categories: tuple[str, ...]

    # They must be the same for results to be comparable.
    horizon_days: int = 365
    period_days: int = 30
    summed_days: int = 29
    n_periods: int = 13
    positive_weight: float = 50.0
    unassigned_member: str = "GUID_IS_NULL_FOR_THE_ROW"
    unknown_category: str = "NA"
    missing_value: int = -1

    # None: day 0 is the earliest creation date seen in the assigned usage.
    day_zero: date | None = None
    # True: an event that falls into several sessions of the same seat counts once.
    dedup_per_seat: bool = False
    # Width of the time buckets of the interval join.
    bucket_days: int = 30
    # Members with fewer events than this in a bucket are never split.
    hot_floor: int = 1_000_000

    def __post_init__(self) -> None:
        object.__setattr__(self, "categories", tuple(sorted(self.categories)))

    @property
    def n_months(self) -> int:
        """Feature months: month m is paired with the label of period m + 1."""
        return self.n_periods - 1

    @property
    def time_features(self) -> list[str]:
        return [f"time_{c}" for c in self.categories]

    @property
    def count_features(self) -> list[str]:
        return [f"count_{c}" for c in self.categories]

    @property
    def features(self) -> list[str]:
        return self.time_features + self.count_features

    @property
    def lifetime_features(self) -> list[str]:
        return [f"life_{f}" for f in self.features]
