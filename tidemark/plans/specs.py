"""Parameters of the read-outs, checked when they are made."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from tidemark import fixed_values as fixed


def tiers_for(choice: str) -> list[str]:
    """'Beginner' is that tier alone; 'Beginner+' is that tier and all above."""
    names = [tier.split(" - ")[1] for tier in fixed.CREATOR_TIERS]
    wanted, upward = choice.removesuffix("+"), choice.endswith("+")
    if wanted not in names:
        raise ValueError(f"unknown creator tier: {choice!r}")
    start = names.index(wanted)
    return fixed.CREATOR_TIERS[start:] if upward else fixed.CREATOR_TIERS[start : start + 1]


def experiment_kind(kind: str) -> str:
    lowered = kind.lower()
    if lowered not in fixed.EXPERIMENT_KINDS:
        raise ValueError(f"unknown experiment kind {kind!r}; one of {fixed.EXPERIMENT_KINDS}")
    return lowered


@dataclass(frozen=True)
class LookBack:
    """Days before the run date, upper the farther end, both ends included."""

    upper: int
    lower: int = 0

    def __post_init__(self):
        if self.lower > self.upper:
            raise ValueError("look-back: the near end lies before the far end")


@dataclass(frozen=True)
class AudienceSpec:
    """Optional filters of an audience; None or False leaves a filter and its join out."""

    kind: str = "broadcast- recurring"
    locale: str = fixed.NOT_REQUIRED  # 'EN', 'not EN' or not required
    locale_prefix: str | None = None
    l7: tuple[str, int] | None = None
    l90: tuple[str, int] | None = None
    minimum_version: float | None = None
    device_type: str = fixed.NOT_REQUIRED
    age: tuple[int, int] | None = None
    creator_tier: str = fixed.NOT_REQUIRED
    subscriber: bool | None = None
    country_text: str | None = None
    region_text: str | None = None
    country_single: str | None = None  # a code, or 'All' for every named country
    country_multiple: tuple[str, ...] = field(default_factory=tuple)
    member: bool | None = None
    opened: LookBack | None = None
    clicked: LookBack | None = None
    bounced_days: int | None = None
    exclude_listed: bool = False
    exclude_pushed_not_viewed: bool = False
    usage_min_days: int | None = None
    hash_split: bool = False

    def __post_init__(self):
        if self.kind not in fixed.AUDIENCE_KINDS:
            raise ValueError(f"unknown audience kind {self.kind!r}; one of {fixed.AUDIENCE_KINDS}")
        if self.country_single and self.country_multiple:
            raise ValueError("give either one country or several, not both")
        if self.age and self.age[0] > self.age[1]:
            raise ValueError("age: the upper bound is smaller than the lower bound")
        if self.creator_tier != fixed.NOT_REQUIRED:
            tiers_for(self.creator_tier)

    @property
    def dated(self) -> bool:
        """One-time and email audiences keep one table per run date."""
        return self.kind != "broadcast- recurring"

    @property
    def needs_identity(self) -> bool:
        return (
            self.kind == "email"
            or self.minimum_version is not None
            or self.device_type != fixed.NOT_REQUIRED
            or self.age is not None
        )

    @property
    def needs_activity(self) -> bool:
        return self.l7 is not None or self.l90 is not None


@dataclass(frozen=True)
class CampaignSpec:
    """A quarter to report on and how many quarters to look back."""

    end_date: dt.date
    look_back_quarters: int

    @property
    def start_date(self) -> dt.date:
        months = self.end_date.year * 12 + self.end_date.month - 1 - 3 * self.look_back_quarters
        year, month = divmod(months, 12)
        following = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
        last_day = (following - dt.timedelta(days=1)).day
        return dt.date(year, month + 1, min(self.end_date.day, last_day))

    @property
    def quarter(self) -> str:
        return f"{self.end_date.year}Q{(self.end_date.month + 2) // 3}"

    def check(self, earliest: str | None = fixed.EARLIEST_CAMPAIGN_START) -> "CampaignSpec":
        if earliest and self.start_date < dt.date.fromisoformat(earliest):
            raise ValueError(f"no campaign data before {earliest}")
        if self.end_date.strftime("%m%d") not in fixed.QUARTER_ENDS:
            raise ValueError(f"{self.end_date} is no end of a quarter")
        return self
