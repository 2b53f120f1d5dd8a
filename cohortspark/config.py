"""Study configuration: every date, label, cut and variable list the operators take as input."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta


@dataclass(frozen=True)
class Brand:
    """One treatment arm label with its own recruitment window."""

    name: str
    descr: str
    start: date
    end: date


@dataclass(frozen=True)
class StudyConfig:
    """Settings of one study. The defaults are those of the driver fixture."""

    index_date: date = date(1997, 1, 1)
    end_date: date = date(1997, 12, 31)
    brands: tuple[Brand, ...] = (
        Brand("pfizer", "BNT162b2", date(1997, 1, 1), date(1997, 12, 31)),
        Brand("az", "ChAdOx1", date(1997, 1, 1), date(1997, 12, 31)),
    )
    # age band label -> first day that band may be treated
    age_phases: tuple[tuple[str, date], ...] = (
        ("80+", date(1997, 1, 1)),
        ("70-79", date(1997, 2, 1)),
    )
    exact: tuple[str, ...] = ("region", "sex")
    caliper: tuple[tuple[str, int], ...] = (("age", 3),)
    cuts: tuple[int, ...] = (0, 3, 7, 14, 21, 28, 35, 70)
    threshold: int = 6
    #: People that treatment models are fitted on, and people without the outcome that outcome models see; None: all.
    ipw_sample: int | None = None
    nonoutcome_sample: int | None = None
    min_dose_gap: int = 17
    #: Matching rounds of a brand and days between the dates at which their controls are taken.
    n_rounds: int = 2
    round_gap: int = 14
    outcomes: tuple[tuple[str, str], ...] = (
        ("postest", "Positive test"),
        ("admitted", "Hospital admission"),
        ("death", "Any death"),
    )
    subgroups: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"all": ("all",), "ageband2": ("80+", "70-79")}
    )
    adjust_sequential: tuple[str, ...] = (
        "sev_obesity", "chronic_heart_disease", "chronic_kidney_disease", "diabetes",
        "chronic_liver_disease", "chronic_resp_disease", "chronic_neuro_disease",
        "immunosuppressed", "learndis", "sev_mental", "flu_vaccine",
    )

    @property
    def max_followup(self) -> int:
        return max(self.cuts)

    @property
    def study_days(self) -> int:
        return (self.end_date - self.index_date).days + 1

    def round_date(self, brand: str, number: int) -> date:
        """The day as of which the controls of a brand's matching round are taken; rounds count from 1."""
        return self.brand(brand).start + timedelta((number - 1) * self.round_gap)

    def brand(self, name: str) -> Brand:
        return next(b for b in self.brands if b.name == name)
