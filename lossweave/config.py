"""Study protocol: every horizon, date range and threshold is a parameter, never a literal in an operator."""

from __future__ import annotations

from dataclasses import dataclass

# Names and codes of the loan snapshot.
SOURCE_COLUMNS = (
    "AsOfDate", "Program", "GrossApproval", "SBAGuaranteedApproval", "ApprovalDate",
    "FirstDisbursementDate", "ProcessingMethod", "InitialInterestRate",
    "FixedorVariableInterestInd", "TermInMonths", "NaicsCode", "FranchiseCode",
    "ProjectState", "BusinessType", "BusinessAge", "LoanStatus", "PaidInFullDate",
    "ChargeOffDate", "GrossChargeOffAmount", "RevolverStatus", "JobsSupported",
)
NUMERIC_SOURCE = (
    "GrossApproval", "SBAGuaranteedApproval", "InitialInterestRate",
    "TermInMonths", "JobsSupported", "GrossChargeOffAmount",
)
DATE_SOURCE = ("ApprovalDate", "FirstDisbursementDate", "PaidInFullDate", "ChargeOffDate")
CATEGORICAL = (
    "ProcessingMethod", "FixedorVariableInterestInd", "naics2", "BusinessType",
    "BusinessAge", "franchise", "loan_type", "ProjectState",
)
NUMERIC = ("log_approval", "guarantee_share", "InitialInterestRate", "log_jobs")
MACRO = ("u0", "du", "h0", "dh")
ALLOWED_PREDICTORS = NUMERIC + CATEGORICAL + ("TermInMonths",) + MACRO + ("peak_du", "year_trend")
LEGAL_STATUS = ("PIF", "CHGOFF", "EXEMPT", "CANCLD", "COMMIT")
LOAN_TYPES = ("term", "revolving", "unknown")
GROUP_KEYS = ("loan_type", "size_band", "naics2", "age_group", "maturity_group")
MISSING = "__missing__"
UNSEEN = "__unseen__"
POOLED = "Other"
NOT_FITTED = "__unseen_not_fitted__"


@dataclass(frozen=True)
class DateRange:
    """A closed range of origin dates with the labels it carries."""

    name: str
    start: str
    end: str
    layer: str = ""


@dataclass(frozen=True)
class Protocol:
    snapshot: str = "2026-06-30"
    program: str = "7A"
    horizon_months: int = 36
    states: tuple[str, ...] = ()
    roles: tuple[DateRange, ...] = (
        DateRange("train", "1991-01-01", "2002-12-31"),
        DateRange("tune", "2003-01-01", "2003-06-30"),
        DateRange("calibrate", "2003-07-01", "2003-12-31"),
        DateRange("buffer", "2004-01-01", "2005-12-31"),
        DateRange("reference", "2006-01-01", "2006-12-31"),
        DateRange("crisis", "2007-01-01", "2009-12-31"),
        DateRange("oot", "2011-01-01", "2013-12-31"),
    )
    outside_role: str = "outside_frozen_cohorts"
    cohorts: tuple[DateRange, ...] = (
        DateRange("estimation", "1991-01-01", "2002-12-31", "layer1"),
        DateRange("crisis", "2007-01-01", "2009-12-31", "layer1"),
        DateRange("oot", "2011-01-01", "2013-12-31", "layer1"),
        DateRange("estimation", "1991-01-01", "2009-12-31", "layer2"),
        DateRange("reference", "2006-01-01", "2006-12-31", "layer2"),
        DateRange("oot", "2011-01-01", "2013-12-31", "layer2"),
    )
    size_cuts: tuple[float, ...] = (150_000.0, 350_000.0, 1_000_000.0)
    size_labels: tuple[str, ...] = ("<=150k", "150k-350k", "350k-1m", ">1m")
    long_maturity_months: int = 240
    trend_origin_year: int = 2000
    downturn_years: tuple[int, ...] = (1991, 2000, 2001)
    severity_minimum: int = 50
    pooling_threshold: float = 0.001
    pooling_exempt: tuple[str, ...] = ("ProjectState",)
    baseline_first_year: int = 2004
    baseline_years: int = 3
    adverse_start: tuple[int, int] = (2007, 1)
    accept_fraction: float = 0.70
    quantile_cells: int = 10
    draws: int = 999
    refit_attempts: int = 199
    seed: int = 20261008

    @property
    def horizon_quarters(self) -> int:
        return self.horizon_months // 3

    @property
    def adverse_month(self) -> int:
        return self.adverse_start[0] * 12 + self.adverse_start[1] - 1

    def role(self, name: str) -> DateRange:
        return next(r for r in self.roles if r.name == name)
