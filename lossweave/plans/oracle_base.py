"""DuckDB common table expressions that rebuild the bound inputs for the oracle queries."""

from __future__ import annotations

from ..config import DATE_SOURCE, NUMERIC_SOURCE
from .bindings import SNAPSHOT, TEST

_TEXT = [c for c in SNAPSHOT]


def _trim(c: str) -> str:
    core = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return rf"regexp_replace({core}, '\s+', '', 'g')" if c == "LoanStatus" else core


SNAP = (
    "snap as (select " + ", ".join(f"{sql} as {n}" for n, sql in SNAPSHOT.items())
    + " from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"
)
NORM = "norm as (select " + ", ".join(f"{_trim(c)} as {c}" for c in _TEXT) + " from snap)"
_PARSED = {c: f"cast(try_strptime({c}, '%Y-%m-%d') as date)" for c in DATE_SOURCE}
TYPED = (
    "typed0 as (select * replace ("
    + ", ".join([f"try_cast({c} as double) as {c}" for c in NUMERIC_SOURCE] + [f"{e} as {c}" for c, e in _PARSED.items()])
    + "), ("
    + " or ".join(f"({c} <> '' and {e} is null)" for c, e in _PARSED.items())
    + ") as invalid_date from norm), "
    "typed as (select *, FirstDisbursementDate as d, "
    "cast(FirstDisbursementDate + interval 12 month as date) as w from typed0)"
)
FLAG_SQL = {
    "wrong_program": "Program <> '7A'",
    "cancelled_or_committed": "LoanStatus in ('CANCLD', 'COMMIT')",
    "unknown_status": "LoanStatus not in ('PIF', 'CHGOFF', 'EXEMPT', 'CANCLD', 'COMMIT')",
    "missing_disbursement": "d is null",
    "incomplete_window": "coalesce(w > date '2001-12-31', false)",
    "invalid_approval_amount": "GrossApproval is null or GrossApproval <= 0",
    "unmapped_state": "cast(ProjectState as int) not between 0 and 23",
    "date_or_status_contradiction": "invalid_date or coalesce(d < ApprovalDate, false) or coalesce(ChargeOffDate < d, false) "
    "or coalesce(PaidInFullDate < d, false) or coalesce(greatest(ApprovalDate, d, PaidInFullDate, ChargeOffDate) > date '2001-12-31', false) "
    "or (LoanStatus = 'CHGOFF' and ChargeOffDate is null) or (LoanStatus <> 'CHGOFF' and ChargeOffDate is not null) "
    "or (LoanStatus <> 'PIF' and PaidInFullDate is not null)",
}
FLAGGED = "flagged as (select *, " + ", ".join(f"({e}) as {n}" for n, e in FLAG_SQL.items()) + " from typed)"
ELIGIBLE = (
    "elig0 as (select *, case when ChargeOffDate >= d and ChargeOffDate <= w then 1 else 0 end as Y, "
    "case when GrossApproval <> 0 then SBAGuaranteedApproval / GrossApproval end as share0, "
    r"regexp_replace(NaicsCode, '\.0$', '') as naics0, regexp_replace(FranchiseCode, '\.0$', '') as fran0, "
    "case when TermInMonths >= 0 then TermInMonths end as term0, case when JobsSupported >= 0 then JobsSupported end as jobs0 "
    "from flagged where not (" + " or ".join(FLAG_SQL) + ")), "
    "elig as (select * exclude (share0, naics0, fran0, term0, jobs0) replace ("
    "term0 as TermInMonths, jobs0 as JobsSupported, "
    "case when InitialInterestRate >= 0 then InitialInterestRate end as InitialInterestRate, "
    "coalesce(nullif(ProcessingMethod, ''), '__missing__') as ProcessingMethod, "
    "coalesce(nullif(BusinessType, ''), '__missing__') as BusinessType, "
    "coalesce(nullif(BusinessAge, ''), '__missing__') as BusinessAge), "
    "year(d) as year, case when year(d) in (1995, 1996) then 'train' when year(d) = 1997 and month(d) <= 6 then 'tune' "
    "when year(d) = 1997 then 'calibrate' when year(d) = 1998 then 'reference' when year(d) = 1999 then 'crisis' "
    "when year(d) = 2000 then 'oot' else 'outside_frozen_cohorts' end as role, "
    "ln(GrossApproval) as log_approval, case when share0 between 0 and 1 then share0 end as guarantee_share, "
    "ln(1 + jobs0) as log_jobs, year(d) - 1995 as year_trend, "
    "case when regexp_full_match(naics0, '[0-9]{6}') then left(naics0, 2) else '__missing__' end as naics2, "
    "case when RevolverStatus in ('N', '0') then 'term' when RevolverStatus in ('Y', '1') then 'revolving' else 'unknown' end as loan_type, "
    "case when fran0 = '' then 'missing' when fran0 in ('00000', '000000') then 'absent' else 'present' end as franchise, "
    "case when GrossApproval <= 20000 then '<=150k' when GrossApproval <= 40000 then '150k-350k' "
    "when GrossApproval <= 70000 then '350k-1m' else '>1m' end as size_band, "
    "case when BusinessAge ilike '%change of ownership%' then 'change_of_ownership' when BusinessAge = '' then 'missing' "
    "when BusinessAge ilike '%unanswered%' then 'unanswered' "
    "when regexp_matches(lower(BusinessAge), 'startup|new business|new, less|2 or less') then 'new' else 'existing' end as age_group, "
    "case when term0 is null then 'missing' when term0 >= 240 then '>=240_months' else '<240_months' end as maturity_group "
    "from elig0)"
)
SERIES = (
    "useries as (select cast(c_nationkey as varchar) as state, cast(year(o_orderdate) * 12 + month(o_orderdate) - 1 as int) as month, "
    "cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) / (count(*) * 5000000e0) as u "
    "from orders join customer on o_custkey = c_custkey group by 1, 2), "
    "hseries as (select cast(c_nationkey as varchar) as state, cast(year(l_shipdate) as int) as year, cast(quarter(l_shipdate) as int) as q, "
    "cast(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 as int) as quarter, "
    "cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) / (count(*) * 100000e0) as hpi "
    "from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2, 3, 4)"
)
# gaps are filled by self-joins on the period index, independent of the engine's window frames
PANEL = (
    "grid as (select state, unnest(range(min(month), max(month) + 1)) as month from useries group by state), "
    "panel as (select g.state as ProjectState, cast(g.month as int) as month, a.u as u0, b.u - a.u as du, "
    "case when p.n = 13 then p.top - a.u end as peak_du, 100 * ln(h1.hpi / h0.hpi) as h0, 100 * ln(h2.hpi / h1.hpi) as dh, "
    "h0.hpi is not null and c.n = 5 as macro_complete "
    "from grid g left join useries a on a.state = g.state and a.month = g.month "
    "left join useries b on b.state = g.state and b.month = g.month + 12 "
    "left join (select x.state, x.month, count(y.u) as n, max(y.u) as top from grid x join useries y on x.state = y.state "
    "and y.month between x.month and x.month + 12 group by 1, 2) p on p.state = g.state and p.month = g.month "
    "left join hseries h1 on h1.state = g.state and h1.quarter = g.month // 3 "
    "left join hseries h0 on h0.state = g.state and h0.quarter = g.month // 3 - 4 "
    "left join hseries h2 on h2.state = g.state and h2.quarter = g.month // 3 + 4 "
    "left join (select x.state, x.month, count(*) as n from grid x join hseries y on x.state = y.state "
    "and y.quarter between x.month // 3 and x.month // 3 + 4 and y.hpi > 0 group by 1, 2) c on c.state = g.state and c.month = g.month)"
)
SCENARIO = (
    "growth as (select a.state, a.quarter, 100 * ln(a.hpi / b.hpi) as g from hseries a join hseries b on a.state = b.state and b.quarter = a.quarter - 4), "
    f"scen0 as (select s.state, avg(u) filter (month between {1996 * 12} and {1999 * 12 - 1}) as ub, "
    f"max(u) filter (month = {1999 * 12}) as u1, max(u) filter (month = {2000 * 12}) as u2, "
    f"max(u) filter (month between {1999 * 12} and {2000 * 12}) as top, count(u) filter (month between {1999 * 12} and {2000 * 12}) as n "
    "from useries s group by 1), "
    f"scen1 as (select state, avg(g) filter (quarter between {1996 * 4} and {1999 * 4 - 1}) as gb, "
    f"max(g) filter (quarter = {1999 * 4}) as g1, max(g) filter (quarter = {2000 * 4}) as g2 from growth group by 1), "
    "scenario as (select state as ProjectState, 'baseline' as scenario, ub as u0, 0.0::double as du, 0.0::double as peak_du, gb as h0, gb * 1 as dh "
    "from scen0 join scen1 using (state) union all "
    "select state, 'adverse', u1, u2 - u1, case when n = 13 then top - u1 end, g1, g2 from scen0 join scen1 using (state))"
)
MATCHED = (
    "matched as (select e.*, cast(year(d) * 12 + month(d) - 1 as int) as month, p.u0, p.du, p.peak_du, p.h0, p.dh, coalesce(p.macro_complete, false) as macro_complete "
    "from elig e left join panel p on p.ProjectState = e.ProjectState and p.month = year(e.d) * 12 + month(e.d) - 1)"
)
# fixed scorecard coefficients used wherever a score is needed
SCORED = (
    "scored as (select *, round(1 / (1 + exp(-(-1.5e0 + 0.9e0 * coalesce(guarantee_share, 0.5e0) - 0.12e0 * coalesce(InitialInterestRate, 4e0) "
    "+ 0.25e0 * (log_approval - 10) + 0.1e0 * coalesce(log_jobs, 3e0)))), 6) as p from elig)"
)
_ORDER = [
    ("snap", SNAP, ()), ("norm", NORM, ("snap",)), ("typed", TYPED, ("norm",)), ("flagged", FLAGGED, ("typed",)),
    ("elig", ELIGIBLE, ("flagged",)), ("series", SERIES, ()), ("panel", PANEL, ("series",)),
    ("scenario", SCENARIO, ("series",)), ("matched", MATCHED, ("elig", "panel")), ("scored", SCORED, ("elig",)),
]


def with_tables(*names: str) -> str:
    """``with`` clause holding the named tables and all they depend on."""
    need = set(names)
    for name, _, deps in reversed(_ORDER):
        if name in need:
            need.update(deps)
    return "with " + ", ".join(sql for name, sql, _ in _ORDER if name in need) + " "


assert TEST.horizon_months == 12
