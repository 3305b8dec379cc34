"""Scores as column expressions, 0 to 100. A factor is null where it has no data; ``combine`` then leaves it out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake.functions.columns import bucket

# Weights of the win factors and steps of the ladders.
WIN_WEIGHTS = {"set_aside": 0.16, "experience": 0.18, "competition": 0.13, "incumbent": 0.13, "teaming": 0.10, "time": 0.10, "value_fit": 0.10, "size": 0.10}
WIN_LEVELS = ((70, "High"), (40, "Medium"), (15, "Low"))
PURSUIT_LEVELS = ((75, "MustPursue"), (50, "ShouldPursue"), (30, "Consider"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def experience(n: Column, years_since: Column, same_agency: Column, same_value: Column) -> Column:
    """By awards in the category: their number, faded by the years since the last, plus 10 for the agency and 5 for the size."""
    recency = F.when(years_since <= 2, 1.0).when(years_since <= 5, 0.5).otherwise(0.25)
    got = F.least(F.lit(100.0), 20.0 + 16.0 * n) * recency + 10.0 * same_agency.cast("int") + 5.0 * same_value.cast("int")
    return F.when(F.coalesce(n, F.lit(0)) == 0, 10.0).otherwise(clamp(got, 10, 100))


def competition(pct_with_more: Column, n_vendors: Column) -> Column:
    """The share of categories with more vendors; where it isn't known, a decay by the number of vendors."""
    return F.coalesce(clamp(pct_with_more, 5, 95), clamp(100.0 * F.exp(-0.15 * (n_vendors - 1)), 10, 100))


def teaming(n_partners: Column) -> Column:
    return F.when(n_partners >= 3, 100.0).when(n_partners >= 1, 60.0).when(n_partners.isNotNull(), 30.0)


def time_left(days: Column) -> Column:
    return clamp(days / 45.0 * 100.0, 0, 100)


def value_fit(ratio: Column) -> Column:
    """Full up to a ratio of 1, then an exponential decay."""
    return F.when(ratio.isNotNull(), clamp(100.0 * F.exp(-0.5 * F.greatest(F.lit(0.0), ratio - 1.0)), 10, 100))


def size_headroom(headroom_pct: Column) -> Column:
    return clamp(70.0 + 0.6 * headroom_pct, 70, 100)


def combine(factors: dict[str, Column], weights: dict[str, float] = WIN_WEIGHTS, places: int = 2) -> Column:
    """Weighted mean over the factors that have data; null if none has."""
    have = [(c, w) for k, w in weights.items() if (c := factors.get(k)) is not None]
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in have), F.lit(0.0))
    weight = sum((c.isNotNull().cast("double") * w for c, w in have), F.lit(0.0))
    return F.when(weight > 0, F.round(total / weight, places))


def win_level(score: Column) -> Column:
    return F.coalesce(bucket(score, WIN_LEVELS, "VeryLow"), F.lit("InsufficientData"))


def data_confidence(factors: Sequence[Column]) -> Column:
    n = sum((c.isNotNull().cast("int") for c in factors), F.lit(0))
    return F.when(n >= 6, "High").when(n >= 4, "Medium").otherwise("Low")


def pursuit(win: Column, quality: Column, low_confidence: Column) -> Column:
    """0.6 of the win score and 0.4 of the opportunity's; a missing one counts 0; 15 % off where a confidence is low."""
    both = F.coalesce(win, F.lit(0.0)) * 0.6 + F.coalesce(quality, F.lit(0.0)) * 0.4
    return F.round(F.when(low_confidence, both * 0.85).otherwise(both), 1)


def pursuit_quadrant(win: Column, quality: Column) -> Column:
    side = lambda c, name: F.concat(F.when(F.coalesce(c, F.lit(0.0)) >= 50, "High").otherwise("Low"), F.lit(name))
    return F.concat_ws("_", side(win, "PWin"), side(quality, "OQS"))


def pursuit_category(score: Column) -> Column:
    return bucket(score, PURSUIT_LEVELS, "Skip")


# Weights and points of the opportunity score and of go or no-go.
OPPORTUNITY_WEIGHTS = {"profile": 0.20, "value": 0.15, "competition": 0.10, "timeline": 0.15, "reuse": 0.10, "growth": 0.15, "recompete": 0.15}
SET_ASIDE_POINTS = {"WOSB": 10, "EDWOSB": 10, "WOSBSS": 10, "EDWOSBSS": 10, "8A": 8, "8AN": 8, "SBA": 5, "SBP": 5, "HZC": 5, "HZS": 5, "SDVOSBC": 5, "SDVOSBS": 5}
PROFILE_POINTS = {"primary": (100, 80), "secondary": (60, 30), "linked": (60, 30), "associated": (50, 30)}


def set_aside_match(code: Column, held: Column, required: dict[str, Sequence[str]]) -> Column:
    """100 with a certificate that the code requires, 50 with one that any code requires, else 0; null for no code and for unknown ones."""
    every = F.array(*map(F.lit, sorted({x for some in required.values() for x in some})))
    exact = F.coalesce(*[F.when(code == k, F.arrays_overlap(held, F.array(*map(F.lit, some)))) for k, some in required.items()])
    return F.when(exact, 100.0).when(~exact & F.arrays_overlap(held, every), 50.0).when(exact.isNotNull(), 0.0)


def incumbent(own: Column, known: Column, signals: Column, named: Column, recompete: Column) -> Column:
    """Own incumbent 100; another one 20, or 30 and 10 for each sign of weakness up to 65; a bare name 30; a recompete without a name 50; else null."""
    return F.when(own, 100.0).when(known & (signals > 0), F.least(F.lit(65.0), 30.0 + 10.0 * signals)).when(known, 20.0).when(named, 30.0).when(recompete, 50.0)


def size_eligibility(set_aside: Column, outsized: Column, headroom_pct: Column) -> Column:
    """Over the limit of a set-aside -100, within it 70 to 100 by the room left; without set-aside 45 or 60. Null if it cannot be told."""
    within = F.round(F.coalesce(size_headroom(headroom_pct), F.lit(70.0)), 1)
    return F.when(outsized & set_aside, -100.0).when(~outsized & set_aside, within).when(outsized, 45.0).when(~outsized, 60.0)


def profile_match(tier: Column, certified: Column, any_certificate: Column) -> Column:
    """By how the category is held and whether the certificate that is asked for is; a primary one without any certificate at all counts 0."""
    out = F.when(certified, 60.0).otherwise(30.0)
    for name, (good, poor) in PROFILE_POINTS.items():
        out = F.when(tier == name, F.when(certified, float(good)).when(F.lit(name == "primary") & ~any_certificate, 0.0).otherwise(float(poor))).otherwise(out)
    return F.when(tier.isNull(), 0.0).otherwise(out)


def value_alignment(value: Column, usual: Column) -> Column:
    """By the ratio to the usual value: twice or half 100, four times 70, ten times 40, beyond 20."""
    off = F.greatest(value / usual, usual / value)
    return F.when((value > 0) & (usual > 0), F.when(off <= 2, 100.0).when(off <= 4, 70.0).when(off <= 10, 40.0).otherwise(20.0))


def few_vendors(n: Column) -> Column:
    return F.when(n > 3, F.floor(F.greatest(F.lit(10.0), 100.0 * F.exp(-0.15 * (n - 1)))).cast("double")).when(n > 0, 100.0)


def timeline(days: Column) -> Column:
    return F.when(days <= 0, 0.0).otherwise(F.least(F.lit(100.0), F.bround(days / 45.0 * 100.0, 0)))


def reuse(same_category: Column, same_agency: Column, any_record: Column) -> Column:
    return F.when(any_record, F.when(same_category & same_agency, 100.0).when(same_category, 60.0).when(same_agency, 40.0).otherwise(10.0))


def growth(known_category: Column, known_agency: Column, any_award: Column) -> Column:
    """New agency 80, new category 60, known market 20."""
    return F.when(any_award, F.when(~known_agency, 80.0).when(~known_category, 60.0).otherwise(20.0))


def recompete_advantage(recompete: Column, incumbent_known: Column) -> Column:
    return F.when(~recompete, 60.0).when(incumbent_known, 50.0)


def opportunity_score(factors: dict[str, Column]) -> Column:
    return combine(factors, OPPORTUNITY_WEIGHTS, 1)


def go_no_go_points(set_aside: Column, days_left: Column, category_match: Column, value: Column) -> dict[str, Column]:
    """Four factors of 0 to 10 points, and their percentage of 40."""
    code = F.upper(F.trim(set_aside))
    favour = F.coalesce(*[F.when(code == k, v) for k, v in SET_ASIDE_POINTS.items()], F.lit(0))
    time = F.when(days_left.isNull(), 5).when(days_left < 0, 0).when(days_left < 7, 1).when(days_left < 14, 4).when(days_left <= 30, 7).otherwise(10)
    size = F.when(value.isNull(), 3).when(value >= 1_000_000, 10).when(value >= 500_000, 8).when(value >= 100_000, 6).when(value >= 50_000, 4).otherwise(2)
    match = F.when(category_match, 10).otherwise(0)
    return {"set_aside": favour, "time": time, "category": match, "value": size, "percent": F.bround((favour + time + match + size) / 40.0 * 100.0, 1)}


# Weights and ladders of competitor strength, incumbent vulnerability and open door.
STRENGTH_WEIGHTS = {"revenue": 0.25, "penetration": 0.20, "certificates": 0.20, "retention": 0.15, "concentration": 0.20}
VULNERABILITY_WEIGHTS = {"age": 0.15, "options": 0.25, "spend": 0.15, "registration": 0.15, "turnover": 0.15, "offers": 0.15}
OPEN_DOOR_WEIGHTS = {"small_share": 0.25, "diversity": 0.15, "size": 0.15, "retention": 0.15, "breadth": 0.15, "trend": 0.15}
VULNERABILITY_LEVELS = ((75, "HighlyVulnerable"), (50, "Vulnerable"), (25, "Stable"))
OPEN_DOOR_LEVELS = ((80, "Champion"), (60, "Engaged"), (40, "Minimal"))


def ladder(c: Column, steps: Sequence[tuple[float, float]], least: float, strict: bool = False) -> Column:
    """The points of the highest step that the value reaches (or passes, if ``strict``); null for null."""
    out = F.lit(float(least))
    for at, points in sorted(steps):
        out = F.when(c > at if strict else c >= at, float(points)).otherwise(out)
    return F.when(c.isNotNull(), out)


def revenue_strength(value: Column) -> Column:
    """Thirteen points for each power of ten, full from 50 million on; 0 without revenue."""
    return F.when(value >= 50_000_000, 100.0).when(value > 0, F.floor(F.least(F.lit(100.0), 13.0 * F.log10(value + 1))).cast("double")).otherwise(0.0)


def agency_penetration(agencies: Column, knows_this: Column) -> Column:
    """Ten points an agency, ten more for the one that asks; 0 without any."""
    return F.when(agencies > 0, F.least(F.lit(100.0), clamp(10.0 * agencies, 10, 100) + F.when(knows_this, 10.0).otherwise(0.0))).otherwise(0.0)


def certificate_strength(kinds: Column, holds_asked: Column) -> Column:
    return F.when(kinds > 0, F.least(F.lit(100.0), 20.0 * kinds + F.when(holds_asked, 20.0).otherwise(0.0))).otherwise(0.0)


def retention_strength(retained_pct: Column, partners: Column) -> Column:
    got = ladder(retained_pct, [(80, 90), (60, 70), (40, 50)], 30)
    return F.coalesce(F.least(F.lit(100.0), got + F.when(partners >= 3, 10.0).otherwise(0.0)), F.lit(0.0))


def concentration_strength(share_pct: Column, awards: Column) -> Column:
    got = ladder(share_pct, [(50, 90), (30, 70), (10, 50)], 30, strict=True)
    return F.coalesce(F.least(F.lit(100.0), got + F.when(awards >= 10, 10.0).when(awards >= 5, 5.0).otherwise(0.0)), F.lit(0.0))


def total_points(factors: dict[str, Column], weights: dict[str, float], places: int = 0) -> Column:
    """Weighted points; a factor without data counts 0."""
    return F.bround(sum((F.coalesce(c, F.lit(0.0)) * weights[k] for k, c in factors.items()), F.lit(0.0)), places)


def contract_age(years: Column) -> Column:
    return F.floor(clamp(10.0 + 15.0 * years, 10, 100)).cast("double")


def options_left(exercised_to_expected: Column) -> Column:
    """Few options exercised for the time that has passed is a sign of weakness."""
    return F.when(exercised_to_expected < 0.5, 90.0).when(exercised_to_expected < 0.8, 60.0).when(exercised_to_expected.isNotNull(), 30.0)


def spend_anomaly(spent_to_expected: Column) -> Column:
    return F.when(spent_to_expected < 0.5, 80.0).when(spent_to_expected > 1.2, 70.0).when(spent_to_expected.isNotNull(), 20.0)


def vendor_turnover(vendors: Column, contracts: Column) -> Column:
    """Share of different vendors among an office's contracts."""
    return F.when(contracts > 0, F.floor(clamp(100.0 * vendors / contracts, 10, 100)).cast("double"))


def offer_pressure(offers: Column) -> Column:
    return clamp(10.0 + 18.0 * offers, 10, 100)


def open_door_factors(small_pct: Column, subs: Column, mean_size: Column, returning_pct: Column, categories: Column, growth_pct: Column) -> dict[str, Column]:
    return {
        "small_share": F.when(small_pct > 50, 100.0).otherwise(ladder(small_pct, [(30, 75), (15, 50), (5, 30)], 10)), "diversity": F.when(subs > 0, clamp(5.0 * subs, 10, 100)),
        "size": ladder(mean_size, [(100_000, 100), (50_000, 80), (25_000, 60), (10_000, 40)], 20), "retention": ladder(returning_pct, [(60, 100), (40, 70), (20, 40)], 20),
        "breadth": F.when(categories > 0, clamp(20.0 * categories, 10, 100)), "trend": F.coalesce(ladder(growth_pct, [(20, 100), (-20, 60)], 20), F.lit(50.0)),
    }
