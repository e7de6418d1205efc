"""Fuzzy memberships, S-curves, and control rules written as text and compiled to column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def triangular(x: Column, a: float, b: float, c: float) -> Column:
    up = F.lit(1.0) if a == b else (x - a) / (b - a)
    down = F.lit(1.0) if b == c else (c - x) / (c - b)
    return F.when((x < a) | (x > c), 0.0).when(x <= b, up).otherwise(down)


def trapezoidal(x: Column, a: float, b: float, c: float, d: float) -> Column:
    up = F.lit(1.0) if a == b else (x - a) / (b - a)
    down = F.lit(1.0) if c == d else (d - x) / (d - c)
    return F.when((x < a) | (x > d), 0.0).when(x <= b, up).when(x < c, 1.0).otherwise(down)


# fixed values: corners of the three levels
LEVELS: dict[str, Callable[[Column], Column]] = {
    "low": lambda x: trapezoidal(x, 0.0, 0.0, 0.20, 0.40),
    "medium": lambda x: triangular(x, 0.20, 0.50, 0.80),
    "high": lambda x: trapezoidal(x, 0.60, 0.80, 1.0, 1.0),
}


def smoothstep(x: Column, lower: Column | float, upper: Column | float) -> Column:
    """S-curve from 0 at ``lower`` to 1 at ``upper``."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lower, upper))
    t = clamp((x - lo) / (hi - lo))
    return F.when(hi <= lo, (x >= lo).cast("double")).otherwise(t * t * (3.0 - 2.0 * t))


def gap_potential(gap: Column) -> Column:
    """1 at no gap to the best, falling in three pieces to 0 at a gap of 20 %."""
    g = F.greatest(F.lit(0.0), gap)
    return (
        F.when(g <= 0.03, 1.0 - 0.10 * g / 0.03)
        .when(g <= 0.08, 0.90 - 0.40 * (g - 0.03) / 0.05)
        .otherwise(clamp(0.50 * (0.20 - g) / 0.12))
    )


def relative_gain(before: Column, now: Column) -> Column:
    """Improvement of ``now`` over ``before`` relative to ``before``, never negative."""
    return F.greatest(F.lit(0.0), (before - now) / (F.abs(before) + 1e-12))


# Rules read "conclusion: condition, condition, ...".  All conditions must hold (least degree); a
# condition may offer alternatives with "or" (greatest degree), and one alternative may itself need
# two degrees joined by "with".  "input level" is a membership; a bare word is a given degree.
# fixed values: the five rule groups, each with the value used where no rule fires
GUIDANCE = """
0.05: uncertain
0.45: moderate
0.90: confident
0.15: empirical high
"""
BREADTH = """
1.00: uncertain
0.65: moderate
0.30: confident
0.85: empirical low
0.95: global_stagnation high, residual high
0.95: saturation high
0.90: misalignment high
"""
EXPLORE = """
0.92: unexplored high
0.58: unexplored medium
0.16: unexplored low
0.82: uncertain
0.58: moderate
0.38: confident
0.82: empirical low
0.12: empirical high, plateau high, completeness high
0.92: stagnation high, residual high
0.99: global_stagnation high, global_gain low, residual high
0.96: global_gain low, residual high
0.95: saturation high, residual medium or residual high
0.90: stagnation medium or stagnation high, maturity medium or maturity high, improvement low
0.92: misalignment high
0.97: coverage low, unexplored high
0.98: coverage low, empirical low, remaining high, residual medium or residual high
0.99: global_stagnation high, saturation high, coverage low, residual high, remaining high
0.86: dominance high, supported_dominance low, remaining high
0.15: stability high, maturity high, coverage high
0.12: stability high, maturity high, saturation low, unexplored low or unexplored medium
0.96: urgency high
0.68: urgency medium
0.94: stagnation high, information low, residual high
0.98: information low, residual high
0.93: residual high
0.70: residual medium
0.97: model_residual high
0.74: model_residual medium
0.96: intra_coverage low, residual medium or residual high
0.10: breakthrough high, remaining low
0.96: stagnation high, responsiveness low
0.90: quality low, empirical low or empirical medium, exhaustion low or residual medium or residual high or urgency medium or urgency high
0.95: quality low, exhaustion low or residual medium or residual high or urgency medium or urgency high
0.25: responsiveness high, capacity medium or capacity high
0.94: exhaustion low
0.05: exhaustion high
0.99: in_family high
0.78: in_family medium
0.99: escape high
0.82: escape medium
"""
REFINE = """
0.90: completeness low
0.62: completeness medium
0.14: completeness high, plateau high, maturity high
0.28: uncertain
0.52: moderate
0.66: confident
0.86: empirical high, completeness low or completeness medium
0.12: empirical high, completeness high, plateau high, maturity high
0.97: quality high, maturity low, stagnation low
0.95: global_stagnation low, information high
0.93: quality high, maturity low
0.05: stagnation high
0.08: saturation high
0.18: maturity high, improvement low
0.98: challenger high, challenger_maturity low
0.84: challenger medium or challenger high, unexplored medium or unexplored high
0.91: responsiveness high, maturity low or maturity medium, capacity medium or capacity high
0.96: responsiveness high, capacity medium or capacity high
0.03: information low, stagnation high
0.02: information low, stagnation high, residual low or residual medium or residual high
0.04: information low, responsiveness low, maturity high
0.95: quality high, maturity high, preprocessing high
0.03: preprocessing low, stagnation high
0.99: breakthrough high, responsiveness high, remaining low
0.93: breakthrough medium, responsiveness high, remaining low
0.99: breakthrough high, responsiveness high
0.04: stagnation high, responsiveness low
0.10: capacity low
0.12: quality low
0.96: expected high, responsiveness high or challenger high
0.02: in_family high, information low, stagnation high
0.05: escape high, global_stagnation high, saturation high
0.03: global_stagnation high, global_gain low, supported_dominance high, residual low, responsiveness low
"""
STOP = """
0.05: always
0.90: plateau high, completeness high, unexplored low, maturity high, quality high, empirical high, challenger low, unresolved low
0.70: plateau high, completeness medium, unexplored low, maturity high, quality high, empirical high, challenger low, unresolved low
0.05: plateau low, maturity low or stability low
0.08: unexplored high
0.08: completeness low, empirical high, maturity low
0.88: plateau high, empirical high, completeness high, maturity high, quality high, challenger low, unresolved low, unexplored low or unexplored medium
0.50: plateau medium, unexplored medium
0.88: stability high, maturity high, quality high, empirical high, stagnation low or stagnation medium, unexplored low or unexplored medium with coverage high, challenger low, unresolved low
0.92: stability high, maturity high, quality high, empirical high, coverage high, unexplored low, challenger low, unresolved low
0.03: maturity low, quality high
0.02: unexplored high, coverage low
0.06: quality low
0.08: empirical low or empirical medium, unexplored medium or unexplored high
0.04: challenger high
0.08: challenger medium or challenger high, unexplored medium or unexplored high
0.03: urgency high
0.18: urgency medium
0.04: residual high
0.03: model_residual high
0.82: information low, maturity high, unexplored low, preprocessing low
0.88: information low, challenger low, residual low
0.98: global_stagnation high, global_gain low, residual low, stability high, challenger low, urgency low, absolute_quality high
0.90: global_gain low, stability high, challenger low, residual low, absolute_quality high
0.96: supported_dominance high, quality high, stability high, urgency low, challenger low, global_stagnation high, residual low
0.72: supported_dominance medium, quality high, stability high, urgency low, challenger low, residual low
0.08: dominance high, supported_dominance low, remaining high
0.06: coverage low, empirical low, remaining high
0.04: escape high, global_stagnation high, saturation high
0.03: breakthrough high, responsiveness high
0.20: responsiveness high, maturity low or maturity medium
0.98: exhaustion high, quality high, stability high
0.99: exhaustion high, global_stagnation high, global_gain low, residual low, model_residual low, empirical high
0.03: exhaustion low
0.02: dominance low, residual high
0.99: remaining low, supported_dominance high, challenger low, urgency low, exhaustion high
0.94: expected low, quality high, stability high, challenger low, residual low
"""
GROUPS = {"guidance": (GUIDANCE, 0.0), "breadth": (BREADTH, 1.0), "explore": (EXPLORE, 0.65), "refine": (REFINE, 0.35), "stop": (STOP, 0.05)}
ALWAYS = 0.35
DOMINANT = {
    "explore": """
unexplored_potential_high: unexplored high
analytical_evidence_urgency_high: urgency high
global_stagnation_high_residual_value_high: global_stagnation high, global_gain low, residual high
global_information_low_residual_value_high: global_gain low, residual high
controlled_family_escape: escape high
search_exhaustion_low: exhaustion low
explore_model_in_family: in_family high
evidence_uncertain: uncertain
""",
    "refine": """
effective_challenger_high_maturity_low: challenger high, challenger_maturity low
preprocessing_potential_high: quality high, maturity high, preprocessing high
late_breakthrough_high: breakthrough high, responsiveness high, remaining low
responsive_model_has_capacity: responsiveness high, capacity medium or capacity high
model_information_high_global_stagnation_low: information high, global_stagnation low
model_information_low_model_stagnation_high: information low, stagnation high
""",
    "stop": """
evidence_supported_dominant_incumbent: supported_dominance high, quality high, stability high, urgency low, challenger low
search_exhaustion_high: exhaustion high, quality high, stability high
exhausted_unsuccessful_search: exhaustion high, global_stagnation high, global_gain low, residual low, model_residual low, empirical high
global_stagnation_low_residual_value: global_stagnation high, global_gain low, residual low, urgency low, absolute_quality high
redundant_local_search_low_residual_value: information low, challenger low, residual low
search_mature_information_gain_low: information low, maturity high, unexplored low, preprocessing low
plateau_complete_quality_high: plateau high, completeness high, unexplored low, maturity high, quality high
analytical_urgency_high_blocks_stop: urgency high
family_residual_high_blocks_stop: residual high
""",
}


def rules(text: str) -> list[tuple[str, list[list[list[str]]]]]:
    """(conclusion, conditions); a condition is a list of alternatives, an alternative a list of degrees."""
    out = []
    for line in text.strip().splitlines():
        conclusion, body = line.split(": ")
        out.append((conclusion, [[alt.split(" with ") for alt in cond.split(" or ")] for cond in body.split(", ")]))
    return out


def combine(conditions: list[list[list[str]]], degree: Callable, least: Callable, greatest: Callable):
    """Degree of a rule: least over conditions of the greatest over alternatives."""
    pick = lambda fn, xs: xs[0] if len(xs) == 1 else fn(*xs)
    return pick(least, [pick(greatest, [pick(least, [degree(d) for d in alt]) for alt in cond]) for cond in conditions])


def weighted(pairs: list[tuple[Column, float]], default: float) -> Column:
    """Average of the conclusions weighted by rule degrees, the default where none fires."""
    total = sum((d for d, _ in pairs[1:]), pairs[0][0])
    value = sum((d * v for d, v in pairs[1:]), pairs[0][0] * pairs[0][1])
    return F.when(total <= 1e-12, default).otherwise(clamp(value / total))
