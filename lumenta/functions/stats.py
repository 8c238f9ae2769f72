"""Tests and scores over aggregates: small arithmetic for the driver, since Spark has no error or beta function."""

from __future__ import annotations

import math
from dataclasses import dataclass

# The weights of the four parts; the constants of the scores below.
WEIGHTS = {"data": 0.30, "statistical": 0.30, "model": 0.20, "reasoning": 0.20}


@dataclass(frozen=True)
class Test:
    name: str
    statistic: float
    p_value: float
    effect_size: float
    significant: bool
    note: str = ""


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def welch(n1: int, mean1: float, var1: float, n2: int, mean2: float, var2: float, alpha: float = 0.05, least_effect: float = 0.2) -> Test:
    """Welch's t with a normal p; significant only if the effect is not negligible either."""
    if min(n1, n2) < 3:
        return Test("welch_t", 0.0, 1.0, 0.0, False, "fewer than 3 observations on a side")
    se = math.sqrt(var1 / n1 + var2 / n2)
    if se == 0:
        return Test("welch_t", 0.0, 1.0, 0.0, False, "no variance")
    t = (mean2 - mean1) / se
    pooled = math.sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2))
    d, p = (mean2 - mean1) / pooled, normal_p(t)
    return Test("welch_t", t, p, d, p < alpha and abs(d) >= least_effect)


def proportions(s1: int, n1: int, s2: int, n2: int, alpha: float = 0.05, least: int = 30, least_effect: float = 0.2) -> Test:
    """Two-proportion z, with Cohen's h; significant only if the effect is not negligible either."""
    if min(n1, n2) < least:
        return Test("proportion_z", 0.0, 1.0, 0.0, False, f"fewer than {least} trials on a side")
    p1, p2, p = s1 / n1, s2 / n2, (s1 + s2) / (n1 + n2)
    se = math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    h = 2 * math.asin(math.sqrt(p2)) - 2 * math.asin(math.sqrt(p1))
    if se == 0:
        return Test("proportion_z", 0.0, 1.0, h, False, "no variance")
    z = (p2 - p1) / se
    return Test("proportion_z", z, normal_p(z), h, normal_p(z) < alpha and abs(h) >= least_effect)


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d or tiny), 1 + k / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_p(t: float, dof: float) -> float:
    """Two-sided p of Student's t."""
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def t_critical(dof: float, alpha: float = 0.05) -> float:
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_p(mid, dof) > alpha else (low, mid)
    return (low + high) / 2


def clamped(x: float) -> float:
    """Within 0.01 and 1, so that no part of a geometric mean makes it nothing."""
    return max(0.01, min(1.0, x))


def score_data(quality: float, rows: int, days_old: float, enough: int = 1000, fresh: float = 30.0) -> float:
    """quality within 0 to 1. The first day costs nothing."""
    volume = clamped(math.sqrt(min(1.0, rows / max(1, enough))))
    freshness = clamped(1 - min(1.0, max(0.0, days_old - 1) / fresh))
    return clamped(0.5 * clamped(quality) + 0.25 * volume + 0.25 * freshness)


def score_statistical(p: float | None, effect: float | None) -> float:
    if p is None:
        return 0.35
    out = clamped(1 - math.exp(-0.45 * math.log10(1 / max(p, 1e-9)) - 0.05))
    return out * 0.6 if effect is not None and abs(effect) < 0.2 else out


def score_model(mape: float | None, beats_baseline: bool, folds: int) -> float:
    if mape is None:
        return 0.5 if beats_baseline else 0.35
    return clamped(1 - min(1.0, mape / 0.5)) * (1.0 if beats_baseline else 0.65) * (1.0 if folds >= 3 else 0.85)


def score_reasoning(passed: int, total: int, blocking: bool) -> float:
    if not total:
        return 0.4
    out = clamped((passed / total) ** 1.5)
    return min(out, 0.25) if blocking else out


def label(score: float) -> str:
    return "high" if score >= 0.8 else "moderate" if score >= 0.6 else "low" if score >= 0.4 else "insufficient"


def combine(parts: dict[str, float]) -> dict:
    """The weighted geometric mean of the four components, its label and the component that limits it."""
    own = {k: clamped(parts[k]) for k in WEIGHTS}
    score = math.exp(sum(w * math.log(own[k]) for k, w in WEIGHTS.items()))
    return {"score": score, "label": label(score), "limiting_factor": min(own, key=own.get), "components": own}


def auc_error(auc: float, positives: int, negatives: int) -> float:
    """Hanley and McNeil's standard error of an area under the curve."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return math.sqrt(max(0.0, (auc * (1 - auc) + (positives - 1) * (q1 - auc * auc) + (negatives - 1) * (q2 - auc * auc)) / (positives * negatives)))
