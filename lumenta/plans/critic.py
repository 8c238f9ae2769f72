"""Checks of a narrative against computed evidence. Nothing here reads data."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lumenta.operators.injection import FLAG, score_text

TOLERANCE = 0.015
NUMBER = re.compile(r"([-+]?\d[\d,]*\.?\d*)\s*(%|percent)?")
# Phrases that claim a cause.
CAUSAL = ["caused by", "because of", "due to", "driven by", "as a result of", "led to", "resulted in", "responsible for"]


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool
    blocking: bool
    detail: str


def numbers(evidence) -> list[float]:
    """All numbers in nested evidence, and their magnitudes."""
    if isinstance(evidence, bool) or evidence is None or isinstance(evidence, str):
        return []
    if isinstance(evidence, int | float):
        return [float(evidence), abs(float(evidence))]
    values = evidence.values() if isinstance(evidence, dict) else evidence if isinstance(evidence, list | tuple) else ()
    return [n for v in values for n in numbers(v)]


def ungrounded(narrative: str, evidence: dict, tolerance: float = TOLERANCE) -> list[str]:
    """Numbers of a narrative that no computed value backs. A percentage may stand for a share; plain numbers under 2 are counts of things."""
    known, out = numbers(evidence), []
    for raw, percent in NUMBER.findall(narrative):
        value = float(raw.replace(",", "").rstrip("."))
        if abs(value) < 2 and not percent:
            continue
        forms = (value, value / 100, value * 100) if percent else (value,)
        if not any(abs(k - f) <= tolerance * max(abs(k), abs(f), 1e-9) for f in forms for k in known):
            out.append(raw + ("%" if percent else ""))
    return out


def review(narrative: str, evidence: dict, *, validated: bool, reconciliation: float, significance: dict | None, beats_baseline: bool | None, rows: int, passages: list[str] | None = None) -> list[Check]:
    loose, causal = ungrounded(narrative, evidence), [m for m in CAUSAL if m in narrative.lower()]
    significant = bool(significance and significance.get("significant"))
    checks = [
        Check("sql_validated", validated, True, "every plan passed admission" if validated else "a plan was not admitted"),
        Check("result_non_empty", rows > 0, True, f"{rows} rows"),
        Check("attribution_reconciles", reconciliation < 1e-6, True, f"residual {reconciliation:.1e}"),
        Check("numbers_grounded", not loose, True, f"ungrounded: {', '.join(loose[:5])}" if loose else "all numbers trace to computed values"),
        Check("causal_claims_supported", not causal or significant, True, f"causal words without a significant test: {', '.join(causal)}" if causal and not significant else "no unsupported causal claim"),
        Check("evidence_attached", bool(evidence.get("sql")) and bool(evidence.get("metric")), False, "plan and metric are attached" if evidence.get("sql") else "evidence is incomplete"),
    ]
    if beats_baseline is not None:
        checks.append(Check("forecast_beats_baseline", beats_baseline, False, "the forecast beat seasonal naive" if beats_baseline else "a baseline projection"))
    if passages and any(score_text(p) >= FLAG for p in passages):
        echoed = score_text(narrative) >= FLAG
        checks.append(Check("no_injected_instructions", not echoed, True, "the narrative repeats instructions of a passage" if echoed else "instructions in passages were not adopted"))
    return checks


def approved(checks: list[Check]) -> bool:
    return all(c.passed for c in checks if c.blocking)
