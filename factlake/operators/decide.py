"""Decision tables and scores over findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from the gravest on, with the weight of each in a rank.
SEVERITIES = [("CRITICAL", 100.0), ("HIGH", 75.0), ("MEDIUM", 50.0), ("LOW", 25.0), ("INFO", 10.0)]


def any_of(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def all_of(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a & b, (text.contains(w) for w in words))


def severity_rank(severity: Column) -> Column:
    """0 for the gravest; unknown ones come last."""
    return reduce(lambda c, s: c.when(severity == s[1][0], s[0]), list(enumerate(SEVERITIES))[1:], F.when(severity == SEVERITIES[0][0], 0)).otherwise(len(SEVERITIES))


def severity_weight(severity: Column) -> Column:
    return reduce(lambda c, s: c.when(severity == s[0], s[1]), SEVERITIES[1:], F.when(severity == SEVERITIES[0][0], SEVERITIES[0][1])).otherwise(0.0)


def severity_of(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s, _ in SEVERITIES)), rank.cast("int") + 1)


def actionable(severity: Column, confidence: Column, least: float = 0.6) -> Column:
    return severity.isin("CRITICAL", "HIGH") & (confidence >= least)


def status(proven: Column, verdict: Column, severity: Column, confidence: Column) -> Column:
    """Where nobody has looked (verdict null) only severity and confidence decide."""
    return (
        F.when(F.coalesce(proven, F.lit(False)), "PROVEN").when(verdict == "confirmed", "LIKELY").when(verdict == "rejected", "REJECTED").when(verdict == "uncertain", "NEEDS_HUMAN")
        .when((confidence >= 0.8) & (severity == "CRITICAL"), "LIKELY").when(confidence >= 0.7, "NEEDS_HUMAN").otherwise("REJECTED")
    )


def adjusted_severity(severity: Column, verdict: Column, sure: Column, easy: Column) -> Column:
    return F.when((verdict == "confirmed") & (sure > 80) & easy & (severity != "CRITICAL"), "CRITICAL").when((verdict == "confirmed") & (sure < 40) & (severity == "CRITICAL"), "HIGH").otherwise(severity)


def blended_confidence(confidence: Column, verdict: Column, sure: Column, proven: Column) -> Column:
    mixed = F.when(verdict == "confirmed", F.least(F.lit(1.0), F.lit(0.4) * confidence + F.lit(0.6) * (sure / F.lit(100.0)))).when(verdict == "rejected", F.lit(0.2) * confidence).when(verdict == "uncertain", F.lit(0.6) * confidence).otherwise(confidence)
    return F.when(F.coalesce(proven, F.lit(False)), F.greatest(F.lit(0.95), mixed)).otherwise(mixed)


def grade(evidence: Column) -> Column:
    """A to D by how many kinds of evidence there are."""
    return F.when(evidence >= 4, "A").when(evidence == 3, "B").when(evidence == 2, "C").otherwise("D")


#: The gravest severity that each grade allows: the policy in force, and a stricter one.
CAPS = {"A": "CRITICAL", "B": "CRITICAL", "C": "HIGH", "D": "MEDIUM"}
STRICT_CAPS = {"A": "CRITICAL", "B": "HIGH", "C": "MEDIUM", "D": "LOW"}


def capped_severity(severity: Column, grade_: Column, caps: dict[str, str] | None = None) -> Column:
    cap = reduce(lambda c, g: c.when(grade_ == g[0], g[1]), list((caps or CAPS).items())[1:], F.when(grade_ == "A", (caps or CAPS)["A"]))
    return severity_of(F.greatest(severity_rank(severity), severity_rank(cap)))


def verdict(critical: Column, high: Column, medium: Column) -> Column:
    return F.when(critical > 0, "DO_NOT_SHIP").when(high > 0, "FIX_FIRST").when(medium > 0, "REVIEW").otherwise("SHIP")


#: What a summary advises by the gravest findings, for the first generation of rules and for the second. Fixed values.
ADVICE = {
    1: ("Do not ship. %d critical issue(s) must be resolved immediately.", "Do not ship. %d high severity issue(s) require remediation.", "Ship with caution. %d medium severity issue(s) should be addressed.", "Ship ready. No significant issues found."),
    2: ("Do not ship. %d critical issue(s) found.", "Do not ship. %d high severity issue(s) found.", "Ship with caution. %d medium issue(s).", "Ship ready. No critical or high severity issues."),
}


def recommendation(critical: Column, high: Column, medium: Column, generation: int = 1) -> Column:
    """The advice for these counts."""
    first, second, third, none = ADVICE[generation]
    return F.when(critical > 0, F.format_string(first, critical)).when(high > 0, F.format_string(second, high)).when(medium > 0, F.format_string(third, medium)).otherwise(none)


def guarded_ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))


def fingerprint(*parts: Column | str, names: Column) -> Column:
    """Key of a finding: its parts and its names in sorted order."""
    return F.concat_ws(":", *parts, F.array_join(F.array_sort(names), ","))
