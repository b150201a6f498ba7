"""Rule layer of question routing: pattern groups as configuration, evaluated as one CASE expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pii import first_label


@dataclass(frozen=True)
class Rules:
    """Patterns of the groups, in order of precedence; all are matched without case."""

    advice: tuple[str, ...] = (r"\bshould (?:i|we)\b", r"\btell me (?:the|a) (?:best|top)\b", r"\bbetter than\b", r"\bwhere (?:do|can) i put\b", r"\bsuggest\b", r"\b(?:best|top|safest) (?:plan|fund)s?\b", r"\bdoubles? (?:fastest|my money)\b")
    performance: tuple[str, ...] = (r"\breturns?\b", r"\bgains?\b", r"\bgrew by\b", r"\bbeats?\b", r"\bout-?perform", r"\bguaranteed\b")
    off_topic: tuple[str, ...] = (r"\brecipe\b", r"\btravel cover\b", r"\bboat race\b", r"\bhow tall\b")
    benchmark: str = r"\bbenchmark\b|\bindex\b"
    aliases: dict[str, str] = field(default_factory=lambda: {a: a.replace(" ", "_") for a in ("large cap", "flexi cap", "small cap", "mid cap", "balanced advantage", "gilt", "liquid")} | {"elss": "elss", "tax saver": "elss"})


RULES = Rules()


def matched(text: Column, patterns: tuple[str, ...]) -> Column:
    """All patterns that match, as evidence."""
    return F.filter(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(p)) for p in patterns]), lambda x: x.isNotNull())


def _any(patterns: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def intent(text: Column, rules: Rules = RULES) -> Column:
    """PII, then ADVICE (performance included), then OUT_OF_SCOPE unless a benchmark is asked for, else FACTUAL."""
    return (
        F.when(first_label(text).isNotNull(), "PII")
        .when(text.rlike(_any(rules.advice + rules.performance)), "ADVICE")
        .when(text.rlike(_any(rules.off_topic)) & ~text.rlike("(?i)(?:" + rules.benchmark + ")"), "OUT_OF_SCOPE")
        .otherwise("FACTUAL")
    )


def category(text: Column, rules: Rules = RULES) -> Column:
    """Category of the longest alias in the text; of equally long ones the first to appear, then by alias."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(a)), F.struct((-F.length(F.lit(a))).alias("n"), F.instr(low, a).alias("at"), F.lit(a).alias("alias"), F.lit(c).alias("category"))) for a, c in rules.aliases.items()]), lambda x: x.isNotNull())
    return F.array_min(found)["category"]


def performance_claim(text: Column, rules: Rules = RULES) -> Column:
    """Does generated text speak of returns, or give a percentage next to such words?"""
    return text.rlike(_any(rules.performance)) | (F.contains(text, F.lit("%")) & text.rlike(r"(?i)\b(?:a year|annual|yield|interest|profit)"))
