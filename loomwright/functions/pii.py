"""Two rule sets for identifiers: for questions (patterns, first match wins) and for corpora (numbers read token by token).

Both are made from one description of the formats as their issuers publish them: how many digits or letters there are, what
they begin with, and in which groups they are written."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The labels, in the order in which they are tried.
LABELS = ("pan", "aadhaar", "ifsc", "email", "demat", "phone_in", "account", "otp")
MASK = "[redacted]"


@dataclass(frozen=True)
class Digits:
    """A number of ``least`` to ``most`` digits that begins with one of ``first``, written in ``groups`` or in one."""

    least: int
    most: int
    first: str = "0-9"
    groups: tuple[int, ...] = ()

    def pattern(self, gap: str = "[ -]?") -> str:
        if self.groups:
            parts = [f"[{self.first}][0-9]{{{self.groups[0] - 1}}}", *(f"[0-9]{{{n}}}" for n in self.groups[1:])]
            return gap.join(parts)
        rest = f"{{{self.least - 1},{self.most - 1}}}" if self.most > self.least else f"{{{self.least - 1}}}"
        return f"[{self.first}][0-9]{rest}"

    def fits(self, digits: str) -> bool:
        return self.least <= len(digits) <= self.most and re.match(f"[{self.first}]", digits) is not None


AADHAAR, MOBILE = Digits(12, 12, "2-9", (4, 4, 4)), Digits(10, 10, "6-9", (5, 5))
DEMAT, ACCOUNT, CODE = Digits(16, 16), Digits(9, 18), Digits(4, 6)
PAN, IFSC = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
MAIL = r"[A-Za-z0-9][A-Za-z0-9.+_-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
#: What announces a one-time code; at most three words lie between it and the code.
ANNOUNCED = r"(?i)\b(?:otp|pin|passcode|(?:one[- ]time|verification|security|login) (?:code|password|pin))\b(?:[^0-9A-Za-z\n]+[A-Za-z]+){0,3}[^0-9A-Za-z\n]+"

QUESTION_RULES = (
    ("pan", PAN),
    ("aadhaar", rf"\b{AADHAAR.pattern()}\b"),
    ("ifsc", IFSC),
    ("email", rf"\b{MAIL}\b"),
    ("demat", rf"\b{DEMAT.pattern()}\b"),
    ("phone_in", rf"(?:\+91[ -]?|\b0?){MOBILE.pattern()}\b"),
    ("account", rf"\b{ACCOUNT.pattern()}\b"),
    ("otp", rf"{ANNOUNCED}{CODE.pattern()}\b"),
)

_WORDS = [("pan", re.compile(PAN)), ("ifsc", re.compile(IFSC)), ("email", re.compile(MAIL))]
_CODE = re.compile(rf"{ANNOUNCED}({CODE.pattern()})(?![0-9.,]*[0-9])")
#: A number with its separators, as it stands in a text; one with a point or comma inside is a quantity.
_NUMBER = re.compile(r"(?<![\w.,])\+?[0-9](?:[ .,/-]?[0-9])*(?![\w])")
_PART = re.compile(r"[0-9.,/]+")


def _number_label(token: str) -> str | None:
    if any(c in token for c in ".,/"):
        return None
    digits = re.sub(r"[^0-9]", "", token)
    local = digits[2:] if token.startswith("+91") else digits[1:] if digits.startswith("0") and len(digits) == 11 else digits
    if token.startswith("+"):
        return "phone_in" if token.startswith("+91") and MOBILE.fits(local) else None
    return next((k for k, rule, x in (("aadhaar", AADHAAR, digits), ("demat", DEMAT, digits), ("phone_in", MOBILE, local), ("account", ACCOUNT, digits if token.isdigit() else "")) if rule.fits(x)), None)


def corpus_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(label, start, end) of the identifiers of a corpus text. Numbers are read as whole tokens: the digits of
    53.830423188357 are no identifier, and of digits in groups the groups count together if they fit a format."""
    if not text:
        return []
    out = [(k, m.start(), m.end()) for k, p in _WORDS for m in p.finditer(text)]
    out += [("otp", m.start(1), m.end(1)) for m in _CODE.finditer(text)]
    for m in _NUMBER.finditer(text):
        label = _number_label(m.group())
        if label:
            out.append((label, m.start(), m.end()))
        else:
            out += [(k, m.start() + x.start(), m.start() + x.end()) for x in _PART.finditer(m.group()) if (k := _number_label(x.group()))]
    return sorted(out, key=lambda s: (s[1], s[2]))


def first_label(text: Column) -> Column:
    """Label of the first rule that matches a question, null if none does."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(label)) for label, p in QUESTION_RULES])


def first_span(text: Column) -> Column:
    """struct(label, start, end) of the first match of the first rule that matches, positions from 0; null if none does."""
    tried = [F.when(text.rlike(p), F.struct(F.lit(k).alias("label"), (F.regexp_instr(text, F.lit(p)) - 1).alias("start"), (F.regexp_instr(text, F.lit(p)) - 1 + F.length(F.regexp_substr(text, F.lit(p)))).alias("end"))) for k, p in QUESTION_RULES]
    return F.coalesce(*tried)


@F.pandas_udf(T.ArrayType(T.StringType()))
def all_labels(text: pd.Series) -> pd.Series:
    """Labels of all identifiers of a corpus text, in the order of LABELS."""
    return pd.Series([sorted({k for k, _, _ in corpus_spans(x)}, key=LABELS.index) for x in text])


def masked(text: Column) -> Column:
    """Every match of every question rule, rule after rule, replaced by the mask."""
    for _, pattern in QUESTION_RULES:
        text = F.regexp_replace(text, pattern, MASK)
    return text


def first_masked(text: Column) -> Column:
    """Only the first match of the first rule that matches replaced, for traces."""
    at = first_span(text)
    return F.when(at.isNull(), text).otherwise(F.overlay(text, F.lit(MASK), at["start"] + 1, at["end"] - at["start"]))


@F.pandas_udf(T.StringType())
def merged_masked(text: pd.Series) -> pd.Series:
    """All identifiers of a corpus text, overlapping and touching ones merged into one mask."""
    out = []
    for x in text:
        if x:
            merged: list[list[int]] = []
            for _, a, b in corpus_spans(x):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in reversed(merged):
                x = x[:a] + MASK + x[b:]
        out.append(x)
    return pd.Series(out)
