"""Words, shingles and hashes of many texts at once, in numpy.

A batch of texts becomes one array of code points; word borders, word hashes and hashes of character or word runs
come from array operations over the whole batch, so that no Python code runs per word.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import regex

#: Unicode property White_Space, written for Java's and Python's regular expressions alike.
WHITE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CF = regex.compile(r"\p{Cf}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def unfolded(text: str | None) -> str:
    """NFKC, without format characters; null is empty."""
    if not text or text.isascii():
        return text or ""
    return _CF.sub("", unicodedata.normalize("NFKC", text))


def fold(text: str | None) -> str:
    """NFKC, without format characters, in lower case; null is empty."""
    return unfolded(text).lower()


def is_word_char() -> np.ndarray:
    """By code point: is it a letter (L*) or a decimal digit (Nd)?"""
    if "word" not in _tables:
        kinds = [unicodedata.category(chr(i)) for i in range(0x33480)]
        _tables["word"] = np.array([k[0] == "L" or k == "Nd" for k in kinds])
    return _tables["word"]


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        steps[0] = 1
        _tables[name] = np.multiply.accumulate(steps)
    return _tables[name][:n]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and where each text starts (one more at the end)."""
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)), out=starts[1:])
    return codes, starts


class Words:
    """The words of a batch of texts, a word being a maximal run of letters and digits of the folded text."""

    def __init__(self, texts: list[str | None]):
        self.texts = [fold(t) for t in texts]
        self.codes, self.text_start = codes_of(self.texts)
        table = is_word_char()
        inside = np.zeros(len(self.codes) + 1, dtype=np.int8)
        known = self.codes < len(table)
        inside[:-1] = table[np.where(known, self.codes, 0)] & known
        edge = np.diff(inside, prepend=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        #: number of the first word of each text, and of the end
        self.first = np.searchsorted(self.start, self.text_start)
        n = len(self.codes)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * _powers("power", _BASE, n), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _powers("inverse", _INVERSE, n + 1)[self.start])

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words, and the number of its text; runs don't cross texts. Run i starts at word i
        of those whose run fits, in order."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        total = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            total = mix(total + self.hash[j : j + n])
        text = np.repeat(np.arange(len(self.texts)), np.diff(self.first))
        fits = text[:n] == text[k - 1 :]
        return total[fits], text[:n][fits]


def kinds_of_chars(codes: np.ndarray) -> np.ndarray:
    """By character: 1 a letter, 2 a decimal digit, 3 a mark that goes with letters, 4 white space, 0 anything else."""
    if "kind" not in _tables:
        white = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
        of = {"L": 1, "M": 3}
        _tables["kind"] = np.array([4 if i in white else 2 if (c := unicodedata.category(chr(i))) == "Nd" else of.get(c[0], 0) for i in range(0x33480)], dtype=np.uint8)
    known = codes < len(_tables["kind"])
    return np.where(known, _tables["kind"][np.where(known, codes, 0)], 0)


def is_upper(codes: np.ndarray) -> np.ndarray:
    """Which characters are capital letters?"""
    if "upper" not in _tables:
        _tables["upper"] = np.array([unicodedata.category(chr(i)) == "Lu" for i in range(0x20000)])
    known = codes < len(_tables["upper"])
    return _tables["upper"][np.where(known, codes, 0)] & known


def hashes_of_spans(codes: np.ndarray, counted: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the counted characters of each span; what isn't counted leaves no trace."""
    place = np.r_[0, np.cumsum(counted)]
    kept = codes[counted].astype(np.uint64) + np.uint64(1)
    n = len(kept)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(kept * _powers("power", _BASE, n), out=sums[1:])
    a, b = place[start], place[end]
    return mix((sums[b] - sums[a]) * _powers("inverse", _INVERSE, n + 1)[a])
