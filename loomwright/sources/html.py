"""Typed blocks and text of HTML pages."""

from __future__ import annotations

import codecs
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocks import FACT, FIGURE_VALUE, FREE_FACT

#: Elements and class words that hold no content.
CHROME_TAGS = frozenset({"aside", "footer", "form", "header", "iframe", "nav", "noscript", "script", "style", "svg", "template", "title"})
CHROME_WORDS = frozenset("ad ads advert banner bannerdiv breadcrumb breadcrumbs consent cookie footer modal nav navbar navigation newsletter overlay pager pagination popup promo related share sidebar social subscribe toolbar".split())
#: Class words of a box that shows one figure, of its label and of its value.
CARD, LABEL, VALUE = frozenset("card tile stat metric kpi".split()), frozenset("caption head key label name term title".split()), frozenset("amount data figure number val value".split())
MAX_LABEL, MAX_VALUE, LOOK_BACK = 40, 60, 8
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
BLOCK = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType())])


_KNOWN, _OPEN, _FIGURE = re.compile(FACT), re.compile(FREE_FACT), re.compile(FIGURE_VALUE)


def decoded(raw: bytes) -> str:
    """The page as text: by its byte order mark, as UTF-8 if it is that, by the character set that it names, else as
    Windows-1252."""
    raw = bytes(raw)
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        named = _CHARSET.search(raw[:4096])
        name = named.group(1).decode("ascii").lower() if named else ""
        at_end = len(raw) - e.start < 4 and e.reason == "unexpected end of data"
        if name in ("utf-8", "utf8") or at_end and not raw[: e.start].isascii():  # cut inside its last character
            return (raw[: e.start] if at_end else raw).decode("utf-8", "replace")
        try:
            return raw.decode("cp1252" if name in ("", "iso-8859-1", "latin-1", "latin1", "us-ascii") else name, "replace")
        except LookupError:
            return raw.decode("cp1252", "replace")


_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def _class_words(attrs) -> set[str]:
    return {w for k, v in attrs if k in ("class", "id") and v for w in re.split(r"[^a-z0-9]+", v.lower())}


class _Blocks(HTMLParser):
    """Blocks of a page. Figures that cards give as a label and a value become facts beside the blocks."""

    def __init__(self, keep_chrome: bool):
        super().__init__(convert_charrefs=True)
        self.keep, self.stack, self.skip, self.buffer, self.cells, self.out = keep_chrome, [], 0, [], None, []
        self.card, self.n_cards, self.role, self.labels = [], 0, [], []

    def chrome(self, tag: str, attrs) -> bool:
        if tag in ("script", "style", "noscript", "svg", "template", "title"):
            return True
        if self.keep:
            return False
        words = _class_words(attrs)
        if tag in ("main", "article") or words & {"article", "main", "content"}:
            return False
        return tag in CHROME_TAGS or bool(words & CHROME_WORDS)

    def pair(self, text: str) -> None:
        """Remember a label of a card, or give the fact that a value makes with the last known label of the same card."""
        role = next((r for r in reversed(self.role) if r), "")
        if not self.card or not self.card[-1] or self.keep or not role:
            return
        if role == "label" and len(text) <= MAX_LABEL:
            self.labels.append((self.card[-1], text))
        elif role == "value" and len(text) <= MAX_VALUE:
            for card, label in reversed(self.labels[-LOOK_BACK:]):
                name = label.rstrip(" :")
                if card == self.card[-1] and _KNOWN.search(name) and (_OPEN.search(name) or _FIGURE.search(text)):
                    self.out.append(("fact", f"{name}: {text}", 0))
                    break

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if not text or self.skip:
            return
        if self.cells is not None:
            self.cells.append(text)
            return
        self.pair(text)
        tag = next((t for t, _ in reversed(self.stack) if t in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "figcaption")), "p")
        kind = "heading" if tag[0] == "h" else "list_item" if tag == "li" else "footnote" if text.startswith(("*", "†")) else "paragraph"
        self.out.append((kind, text, int(tag[1]) if kind == "heading" else 0))

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "i", "em", "strong", "a", "span", "sup", "sub"):
            self.flush()
        elif tag in ("a", "span") and self.cells is None:
            self.flush()
        if tag == "tr":
            self.row()
            self.cells = []
        if tag in VOID:
            return
        if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") and self.stack and self.stack[-1][0] in ("p", "li") and not (tag == "p" and self.stack[-1][0] == "li"):
            self.pop()  # an end tag left out
        chrome = self.chrome(tag, attrs)
        words = _class_words(attrs)
        self.stack.append((tag, chrome))
        self.role.append("value" if words & VALUE else "label" if words & LABEL else "")
        if words & CARD:
            self.n_cards += 1
        self.card.append(self.n_cards if words & CARD else self.card[-1] if self.card else 0)
        self.skip += chrome

    def pop(self):
        self.skip -= self.stack.pop()[1]
        self.role.pop()
        self.card.pop()

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "em", "strong", "sup", "sub") or self.role and self.role[-1]:
            self.flush()
        if tag in ("tr", "table"):
            self.row()
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t = self.stack[-1][0]
                self.pop()
                if t == tag:
                    break

    def row(self):
        if self.cells:
            self.out.append(("table_row", " | ".join(self.cells if len(self.cells) > 1 else [*self.cells, ""]).rstrip(), 0))
        self.cells = None

    def handle_data(self, data):
        if not self.skip:
            self.buffer.append(data)


def parse(raw: bytes | None, keep_chrome: bool = False) -> list[dict]:
    if not raw:
        return []
    parser = _Blocks(keep_chrome)
    parser.feed(decoded(raw))
    parser.close()
    parser.flush()
    parser.row()
    return [{"pos": i, "kind": k, "text": t, "level": level} for i, (k, t, level) in enumerate(parser.out)]


@F.pandas_udf(T.ArrayType(BLOCK))
def html_blocks(raw: pd.Series) -> pd.Series:
    """Typed blocks of the content of a page; broken markup is read as far as it goes."""
    return pd.Series([parse(x) for x in raw])


@F.pandas_udf(T.StringType())
def html_text(raw: pd.Series) -> pd.Series:
    """All text of a page, one block per line."""
    return pd.Series([None if x is None else "\n".join(b["text"] for b in parse(x, True)) for x in raw])
