"""Personal information inside free text: found by shape and context, replaced by keyed surrogates.

Detection reads a text once per kind of item, on a copy in which digits, blanks, dashes and at-signs of all scripts are
plain and every character keeps its place. Items with a shape of their own (tax number, bank code, mail, demat) need no
context; runs of digits are told apart by their grouping and by the words before them, names by what introduces them
(a signature, "account of", a first cell of a record) and addresses by number, street and place.

Surrogates are drawn with a keyed hash from the item's canonical form (so that spellings of one entity get one surrogate),
letter for letter and digit for digit in the item's own format; names keep their gender, script and form. The distinct
entities of the whole corpus are checked against each other: where two would get one surrogate, or a surrogate is a
real item, those are drawn again, until all differ. A placeholder names the type and holds the surrogate.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..sources.shared import one_delivery, stage

#: Labels, the stronger first: where items overlap, the first one holds.
LABELS = ("email", "pan", "ifsc", "demat", "aadhaar", "phone_in", "account", "otp", "address", "name")
#: The registry's hosts go to every task; a registry of more hosts than this is a mistake.
MAX_HOSTS = 100_000

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("value", T.StringType()), T.StructField("entity", T.StringType()), T.StructField("gender", T.StringType())]))

_PLAIN: dict[int, int] = {}
for _c in range(0x80, 0x10000):
    _n = unicodedata.normalize("NFKC", chr(_c))
    if unicodedata.category(chr(_c)) == "Nd":
        _PLAIN[_c] = ord(str(unicodedata.digit(chr(_c))))
    elif unicodedata.category(chr(_c)) == "Pd" or _c == 0x2212:
        _PLAIN[_c] = ord("-")
    elif unicodedata.category(chr(_c)) == "Zs":
        _PLAIN[_c] = ord(" ")
    elif len(_n) == 1 and ord(_n) < 0x80 and ord(_n) > 0x20:
        _PLAIN[_c] = ord(_n)

_B, _E = r"(?<![A-Za-z0-9])(?<!\d[.,])", r"(?![A-Za-z0-9])(?![.,]\d)"
_I = re.I
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*)(?: ?@ ?| ?[\[({<] ?at ?[\])}>] ?| at )([A-Za-z0-9-]+(?:(?: ?\. ?| ?[\[({<] ?dot ?[\])}>] ?| dot )[A-Za-z0-9-]+)*(?:\.| ?[\[({<] ?dot ?[\])}>] ?| dot )[A-Za-z]{2,})(?![A-Za-z0-9])", _I)
_DOT = re.compile(r" ?[\[({<] ?dot ?[\])}>] ?| dot | ?\. ?", _I)
_PAN = re.compile(_B + r"[A-Z]{5}[- ]?\d{4}[- ]?[A-Z]" + _E, _I)
_IFSC = re.compile(_B + r"[A-Z]{4}[- ]?0[A-Z0-9]{6}" + _E, _I)
_DEMAT = re.compile(_B + r"(?:IN[- ]?\d{6}[- ]?\d{8}|1[23]\d{6}[- ]?\d{8})" + _E, _I)
_AADHAAR_GROUPS = re.compile(_B + r"[2-9]\d{3}([ .-])\d{4}\1\d{4}" + _E)
_AADHAAR = re.compile(r"(?:aadhaar|aadhar|uidai|uid)(?:[\s:#-]*(?:card|number|no\.?|is|=))*[\s:#-]*(\d{4}[ .-]?\d{4}[ .-]?\d{4})" + _E, _I)
_PHONE = re.compile(r"(?<![A-Za-z0-9])(?<!\d[.,-])(?<!\d )(?:\(?(?:\+|00)91\)?[-. ]{0,2}|0[- ]?)?[6-9](?:\d{9}|\d{4}[-. ]\d{5}|\d{2}[-. ]\d{3}[-. ]\d{4}|\d{3}[-. ]\d{3}[-. ]\d{3}|\d{3}[-. ]\d{6})" + _E + r"(?![- ]\d)")
_ACCOUNT = re.compile(r"(?<!demat )(?:\ba/c|\baccount|\bacct|\bac no|\bfolio)(?:[\s:#-]*(?:number|no\.?|num|is|=))*[\s:#-]*(\d[\d -]{7,24}\d)(?![A-Za-z0-9])", _I)
_OTP = re.compile(r"(?:\botp|\bone[- ]time (?:code|password|pin)|\bverification code|\bpin sent|\bsecurity code)(?:[\s:#-]*(?:was|is|no\.?|number|sent|=))*[\s:#-]*(\d{4,6})" + _E + r"|" + _B + r"(\d{4,6})(?= as the (?:verification|one[- ]time|security) (?:code|password))|\bcode (\d{4,6})(?= (?:never|has|is|was)? ?(?:expired|invalid|not accepted|did not|failed))", _I)
_STREET = r"(?:road|rd|lane|street|st|marg|gali|main|cross|avenue|ave|bazaar|nagar|chowk|path|drive|boulevard|circle|way)"
_ADDRESS = re.compile(
    r"(?<![A-Za-z0-9/-])(?:(?:flat|plot|house|door|shop|unit|h\. ?no\.?|no\.)\s*(?:no\.?\s*)?#?\d+[A-Z]?(?:[-/]\d+[A-Z]?)*|\d+[A-Z]?(?:[-/]\d+[A-Z]?)*),?\s+(?:(?!(?:of|for|and|the|is|was|in|on|at|days?|months?|weeks?)\b)[A-Za-z0-9'.]+\s+){0,4}?"
    + _STREET + r"\b(?:,\s*[A-Za-z0-9][A-Za-z0-9' .]*?){1,3}(?:(?:,\s*|\s*-\s*|\s+)(?:PIN\s*:?\s*)?\d{3} ?\d{3})?(?=[\s,.;!?|-]|$)", _I)
_TITLE = r"(?:(?:Mr|Ms|Mrs|Miss|Dr|Shri|Smt|Sri|Kum|MR|MS|MRS)\.?\s+)"
_PART = r"(?:[A-Z][a-zA-Z'’]+(?:-[A-Z][a-zA-Z'’]+)*|[\u0900-\u097F]{2,})"
_NAME = rf"(?:(?:{_PART}|[A-Z]\.)(?:\s(?:[A-Z]\.)){{0,2}}(?:\s{_PART}){{1,3}}|{_PART},\s{_PART}(?:\s(?:[A-Z]\.|{_PART}))?)"
_CUE = re.compile(
    r"(?:(?i:\bsigned by|\baccount of|\byours (?:faithfully|sincerely|truly),|\bmy name is|\bname is|\bnominee is|\b(?:first|second|joint|sole) holder,|\bposted by|\bwritten by|\bthis is|\bregards,|\bin the name of|\bon behalf of)|\bI,)\s+"
    + rf"(?P<title>{_TITLE})?(?P<name>{_NAME})")
_TITLED = re.compile(rf"(?P<title>{_TITLE})(?P<name>{_NAME})")
_CLOSING = re.compile(r"^\s*(?:(?:kind |best |warm )?regards|yours (?:faithfully|sincerely|truly)|thank you|thanks|sincerely)\s*[,.!]?\s*$", _I)
_NAME_LINE = re.compile(rf"^\s*(?P<title>{_TITLE})?(?P<name>{_NAME})\s*[.,]?\s*$")
_NOT_NAME = re.compile(r"\b(?:fund|index|house|direct|online|desk|plan|scheme|bank|services?|investor|holder|sip|nav|fundhouse|editors?|team|register|login|portfolio|stocks|settings|story|bills|corner|room|orders|exit|load|expense|ratio|related|popular|quick|benchmark|lock|minimum|stamp|duty|joint|minor|folios|payout|option|tax|new|offers?|app)\b", _I)
# cheap looks that spare most texts the patterns
_ODD = re.compile(r"[^\x00-\x7f\u0900-\u0965\u0970-\u097f₹·»«›‹©•™®“”‘’…]")
_DIGITS = re.compile(r"\d(?:[ .\-/]{0,2}\d){3}")
_AT = re.compile(r"\bat\s*[\])}>]")
_CUES = ("signed by", "account of", "yours ", "name is", "nominee is", " holder,", "posted by", "written by", "this is", "regards,", "in the name of", "on behalf of")
_STREETS = ("road", "lane", "street", "marg", "gali", "main", "cross", "avenue", "bazaar", "nagar", "chowk", "path", "drive", "boulevard", "circle", " way,", " rd,", " st,", " ave,")
_FULL = [("email", _MAIL), ("pan", _PAN), ("ifsc", _IFSC), ("demat", _DEMAT), ("phone_in", _PHONE)]
_GROUPED = re.compile(r"\d{9,18}|\d{4} \d{5,14}|\d{5,14}-\d{4}")


def _host(domain: str) -> str:
    host = _DOT.sub(".", domain).lower()
    return host[4:] if host.startswith("www.") else host


def _gender(title: str, given: str) -> str:
    if title:
        return "f" if title.strip(" .").lower() in ("ms", "mrs", "miss", "smt", "kum") else "m"
    return "f" if given[-1:].lower() in "aeiाीि" else "m"


def _name_entity(name: str) -> tuple[str, str]:
    """One spelling for all forms of a name (given names, then surname), and the given name."""
    if "," in name:
        last, first = (x.strip() for x in name.split(",", 1))
        name = f"{first} {last}"
    parts = name.lower().split()
    return " ".join(parts), parts[0]


def find(text: str | None, hosts: frozenset[str] = frozenset()) -> list[tuple[int, int, str, str, str]]:
    """(start, end, label, entity, gender) of the items of a text, in order and without overlaps."""
    if not text:
        return []
    t = text.translate(_PLAIN) if _ODD.search(text) else text
    low = t.lower()
    if len(low) != len(t):
        low = "".join(c.lower()[:1] for c in t)
    lines, upto = [], 0
    for m in _DIGITS.finditer(t):
        if m.start() >= upto:
            end = t.find("\n", m.start())
            upto = len(t) if end < 0 else end
            lines.append((t.rfind("\n", 0, m.start()) + 1, upto))
    found: list[tuple[int, int, str, str, str]] = []

    def add(start: int, end: int, label: str, entity: str = "", gender: str = "") -> None:
        found.append((start, end, label, entity or re.sub(r"[^a-z0-9]", "", t[start:end].lower()), gender))

    def add_name(m: re.Match) -> None:
        name = m.group("name")
        if not _NOT_NAME.search(name):
            entity, given = _name_entity(name)
            add(m.start("name"), m.end("name"), "name", entity, _gender(m.group("title") or "", given))

    if "@" in t or " dot " in low or _AT.search(low):
        for m in _MAIL.finditer(t):
            if (re.search(r"[@\[({<]", m.group()) or " dot " in m.group().lower()) and _host(m.group(2)) not in hosts:
                add(m.start(), m.end(), "email", f"{m.group(1).lower()}@{_DOT.sub('.', m.group(2)).lower()}")
    for m in _IFSC.finditer(t):
        add(m.start(), m.end(), "ifsc")
    spelled = "aadha" in low or "uid" in low
    for a, b in lines:
        for label, pattern in (("pan", _PAN), ("demat", _DEMAT), ("aadhaar", _AADHAAR_GROUPS)):
            for m in pattern.finditer(t, a, b):
                add(m.start(), m.end(), label)
        for m in _PHONE.finditer(t, a, b):
            add(m.start(), m.end(), "phone_in", re.sub(r"\D", "", m.group())[-10:])
        if spelled:
            for m in _AADHAAR.finditer(t, a, b):
                add(m.start(1), m.end(1), "aadhaar")
        for m in _ACCOUNT.finditer(t, a, b):
            number = _GROUPED.match(m.group(1))
            digits = re.sub(r"\D", "", number.group()) if number else ""
            if 9 <= len(digits) <= 18:
                found.append((m.start(1), m.start(1) + number.end(), "account!", digits, ""))
        for m in _OTP.finditer(t, a, b):
            k = m.lastindex
            add(m.start(k), m.end(k), "otp")
    if any(x in low for x in _STREETS):
        for m in _ADDRESS.finditer(t):
            add(m.start(), m.end(), "address", " ".join(re.findall(r"[a-z0-9]+", m.group().lower())))
    if "I, " in t or any(x in low for x in _CUES):
        for m in _CUE.finditer(t):
            add_name(m)
    if re.search(r"\b(?:m[rs]|mrs|miss|dr|shri|smt|sri|kum)\b", low):
        for m in _TITLED.finditer(t):
            add_name(m)
    if "\n" in t or " | " in t:
        at, since = 0, 99
        for line in t.split("\n"):
            since += 1
            if " | " in line:
                cells = line.split(" | ")
                m = _NAME_LINE.match(cells[0])
                if m and not _NOT_NAME.search(m.group("name")):
                    items, place = [], at + len(cells[0]) + 3
                    for cell in cells[1:]:
                        lead = len(cell) - len(cell.lstrip())
                        plain = cell.strip()
                        kind = next((k for k, p in _FULL if (x := p.match(plain)) and x.end() == len(plain)), None)
                        if kind is None and _GROUPED.fullmatch(plain):
                            kind = "account!"
                        if kind:
                            items.append((place + lead, place + lead + len(plain), kind))
                        place += len(cell) + 3
                    if items:
                        entity, given = _name_entity(m.group("name"))
                        add(at + m.start("name"), at + m.end("name"), "name", entity, _gender(m.group("title") or "", given))
                        for a, b, kind in items:
                            if kind == "account!":
                                found.append((a, b, kind, re.sub(r"\D", "", t[a:b]), ""))
            elif since <= 3 and (m := _NAME_LINE.match(line)) and not _NOT_NAME.search(m.group("name")):
                entity, given = _name_entity(m.group("name"))
                add(at + m.start("name"), at + m.end("name"), "name", entity, _gender(m.group("title") or "", given))
                since = 99
            if _CLOSING.match(line):
                since = 0
            at += len(line) + 1
    # an account named as such is one, whatever it looks like, but for demat numbers of demat accounts
    order = {label: k for k, label in enumerate(LABELS)} | {"account!": LABELS.index("demat") + 0.5}
    out: list[tuple[int, int, str, str, str]] = []
    taken: list[tuple[int, int]] = []
    for start, end, label, entity, gender in sorted(set(found), key=lambda x: (order[x[2]], x[0], -x[1])):
        if all(end <= a or start >= b for a, b in taken):
            taken.append((start, end))
            out.append((start, end, label.rstrip("!"), entity, gender))
    return sorted(out)


def _finder(hosts: frozenset[str]):
    @F.pandas_udf(SPANS)
    def spans(text: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "label": k, "value": x[a:b], "entity": e, "gender": g} for a, b, k, e, g in find(x, hosts)] for x in text])

    return spans


def registry_hosts(registry: DataFrame) -> frozenset[str]:
    """Hosts of the registry's addresses without a leading www.; their number is checked before they are fetched."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^\s*[a-zA-Z]+://([^/:?#\s]+)", 1)), r"^www\.", "")
    hosts = registry.where("url IS NOT NULL").select(host.alias("host")).where("host <> ''").distinct()
    rows = hosts.limit(MAX_HOSTS + 1).collect()
    if len(rows) > MAX_HOSTS:
        raise ValueError(f"the registry names more than {MAX_HOSTS} hosts")
    return frozenset(r["host"] for r in rows)


def personal_items(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """``texts(tab, row_key, text)`` -> ``(tab, row_key, label, start_pos, end_pos, value, entity, gender)``.

    Positions count characters from 0. Null and empty texts have no items; a text that comes twice has its items once.
    """
    finder = _finder(registry_hosts(registry))
    spans = texts.where("row_key IS NOT NULL AND text IS NOT NULL").select("tab", "row_key", F.explode(finder("text")).alias("s"))
    return spans.select("tab", "row_key", F.col("s.label").alias("label"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.col("s.value").alias("value"), F.col("s.entity").alias("entity"), F.col("s.gender").alias("gender")).distinct()


# surrogates

_ONSETS = ("k", "t", "m", "r", "v", "s", "n", "d", "l", "p", "b", "g", "j", "h", "y", "sh", "ch", "th")
_VOWELS = ("a", "e", "i", "o", "u", "ai")
_DEVA_ONSETS = ("क", "त", "म", "र", "व", "स", "न", "द", "ल", "प", "ब", "ग", "ज", "ह", "य", "श", "च", "थ")
_DEVA_VOWELS = ("", "े", "ि", "ो", "ु", "ै")


def _stream(key: bytes, label: str, entity: str, attempt: int):
    block, k = b"", 0
    while True:
        if not block:
            block = hmac.new(key, f"{label}\0{entity}\0{attempt}\0{k}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
            k += 1
        yield block[0]
        block = block[1:]


def _made_name(word: str, stream, ending: str) -> str:
    deva = any("\u0900" <= c <= "\u097f" for c in word)
    onsets, vowels = (_DEVA_ONSETS, _DEVA_VOWELS) if deva else (_ONSETS, _VOWELS)
    made = "".join(onsets[next(stream) % len(onsets)] + vowels[next(stream) % len(vowels)] for _ in range(3))
    if deva:
        return made + ("ा" if ending == "a" else "न")
    return made + ending


def surrogate(label: str, entity: str, gender: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of an entity in canonical form; ``in_format`` writes it in the form of a mention."""
    stream = _stream(key, label, entity, attempt)
    if label == "name":
        words = entity.split()
        return " ".join(
            chr(97 + next(stream) % 26) + "." if len(w.rstrip(".")) == 1 else _made_name(w, stream, ("a" if gender == "f" else "an") if k < len(words) - 1 or k == 0 else "ar") for k, w in enumerate(words)
        )
    if label == "email":
        local, _, domain = entity.partition("@")
        return "".join(chr(97 + next(stream) % 26) if c.isalpha() else str(next(stream) % 10) if c.isdigit() else c for c in local) + "@" + ".".join([_made_name("x", stream, "") + "mail", "invalid"])
    out = []
    for k, c in enumerate(entity):
        if c.isdigit():
            d = next(stream) % 10
            out.append(str(6 + d % 4 if label == "phone_in" and k == 0 else d))
        elif c.isalpha():
            out.append(chr(97 + next(stream) % 26))
        else:
            out.append(c)
    return "".join(out)


def in_format(value: str, label: str, made: str) -> str:
    """The canonical surrogate ``made`` in the spelling of the mention ``value``."""
    if label == "email":
        return made.upper() if value.isupper() else made
    if label == "name":
        words = made.split()
        if "," in value:
            n = len(value.split(",", 1)[0].split())
            words = [*words[-n:-1], words[-1] + ",", *words[:-n]] if n < len(words) else words
        return " ".join(w.upper() if value.isupper() else w[:1].upper() + w[1:] for w in words)
    letters = iter(made if label != "address" else re.sub(r"\s", "", made))
    skip = max(0, len(re.findall(r"[A-Za-z0-9]", value.translate(_PLAIN))) - len(made)) if label == "phone_in" else 0
    out = []
    for c in value:
        if not c.isalnum():
            out.append(c)
        elif skip:  # a prefix keeps its digits
            skip -= 1
            out.append(c)
        else:
            x = next(letters, "0")
            out.append(x.upper() if c.isupper() else x)
    return "".join(out)


def surrogates(items: DataFrame, key: str, max_rounds: int = 20) -> DataFrame:
    """``(label, entity, made)``: one surrogate for each distinct entity, all different and none a real entity.

    The same key gives the same surrogates for the same entities; one-time codes, of which there are few, may run out of
    free codes and then get longer ones.
    """
    secret = key.encode()

    @F.pandas_udf(T.StringType())
    def draw(label: pd.Series, entity: pd.Series, gender: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, e + ("0" * (a // 5) if k == "otp" else ""), g, secret, a) for k, e, g, a in zip(label, entity, gender, attempt)])

    entities = stage(items.groupBy("label", "entity").agg(F.min("gender").alias("gender")), "entities")
    real = entities.select("label", F.col("entity").alias("made"), F.lit(True).alias("is_real"))
    left = entities.withColumn("attempt", F.lit(0))
    done: DataFrame | None = None
    for _ in range(max_rounds):
        drawn = left.withColumn("made", draw("label", "entity", "gender", "attempt")).join(real, ["label", "made"], "left")
        if done is not None:
            drawn = drawn.join(done.select("label", "made", F.lit(True).alias("used")), ["label", "made"], "left")
        else:
            drawn = drawn.withColumn("used", F.lit(None).cast("boolean"))
        first = F.row_number().over(W.partitionBy("label", "made").orderBy("entity")) == 1
        drawn = stage(drawn.withColumn("ok", first & F.col("is_real").isNull() & F.col("used").isNull()), "drawn")
        fine = drawn.where("ok").select("label", "entity", "made")
        done = fine if done is None else done.unionByName(fine)
        left = drawn.where("NOT ok").select("label", "entity", "gender", (F.col("attempt") + 1).alias("attempt"))
        if left.isEmpty():
            return done
    raise RuntimeError(f"surrogates still collide after {max_rounds} rounds")


@F.pandas_udf(T.StringType())
def _rewrite(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, found in zip(text, spans):
        if found is not None and len(found):
            parts, at = [], 0
            for s in sorted(found, key=lambda s: s["start_pos"]):
                parts += [t[at : s["start_pos"]], f"[{s['label'].upper()} {in_format(s['value'], s['label'], s['made'])}]"]
                at = s["end_pos"]
            t = "".join([*parts, t[at:]])
        out.append(t)
    return pd.Series(out)


def replacements(texts: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """``(tab, row_key, label, start_pos, end_pos, value, made)``: every item with the surrogate that takes its place."""
    items = stage(personal_items(texts, registry), "items")
    return items.join(surrogates(items, key), ["label", "entity"]).select("tab", "row_key", "label", "start_pos", "end_pos", "value", "made")


def pseudonymised(texts: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """``(tab, row_key, text, n_items)``: every text, its items replaced by placeholders such as ``[PAN QWXYZ1234K]``.

    Null texts stay null. A row that comes twice comes once, with the text of the smallest hash.
    """
    once = one_delivery(texts.where("row_key IS NOT NULL").select("tab", "row_key", "text"), "tab", "row_key")
    spans = replacements(once, registry, key).groupBy("tab", "row_key").agg(F.collect_list(F.struct("start_pos", "end_pos", "label", "value", "made")).alias("spans"))
    return once.join(spans, ["tab", "row_key"], "left").select("tab", "row_key", _rewrite("text", "spans").alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_items"))


def corpus_texts(raw_docs: DataFrame, golden_qa: DataFrame) -> DataFrame:
    return raw_docs.select(F.lit("raw_docs").alias("tab"), F.col("raw_id").alias("row_key"), F.col("extracted_text").alias("text")).unionByName(golden_qa.select(F.lit("golden_qa").alias("tab"), F.col("id").alias("row_key"), F.col("query").alias("text")))
