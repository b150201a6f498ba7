"""Page boilerplate and main content: minimum-cut labelling.

Every line of a page is a node. A classifier gives each line the cost of calling it body and of calling it furniture, which become
the capacities of its edges to the two terminals; lines that follow each other, and lines that stand in the same container
of the page's markup, are joined by smoothness edges. The minimum cut between the terminals splits the page.

The classifier is a logistic regression on hashed words and word pairs of the line and on its kind of element. It is fitted on
a bounded sample of labelled lines, drawn by hash (at most ``SAMPLE_LINES`` of each table), with labels that the data carry: containers whose role the markup states
(nav, footer, aside, main, article and class names that say so; in ``SAMPLE_PAGES`` pages of any length), and, in cleaned pages without markup, blocks whose letters
recur in a large part of their site's pages against headings, facts and rows. Those pages are counted over the whole table before lines are drawn. Everything else covers all pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import one_delivery, stage
from .repeated_lines import letter_keys
from .spark import pandas_rows
from .words import Words, fold

SAMPLE_PAGES = 2_000
#: Labelled lines of a table, and their characters, that go to the driver.
SAMPLE_LINES, SAMPLE_CHARS = 60_000, 10_000_000
HASH_BITS = 16
EPOCHS = 60
#: Log odds that a stated role adds to the classifier's.
ROLE = {"furniture": 3.0, "body": -2.0, "": 0.0}
#: Capacities of the edges between lines that follow each other, and that share a container.
NEXT, SHARED = 0.5, 1.5
LIMIT = 10.0
KINDS = ("paragraph", "heading", "list_item", "link", "row", "")

_DROP = re.compile(r"<(script|style|noscript|svg|title|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<!doctype[^>]*>", re.S | re.I)
_TOKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|([^<]+)|<")
_BOXES = frozenset("div nav header footer aside main section article body form table ul ol".split())
_ROLED = frozenset("nav header footer aside main article section div".split())
_INLINE = frozenset("b i em strong u sup sub font small mark abbr code q cite".split())
_FURNITURE = re.compile(r"(?:^|[\s_\"'=-])(?:nav|navbar|navigation|menu|footer|site[_-]footer|sidebar|breadcrumbs?|cookie|consent|share|social|related|promo|newsletter|subscribe|pagination|pager|advert|ads?|banner|toolbar|inline-share)(?=$|[\s_\"'>-])", re.I)
_BODY = re.compile(r"(?:^|[\s_\"'=-])(?:article(?:[_-]?body)?|main|content|post|entry|body[_-]?text|story)(?=$|[\s_\"'>-])", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
_MASK = {ord(c): "0" for c in "123456789"}


def decoded(raw: bytes | None) -> str:
    if not raw:
        return ""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        named = _CHARSET.search(raw[:2048])
        try:
            return raw.decode(named.group(1).decode("ascii") if named else "cp1252", "replace")
        except LookupError:
            return raw.decode("cp1252", "replace")


def _role(tag: str, attributes: str) -> str:
    if tag in ("nav", "footer", "aside", "header"):
        return "furniture"
    if tag in ("main", "article"):
        return "body"
    if attributes:
        if _BODY.search(attributes):
            return "body"
        if _FURNITURE.search(attributes):
            return "furniture"
    return ""


def markup_blocks(raw: bytes | None) -> list[tuple[str, str, int, str]]:
    """(text, kind, container, role) of the text blocks of a page, in order. Broken markup is read as far as it goes."""
    out: list[tuple[str, str, int, str]] = []
    boxes: list[tuple[str, int, str]] = [("", 0, "")]
    n_boxes, tag, buffer, cells, in_row = 0, "", [], [], False

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            if in_row:
                cells.append(text)
            else:
                kind = "heading" if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else {"a": "link", "li": "list_item"}.get(tag, "paragraph")
                out.append((text, kind, boxes[-1][1], boxes[-1][2]))

    for m in _TOKEN.finditer(_DROP.sub(" ", decoded(raw))):
        text = m.group(4)
        if text is not None:
            buffer.append(html.unescape(text) if "&" in text else text)
            continue
        name = (m.group(2) or "").lower()
        if not name or name in _INLINE:
            continue
        flush()
        closing = m.group(1) == "/"
        if name == "tr":
            if in_row and cells:
                out.append((" | ".join(cells), "row", boxes[-1][1], boxes[-1][2]))
            cells, in_row = [], not closing
            continue
        if name in _BOXES and name not in ("body", "table", "ul", "ol"):
            if closing:
                at = next((k for k in range(len(boxes) - 1, 0, -1) if boxes[k][0] == name), 0)
                if at:
                    del boxes[at:]
            else:
                attributes = m.group(3)
                if name == "div" and not attributes.strip():
                    tag = "div"  # a bare div is a paragraph as often as a box
                    boxes.append((name, boxes[-1][1], boxes[-1][2]))
                    continue
                n_boxes += 1
                boxes.append((name, n_boxes, _role(name, attributes) or boxes[-1][2]))
        if name not in ("td", "th", "br", "html", "head", "body"):
            tag = "" if closing else name
    flush()
    if cells:
        out.append((" | ".join(cells), "row", boxes[-1][1], boxes[-1][2]))
    return out


def aligned(lines: list[str], raw: bytes | None) -> list[tuple[str, int, str]]:
    """(kind, container, role) of each line of the extracted text, by order and equal text; ('', 0, '') where unknown."""
    blocks = markup_blocks(raw)
    places: dict[str, list[int]] = {}
    for k, b in enumerate(blocks):
        places.setdefault(b[0], []).append(k)
    out, at = [], 0
    for line in lines:
        text = " ".join(line.split())
        found = next((k for k in places.get(text, ()) if k >= at), None)
        if found is None:
            out.append(("row" if " | " in text else "", 0, ""))
        else:
            at = found + 1
            out.append(blocks[found][1:])
    return out


# the classifier


def features(lines: list[str], kinds: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line and hash of each word and word pair, and the dense features of each line."""
    words = Words([x.translate(_MASK) for x in lines])
    single = np.repeat(np.arange(len(lines)), np.diff(words.first))
    pairs, of = words.runs(2)
    mask = np.uint64((1 << HASH_BITS) - 1)
    at = np.r_[single, of]
    feature = np.r_[words.hash & mask, pairs & mask].astype(np.int64)
    n = np.diff(words.first)
    dense = np.zeros((len(lines), 4 + len(KINDS)))
    dense[:, 0] = 1
    dense[:, 1] = np.log1p(n)
    dense[:, 2] = [x.rstrip()[-1:] in (".", "?", "।") for x in lines]
    dense[:, 3] = n <= 4
    for k, kind in enumerate(kinds):
        dense[k, 4 + (KINDS.index(kind) if kind in KINDS else 0)] = 1
    return at, feature, dense


def scores(model: tuple[np.ndarray, np.ndarray], lines: list[str], kinds: list[str]) -> np.ndarray:
    """Log odds that each line is furniture."""
    if not lines:
        return np.zeros(0)
    at, feature, dense = features(lines, kinds)
    n = np.bincount(at, minlength=len(lines))
    return np.clip(np.bincount(at, weights=model[0][feature], minlength=len(lines)) / np.sqrt(np.maximum(n, 1)) + dense @ model[1], -LIMIT, LIMIT)


def fit(lines: list[str], kinds: list[str], labels: list[int], weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the hashed and of the dense features, by full-batch Adam. Without labels of both kinds all are 0."""
    sparse, wide = np.zeros(1 << HASH_BITS), np.zeros(4 + len(KINDS))
    y, weight = np.array(labels, dtype=float), np.array(weights, dtype=float)
    if not len(y) or y.min() == y.max():
        return sparse, wide
    at, feature, dense = features(lines, kinds)
    scale = 1 / np.sqrt(np.maximum(np.bincount(at, minlength=len(y)), 1))
    weight = weight / weight.sum()
    state = [np.zeros_like(sparse), np.zeros_like(sparse), np.zeros_like(wide), np.zeros_like(wide)]
    for step in range(1, EPOCHS + 1):
        z = np.bincount(at, weights=sparse[feature], minlength=len(y)) * scale + dense @ wide
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grads = np.bincount(feature, weights=(error * scale)[at], minlength=len(sparse)) + 1e-7 * sparse, dense.T @ error + 1e-7 * wide
        for k, (w, g) in enumerate(zip((sparse, wide), grads)):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
            w -= 0.3 * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-9)
    return sparse, wide


# the cut


def _min_cut(cost: dict[int, float], edges: dict[tuple[int, int], float]) -> set[int]:
    """Nodes on the furniture side. ``cost`` > 0: capacity from the furniture terminal, < 0: to the body terminal.
    Shortest augmenting paths on what the caller couldn't decide, usually a few nodes."""
    residual: dict[int, dict[int, float]] = {v: {} for v in cost}
    for (a, b), c in edges.items():
        residual[a][b] = residual[a].get(b, 0.0) + c
        residual[b][a] = residual[b].get(a, 0.0) + c
    source = {v: c for v, c in cost.items() if c > 0}
    sink = {v: -c for v, c in cost.items() if c < 0}
    while True:
        parent: dict[int, int | None] = {v: None for v, c in source.items() if c > 1e-9}
        queue, end = list(parent), None
        for v in queue:
            if sink.get(v, 0.0) > 1e-9:
                end = v
                break
            for u, c in residual[v].items():
                if c > 1e-9 and u not in parent:
                    parent[u] = v
                    queue.append(u)
        if end is None:
            return set(parent)
        path = [end]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        flow = min(sink[end], source[path[-1]], *(residual[b][a] for a, b in zip(path, path[1:])))
        sink[end] -= flow
        source[path[-1]] -= flow
        for a, b in zip(path, path[1:]):
            residual[b][a] -= flow
            residual[a][b] += flow


def cut_page(cost: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Which lines are furniture, by the minimum cut. Lines whose own cost exceeds all their edges are settled first: they
    lie on their side in every minimum cut, and their edges become costs of their neighbours."""
    n = len(cost)
    left = np.arange(n - 1)
    ends = [np.stack([left, left + 1, np.full(n - 1, NEXT)], axis=1)] if n > 1 else []
    order = np.lexsort((np.arange(n), box))
    a, b = order[:-1], order[1:]
    same = (box[a] == box[b]) & (box[a] > 0)
    if same.any():
        ends.append(np.stack([a[same], b[same], np.full(same.sum(), SHARED)], axis=1))
    if not ends:
        return cost > 0
    edge = np.concatenate(ends)
    x, y, w = edge[:, 0].astype(int), edge[:, 1].astype(int), edge[:, 2]
    cost, label = cost.astype(float).copy(), np.zeros(n, dtype=np.int8)
    while True:
        open_ = (label[x] == 0) & (label[y] == 0)
        strength = np.bincount(x[open_], weights=w[open_], minlength=n) + np.bincount(y[open_], weights=w[open_], minlength=n)
        sure = (label == 0) & (np.abs(cost) >= strength)
        if not sure.any():
            break
        label[sure] = np.where(cost[sure] > 0, 1, -1)
        p, q = sure[x] & open_ & ~sure[y], sure[y] & open_ & ~sure[x]
        np.add.at(cost, y[p], label[x[p]] * w[p])
        np.add.at(cost, x[q], label[y[q]] * w[q])
    rest = np.flatnonzero(label == 0)
    if len(rest):
        inner = {(int(a), int(b)): 0.0 for a, b in zip(x[open_], y[open_])}
        for a, b, c in zip(x[open_], y[open_], w[open_]):
            inner[int(a), int(b)] += float(c)
        furniture = _min_cut({int(v): float(cost[v]) for v in rest}, inner)
        label[rest] = [1 if int(v) in furniture else -1 for v in rest]
    return label > 0


# pages


def _lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def _raw_pages(model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pandas_rows(frames, 200):
            pages = [_lines(t) for t in frame["extracted_text"]]
            places = [aligned(p, raw) for p, raw in zip(pages, frame["raw_bytes"])]
            flat = [x for p in pages for x in p]
            cost = scores(model, flat, [k for p in places for k, _, _ in p])
            ids, numbers, at = [], [], 0
            for key, page, place in zip(frame["raw_id"], pages, places):
                if page:
                    own = cost[at : at + len(page)] + np.array([ROLE[r] for _, _, r in place])
                    own[[not x.strip() for x in page]] = 0
                    gone = np.flatnonzero(cut_page(own, np.array([b for _, b, _ in place])))
                    ids += [key] * len(gone)
                    numbers += gone.tolist()
                at += len(page)
            yield pd.DataFrame({"tab": "raw_docs", "row_key": ids, "line_no": numbers})

    return run


def _clean_pages(model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pandas_rows(frames, 200):
            pages = [list(zip(p, k, t)) for p, k, t in zip(frame["pos"], frame["kind"], frame["line"])]
            flat = [x for p in pages for x in p]
            cost = scores(model, [t or "" for _, _, t in flat], [_kind(k) for _, k, _ in flat])
            ids, numbers, at = [], [], 0
            for key, page in zip(frame["doc_id"], pages):
                if page:
                    fixed = np.array([k in ("heading", "fact", "table_row") for _, k, _ in page])
                    gone = cut_page(np.where(fixed, -LIMIT, cost[at : at + len(page)]), np.zeros(len(page), dtype=int))
                    numbers += [int(page[k][0]) for k in np.flatnonzero(gone)]
                    ids += [key] * int(gone.sum())
                at += len(page)
            yield pd.DataFrame({"tab": "clean_docs", "row_key": ids, "line_no": numbers})

    return run


def _kind(kind: str | None) -> str:
    return {"heading": "heading", "list_item": "list_item", "table_row": "row", "fact": "row"}.get(kind or "", "paragraph")


@F.pandas_udf(T.StructType([T.StructField("line", T.BinaryType()), T.StructField("words", T.IntegerType())]))
def _line_key(text: pd.Series) -> pd.DataFrame:
    keys = [k for rows in pandas_rows([text.to_frame("text")], 20_000, "text", 1_000_000) for k in letter_keys([fold(x).replace("\n", " ") for x in rows["text"]])]
    return pd.DataFrame({"line": [k or b"" for k in keys], "words": [len(x.split()) for x in text]})


def _stated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in pandas_rows(frames, 200):
        out = []
        for h, raw, text in zip(frame["h"], frame["raw_bytes"], frame["extracted_text"]):
            page = _lines(text)
            for k, (line, (kind, _, role)) in enumerate(zip(page, aligned(page, raw))):
                if role and line.strip():
                    out.append((h, k, line, kind, int(role == "furniture")))
        yield pd.DataFrame(out, columns=["h", "k", "line", "kind", "label"])


def stated_lines(raw_docs: DataFrame, sample_pages: int) -> DataFrame:
    """``(h, chars, line, kind, label)`` of lines whose role the markup states, from pages by the hash of their id."""
    keyed = raw_docs.where("raw_id IS NOT NULL AND raw_bytes IS NOT NULL AND extracted_text IS NOT NULL").withColumn("h", F.xxhash64("raw_id", F.lit(7)))
    some = keyed.select("h").distinct().orderBy("h").limit(sample_pages).agg(F.max("h").alias("h")).first()["h"]
    pages = keyed.where(F.col("h") <= some if some is not None else F.lit(False)).select("h", "raw_bytes", "extracted_text")
    lines = pages.mapInPandas(_stated, "h long, k long, line string, kind string, label int")
    return lines.select(F.xxhash64("h", "k", "line").alias("h"), F.length("line").alias("chars"), "line", "kind", "label").distinct()


def recurring_lines(clean_docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled lines ``(h, chars, label)`` of all pages, and ``(h, line, kind)`` of all lines. A line's label is that of its
    letters in the whole of its source; a line that a page has several times is one."""
    pages = clean_docs.where("doc_id IS NOT NULL AND blocks IS NOT NULL").select("doc_id", "source_id", "blocks")
    n = pages.groupBy("source_id").agg(F.countDistinct("doc_id").alias("n"))
    blocks = pages.select("doc_id", "source_id", F.explode("blocks").alias("b")).where("b.text <> ''")
    lines = blocks.select("doc_id", "source_id", "b.kind", F.col("b.text").alias("line"), F.xxhash64("doc_id", "b.pos", "b.text").alias("h"))
    keyed = lines.select("doc_id", "source_id", F.coalesce(F.col("kind").isin("heading", "fact", "table_row"), F.lit(False)).alias("own"), F.length("line").alias("chars"), "h", _line_key("line").alias("k"))
    one = keyed.groupBy("source_id", F.col("k.line").alias("line"), "doc_id").agg(F.min(F.struct("h", "own", "chars", F.col("k.words").alias("words"))).alias("x"))
    one = stage(one.select("source_id", "line", "x.*"), "page-lines")
    held = one.groupBy("source_id", "line").agg(F.count(F.lit(1)).alias("held"))
    held = held.withColumnsRenamed({"source_id": "s", "line": "l"})
    counted = one.join(held, F.col("source_id").eqNullSafe(F.col("s")) & (F.col("line") == F.col("l")))
    counted = counted.join(n.withColumnRenamed("source_id", "of"), F.col("source_id").eqNullSafe(F.col("of")))
    label = F.when(F.col("own"), 0).when((F.col("held") >= 5) & (F.col("held") >= 0.15 * F.col("n")), 1).when((F.col("words") >= 15) & (F.col("held") <= 2), 0)
    return counted.where("words > 0").select("h", "chars", label.alias("label")).where("label IS NOT NULL"), lines.select("h", "line", "kind")


def _drawn(labelled: DataFrame, sample_lines: int) -> pd.DataFrame:
    """The first lines by hash, as many as there is room for on the driver."""
    first = labelled.select("h", "chars", "label").orderBy("h", "label").limit(sample_lines).toPandas()
    return first[np.r_[0, np.cumsum(first["chars"].to_numpy())][: len(first)] < SAMPLE_CHARS]


def fit_model(raw_docs: DataFrame, clean_docs: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_lines: int = SAMPLE_LINES) -> tuple[np.ndarray, np.ndarray]:
    """The line classifier, from at most ``sample_lines`` labelled lines of either table."""
    spark = clean_docs.sparkSession
    stated = stage(stated_lines(raw_docs, sample_pages), "stated-lines")
    labelled, texts = recurring_lines(clean_docs)
    parts = []
    for some, of, kind in ((_drawn(stated, sample_lines), stated, lambda k: k), (_drawn(labelled, sample_lines), texts, _kind)):
        if len(some):
            labels = spark.createDataFrame(some[["h", "label"]], "h long, label int")
            rows = of.select("h", "line", "kind").where(F.col("h") <= int(some["h"].max())).join(F.broadcast(labels), "h").groupBy("h").agg(F.min(F.struct("line", "kind", "label")).alias("x")).select("h", "x.*").orderBy("h").toPandas()
            parts.append(rows.assign(kind=[kind(k) for k in rows["kind"]]))
    if not parts:
        return fit([], [], [], [])
    drawn = pd.concat(parts, ignore_index=True)
    return fit(drawn["line"].tolist(), drawn["kind"].tolist(), drawn["label"].tolist(), [1.0] * len(drawn))


def furniture_lines(raw_docs: DataFrame, clean_docs: DataFrame) -> DataFrame:
    """``(tab, row_key, line_no)``: lines to drop, of extracted_text split at line feeds and of blocks by pos.

    Null texts, pages and blocks have no lines; blank lines stay unless their neighbours go. A page that comes twice has
    its lines once (the union, where its rows differ).
    """
    model = fit_model(raw_docs, clean_docs)
    out = "tab string, row_key string, line_no long"
    one = raw_docs.where("raw_id IS NOT NULL AND extracted_text IS NOT NULL").select("raw_id", "raw_bytes", "extracted_text").mapInPandas(_raw_pages(model), out)
    blocks = F.array_sort(F.transform(F.filter("blocks", lambda b: b.isNotNull() & b["pos"].isNotNull()), lambda b: F.struct(b["pos"].cast("long").alias("pos"), b["kind"].alias("kind"), b["text"].alias("text"))))
    ordered = clean_docs.where("doc_id IS NOT NULL AND blocks IS NOT NULL").select("doc_id", blocks.alias("b"))
    two = ordered.select("doc_id", F.col("b.pos").alias("pos"), F.col("b.kind").alias("kind"), F.col("b.text").alias("line")).mapInPandas(_clean_pages(model), out)
    return one.unionByName(two).distinct()


def main_body(raw_docs: DataFrame, clean_docs: DataFrame) -> DataFrame:
    """``(tab, row_key, n_dropped, text)``: every page with only its main body. Null texts stay null."""
    gone = furniture_lines(raw_docs, clean_docs).groupBy("tab", "row_key").agg(F.collect_list("line_no").alias("gone"))
    one = one_delivery(raw_docs.select(F.col("raw_id").alias("row_key"), F.col("extracted_text").alias("text")), "row_key")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("text")))
    one = one.select(F.lit("raw_docs").alias("tab"), "row_key", lines.alias("lines"))
    two = one_delivery(clean_docs.select(F.col("doc_id").alias("row_key"), "blocks"), "row_key")
    two = two.select(F.lit("clean_docs").alias("tab"), "row_key", F.array_sort(F.transform("blocks", lambda b: F.struct(b["pos"].cast("long").alias("pos"), b["text"].alias("text")))).alias("lines"))
    kept = one.unionByName(two).join(gone, ["tab", "row_key"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<bigint>")))
    text = F.array_join(F.transform(F.filter("lines", lambda b: ~F.coalesce(F.array_contains("gone", b["pos"]), F.lit(False))), lambda b: b["text"]), "\n")
    return kept.select("tab", "row_key", F.size("gone").alias("n_dropped"), text.alias("text"))
