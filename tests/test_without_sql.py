"""Queries without SQL against brute force over the smallest tables."""

import collections
import os
import re
import unicodedata

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwright.functions import pii as P
from loomwright.functions import text as X
from loomwright.operators import chunking as C
from loomwright.operators import evaluation as E
from loomwright.operators import store as S
from loomwright.operators import vectors as V
from loomwright.sources import html as H
from loomwright.sources import registered as D
from loomwright.sources.shared import one_delivery

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def rows(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def got(spark):
    kept = {}

    def run(name):
        if name not in kept:
            kept[name] = [r.asDict(recursive=True) for r in entry.queries()[name](spark, DATA).collect()]
        return kept[name]

    return run


@needs_data
def test_blocks_are_in_the_pages_text(got):
    text = {r["raw_id"]: " ".join((r["extracted_text"] or "").split()) for r in rows("raw_docs")}
    found = [b for b in got("page_blocks") if text[b["raw_id"]] and b["kind"] not in ("table_row", "fact")]
    squeezed = {k: re.sub(r"\W+", "", v) for k, v in text.items()}
    assert len(found) > 500
    assert sum(re.sub(r"\W+", "", b["text"]) in squeezed[b["raw_id"]] for b in found) >= 0.98 * len(found)
    assert not any("�" in b["text"] and "�" not in text[b["raw_id"]] for b in found)
    for r in got("chrome_retention"):
        assert r["after"] <= r["before"] and r["warning"] == (r["after"] < 0.5 * r["before"])


@needs_data
def test_corpus_identifiers(got):
    shapes = {"pan": r"\b[A-Z]{5}\d{4}[A-Z]\b", "ifsc": r"\b[A-Z]{4}0[A-Z0-9]{6}\b"}
    labels = {r["raw_id"]: r["labels"] for r in got("corpus_pii")}
    for r in rows("raw_docs"):
        if r["extracted_text"] is not None:
            assert {k for k, p in shapes.items() if re.search(p, r["extracted_text"], re.A)} == set(labels[r["raw_id"]]) & set(shapes)


@needs_data
def test_sentences_and_plain_text(got):
    docs = {r["doc_id"]: r["text"] for r in rows("documents") if r["text"]}
    short = {r["doc_id"]: r for r in got("short_documents")}
    for k, t in docs.items():
        words, n = t.split(), 0
        for i, w in enumerate(words):
            core = w.rstrip("\"')]”’")
            stem = re.sub(r"^\W+", "", core[:-1].lower())
            n += i == len(words) - 1 or (core[-1:] in ".!?" and len(w) - len(core) <= 1 and not (core.endswith(".") and core == w and (re.search(r"(?:^|\W)[a-z]$", stem) or re.split(r"\W", stem)[-1] in X.SHORTENED)))
        assert abs(short[k]["sentences"] - n) <= 0.03 * n + 1, t
    plain = {(r["doc_id"], r["pos"]): r["text"] for r in got("collapsed_text")}
    marks = {"“": '"', "”": '"', "‘": '"', "’": '"', "–": "-", "—": "-", "‒": "-", "​": ""}
    for d in rows("clean_docs"):
        for b in d["blocks"] or []:
            if b["text"] is not None:
                t = "".join(marks.get(c, c) for c in unicodedata.normalize("NFKC", b["text"]))
                assert plain[d["doc_id"], b["pos"]] == " ".join(t.split())


@needs_data
def test_chunks_lose_nothing(got):
    docs = {d["doc_id"]: d["blocks"] or [] for d in rows("clean_docs")}
    chunks = collections.defaultdict(list)
    for c in got("documents_chunked"):
        chunks[c["doc_id"]].append(c)
        assert c["token_count"] == len(c["text"].split()) <= C.HARD and c["char_start"] < c["char_end"]
    for k, blocks in docs.items():
        words = collections.Counter(w for b in blocks for w in (b["text"] or "").split())
        held = collections.Counter(w for c in chunks[k] for w in c["text"].split())
        assert not words - held
        assert sorted(c["chunk_index"] for c in chunks[k]) == list(range(len(chunks[k])))
    assert {r["invariant"]: r["broken"] for r in got("chunk_invariants")} == dict.fromkeys(("too_long", "repeated_id", "no_chunk", "foreign_url", "block_lost"), 0)
    assert all(r["wanted"] == r["found"] for r in got("block_coverage"))


@needs_data
def test_ingest_and_its_manifest(got):
    usable = {r["raw_id"]: (r["source_id"] or "").lower() for r in rows("raw_docs") if r["raw_bytes"] and r["status"] in ("ok", "cached")}
    made = got("pages_ingested")
    assert {c["doc_id"] for c in made} <= set(usable) and not any(re.search(r"\b[A-Z]{5}\d{4}[A-Z]\b", c["text"]) for c in made)
    per_source = collections.Counter(usable[c["doc_id"]] for c in made)
    pages = collections.Counter(s for s in {r["raw_id"]: (r["source_id"] or "").lower() for r in rows("raw_docs")}.values())
    for r in got("ingest_manifest"):
        assert (r["pages"], r["chunks"]) == (pages[r["source_id"]], per_source[r["source_id"]]) and '"chunking":{"body":220' in r["json"]
    parity = got("store_parity")[0]
    stored = {r["chunk_id"] for r in rows("chunks") if r["chunk_id"]}
    produced = {c["chunk_id"] for c in got("documents_chunked")}
    assert (parity["stored"], parity["produced"], parity["missing"], parity["left_over"], parity["state"]) == (len(stored), len(produced), len(produced - stored), len(stored - produced), "STALE")


@needs_data
def test_mmr_picks(got):
    hits = collections.defaultdict(list)
    for h in rows("hits"):
        if h["qid"] is not None:
            hits[h["qid"]].append(h)
    picks = collections.defaultdict(dict)
    for r in got("mmr_picks"):
        picks[r["qid"]][r["pick"]] = r["id"]
    for q, pool in hits.items():
        pool.sort(key=lambda h: (h["score"] is None, -(h["score"] or 0), h["hit_id"]))
        pool = pool[: V.POOL]
        vec = [np.array(h["embedding"] or [0.0] * 64) for h in pool]
        unit = [v / (np.linalg.norm(v) or 1) for v in vec]
        score = [-1.0 if h["score"] is None else h["score"] for h in pool]
        taken = [0]
        while len(taken) < min(V.KEEP, len(pool)):
            rest = [i for i in range(len(pool)) if i not in taken]
            taken.append(max(rest, key=lambda i: (round(0.7 * score[i] - 0.3 * max(unit[i] @ unit[j] for j in taken), 9), -i)))
        assert [pool[i]["hit_id"] for i in taken] == [picks[q][k + 1] for k in range(len(taken))]


@needs_data
def test_retrieval_finds_the_most_similar_chunks(got):
    kind = {r["id"]: r["query"] for r in rows("golden_qa")}
    vec = lambda t: V.dense_embedding.func(__import__("pandas").Series([t]))[0]
    chunks = {}
    for r in rows("chunks"):
        if r["chunk_id"] and r["text"] and not r["discover_only"]:
            chunks.setdefault(r["chunk_id"], []).append(r)
    found = collections.defaultdict(list)
    for r in got("questions_retrieved"):
        found[r["qid"]].append((r["chunk_id"], r["score"]))
    assert found
    for q, list_ in found.items():
        v = vec(kind[q]).astype(float)
        best = sorted((round(float(v @ vec(c[0]["text"]).astype(float)), 6) for c in chunks.values()), reverse=True)
        assert len(list_) <= V.POOL and max(s for _, s in list_) <= best[0] + 1e-5
        for c, s in list_:
            assert any(abs(float(v @ vec(r["text"]).astype(float)) - s) < 1e-5 for r in chunks[c])


@needs_data
@pytest.mark.parametrize("name", ["answer_batch", "answers_retrieved"])
def test_answers_keep_their_gates(got, name):
    asked = {r["id"] for r in rows("golden_qa") if r["id"]}
    answers = got(name)
    urls = {r["url"] for r in rows("source_registry")}
    assert {a["qid"] for a in answers} == asked and len(answers) == len(asked)
    for a in answers:
        assert (a["status"] == "ANSWERED") == (a["url"] is not None) and (a["url"] is None or a["url"] in urls)
    pii = {a["qid"] for a in answers if a["status"] == "REFUSED_PII"}
    assert {r["id"] for r in rows("golden_qa") if re.search(r"\b[A-Z]{5}\d{4}[A-Z]\b", r["query"] or "", re.A)} <= pii


@needs_data
def test_evaluation_adds_up(got):
    checks, answers = got("answer_checks"), {a["qid"]: a for a in got("answer_batch")}
    expected = {r["id"]: r for r in rows("golden_qa")}
    for c in checks:
        a = answers[c["id"]]
        assert c["kind_ok"] == (a["status"] == expected[c["id"]]["expected_kind"])
        assert c["forbidden"] == any(f.lower() in (a["text"] or "").lower() for f in expected[c["id"]]["forbidden_terms"] or [])
        assert c["links"] == (a["url"] is not None) + len(re.findall(r"://|www\.", a["text"] or "")) and (not c["passed"] or c["kind_ok"])
    counts = collections.Counter((c["expected_kind"], c["status"]) for c in checks)
    assert {(r["expected_kind"], r["status"]): r["n"] for r in got("answer_statuses")} == counts
    assert {(r["expected_kind"], r["status"]): r["n"] for r in got("answer_rates")} == counts
    lines = [r["line"] for r in sorted(got("eval_report"), key=lambda r: r["n_line"])]
    assert lines[0] == f"Passed: {sum(c['passed'] for c in checks)} of {len(checks)}" and len(lines) == 3 + len(counts)


# smaller parts


def test_pages_in_other_encodings():
    assert H.decoded("naïve ₹".encode("utf-16")) == "naïve ₹" and H.decoded("﻿x".encode()) == "x" and H.decoded("é".encode("cp1252")) == "é"
    assert H.decoded(b"<meta charset='iso-8859-1'>caf\xe9 \x93q\x94") == "<meta charset='iso-8859-1'>café “q”" and H.decoded("é abcé".encode()[:-1]) == "é abc"
    assert "é" in H.decoded('<meta charset="koi8-x">é'.encode("cp1252"))


def test_figures_of_cards():
    page = b"<main><div class='card'><span class='label'>Exit load</span><div class='value'>1%</div></div><div class='card'><b class='title'>Riskometer</b><p class='value'>Very High</p></div><p class='value'>9%</p><div class='card'><p class='label'>Colour</p><p class='value'>7</p></div></main>"
    assert [b["text"] for b in H.parse(page) if b["kind"] == "fact"] == ["Exit load: 1%", "Riskometer: Very High"]


def test_thin_groups_and_oversized_rows():
    block = lambda kind, text, level=0: {"kind": kind, "text": text, "level": level, "pos": 0}
    made = C.pack([block("heading", "Fees", 1), block("paragraph", "See below"), block("heading", "Load", 1), block("paragraph", "The load is one percent of what is sold."), block("heading", "More", 1), block("paragraph", "Ask us")], "Source: u (retrieved d)")
    assert len(made) == 1 and made[0]["text"].startswith("# Fees\nSee below\n# Load\n") and "# More\nAsk us\nSource:" in made[0]["text"] and made[0]["block_kind"] == "section"
    long = [block("table_row", "x " * 400)]
    assert len(C.pack(long, "")) == 2
    with pytest.raises(C.OversizedRow):
        C.pack(long, "", strict=True)
    assert C.pack([block("fact", "NAV: 1"), block("table_row", "a | b")], "")[0]["block_kind"] == "fact" and C.pack(None, "") == []


def test_identifiers_are_whole_numbers():
    labels = lambda t: [(k, t[a:b]) for k, a, b in P.corpus_spans(t)]
    assert labels("53.830423188357 and 1,23,45,67,890") == []
    assert labels("ring +91 98765 43210 or 9876543210") == [("phone_in", "+91 98765 43210"), ("phone_in", "9876543210")]
    assert labels("2345 6789 0123, folio 123456789") == [("aadhaar", "2345 6789 0123"), ("account", "123456789")]
    assert labels("your OTP is 4821; a.b@mail.test") == [("otp", "4821"), ("email", "a.b@mail.test")]
    assert labels("in 2021 123456789") == [("account", "123456789")] and labels(None) == []


def test_answer_forms(spark):
    df = spark.createDataFrame([("The load is 1.00% of ₹ 1,500", ["1%"], ["2%"]), ("It is 0.50 %", ["0.5%"], []), ("none", ["1%"], None), ("ok", None, ["ok"])], "a string, e array<string>, f array<string>")
    assert [r["x"] for r in df.select(X.answer_fits(F.col("a"), F.col("e"), F.col("f")).alias("x")).collect()] == [True, True, False, False]


def test_promotion(spark):
    picked = spark.createDataFrame([("a", 1, 0.1, 1), ("a", 2, 0.05, 2), ("b", 1, 0.9, 1)], "qid string, id long, score double, pick int")
    pool = spark.createDataFrame([("a", 1, 0.1), ("a", 3, 0.8), ("b", 1, 0.9), ("b", 2, 0.95)], "qid string, id long, score double")
    assert sorted((r["qid"], r["pick"], r["id"]) for r in V.promoted(picked, pool, 0.35).collect()) == [("a", 1, 3), ("a", 2, 1), ("a", 3, 2), ("b", 1, 1)]


def test_unit_vectors_are_asserted(spark):
    df = spark.createDataFrame([([0.6, 0.8],), ([1.0, 1.0],)], "v array<float>")
    assert df.limit(1).select(V.checked_unit(F.col("v")).alias("v")).count() == 1
    with pytest.raises(Exception, match="unit length"):
        df.select(V.checked_unit(F.col("v")).alias("v")).collect()


def test_one_delivery(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4), ("c", None), ("c", None)], "k string, v int")
    assert sorted((r["k"], r["v"]) for r in one_delivery(df, "k").collect()) == [("a", 1), ("b", 3), ("c", None)]


def test_snapshots_and_golden_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "src_1.html").write_text("PAN ABCDE1234F")
    (tmp_path / "in" / "src_2.html").write_text("nothing")
    assert {r["source_id"]: (r["status"], r["http_status"], bytes(r["raw_bytes"])) for r in D.read_snapshots(spark, str(tmp_path / "in")).collect()} == {"src_1": ("cached", 0, b"PAN ABCDE1234F"), "src_2": ("cached", 0, b"nothing")}
    assert {r["source_id"]: r["changed"] for r in D.scrubbed_snapshots(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()} == {"src_1": True, "src_2": False}
    (tmp_path / "g.json").write_text('[{"id": "a", "query": "q", "expected_kind": "ANSWERED", "expected_facts": ["1%"]}]')
    assert D.read_golden(spark, str(tmp_path / "g.json")).first()["expected_facts"] == ["1%"]
    for bad in ("[]", '[{"id": "a", "query": "q"}]'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            D.read_golden(spark, str(tmp_path / "bad.json"))


def test_coverage_floor_and_lines(spark, tmp_path):
    fine = spark.createDataFrame([("paragraph", 3, 3)], "kind string, wanted long, found long")
    assert C.require_coverage(fine).count() == 1
    with pytest.raises(Exception, match="only 2 of 3"):
        C.require_coverage(fine.withColumn("found", F.lit(2).cast("long"))).collect()
    S.write_lines(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "n int, line string"), str(tmp_path / "t"), "n")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()] and sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a", "b", "c"]


def test_parity(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "chunk_id string"), spark.createDataFrame([("y",), ("x",), ("x",)], "chunk_id string")
    assert E.store_parity(a, b).first()["state"] == "CURRENT" and E.store_parity(a.limit(1), b).first()["state"] == "STALE"


def test_a_damaged_store_is_an_error(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"))
    store.upsert(spark.createDataFrame([("a", "x")], "chunk_id string, text string"))
    part = next(p for p in (tmp_path / "s" / "pointer").iterdir() if p.name.startswith("part"))
    part.write_text("no json\n")
    (tmp_path / "s" / "pointer" / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        store.upsert(spark.createDataFrame([("b", "y")], "chunk_id string, text string"))
