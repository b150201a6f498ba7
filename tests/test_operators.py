import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import intent as I
from loomwright.functions import pii as P
from loomwright.functions import text as X
from loomwright.operators import answers as A
from loomwright.operators import blocks as B
from loomwright.operators import chunking as C
from loomwright.operators import registry as R
from loomwright.operators import store as S
from loomwright.operators import vectors as V
from loomwright.operators.components import connected_components
from loomwright.sources.html import parse
from loomwright.streaming import guard as G


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def test_numbers(spark):
    check = X.numbers_supported(F.col("a"), F.col("e"))
    assert one(spark, check, a="it is 0.52%", e="ratio 0.52 a year")
    assert not one(spark, check, a="it is 0.52%", e="ratio 10.52 a year")
    assert one(spark, check, a="₹ 1,000", e="at least 1000 rupees")
    assert one(spark, check, a="no number", e=None)


def test_sentences(spark):
    assert one(spark, X.first_sentences(F.col("t"), 2), t="Load is 1.00% p.a. for a year. Then none. More.") == "Load is 1.00% p.a. for a year. Then none."
    assert one(spark, X.first_sentences(F.col("t"), 3), t="One only") == "One only"


def test_word_count_of_nothing(spark):
    assert one(spark, X.word_count(F.col("t")), t="") == 0
    assert one(spark, X.word_count(F.col("t")), t=" a\n b ") == 2


def test_collapsed(spark):
    assert one(spark, X.collapsed("t"), t="a – “ﬁne​”") == 'a - "fine"'


def test_rendered_is_strict(spark):
    assert one(spark, X.rendered("see {link} now", link=F.col("t")), t="x") == "see x now"
    with pytest.raises(KeyError):
        X.rendered("see {link}", other=F.lit("x"))


def test_without_urls(spark):
    assert one(spark, X.without_urls(F.col("t")), t="See [the fee](https://a.example/x) at https://b.example/y now") == "See the fee at now"


def test_pii_order_and_masks(spark):
    q = "PAN ABCDE1234F and 9876543210"
    assert one(spark, P.first_label(F.col("t")), t=q) == "pan"
    assert one(spark, P.first_masked(F.col("t")), t=q) == "PAN [redacted] and 9876543210"
    assert one(spark, P.masked(F.col("t")), t=q) == "PAN [redacted] and [redacted]"
    assert one(spark, P.first_label(F.col("t")), t="lock-in of 18 months") is None
    assert one(spark, F.array_join(P.all_labels(F.col("t")), ","), t="it returned 53.830423188357") == ""
    assert one(spark, P.merged_masked("t"), t="call 9876543210 or 1234567890123456") == "call [redacted] or [redacted]"


def test_intent_precedence(spark):
    kind = I.intent(F.col("t"))
    assert one(spark, kind, t="should i buy? my pan is ABCDE1234F") == "PII"
    assert one(spark, kind, t="Should I buy gold?") == "ADVICE"
    assert one(spark, kind, t="Recipe for soup") == "OUT_OF_SCOPE"
    assert one(spark, kind, t="Which benchmark does it follow?") == "FACTUAL"


def test_longest_alias_then_first(spark):
    assert one(spark, I.category(F.col("t")), t="Small Cap or Large Cap") == "small_cap"
    assert one(spark, I.category(F.col("t")), t="elss tax saver") == "elss"
    assert one(spark, I.category(F.col("t")), t="nothing") is None


def test_registry_rules(spark):
    good = ("a", "https://ok.example/x", "official", "S Fund", "s", "faq", "no", "yes", "", "", "")
    rows = [good, ("", *good[1:]), ("b", "https://off.example/", *good[2:]), ("c", good[1], "blog", *good[3:]), ("d", good[1], "aggregator", *good[3:]), ("e", *good[1:3], "T Fund", *good[4:]), ("f", *good[1:5], "poem", *good[6:]), ("g", *good[1:6], "maybe", *good[7:]), ("h", *good[1:]), ("h", *good[1:])]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in R.COLUMNS))
    found = {(r["source_id"], r["rule"]) for r in R.violations(df, ["ok.example"], ["S Fund"]).collect()}
    assert found == {("", "empty_id"), ("b", "host"), ("c", "authority"), ("d", "citable_aggregator"), ("e", "scheme"), ("f", "doc_type"), ("g", "truth_value"), ("h", "repeated_id")}


def test_registry_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(",".join(R.COLUMNS) + "\n" + 'a,https://x.example,official,,,faq,,true,,,"x, y"\n')
    assert R.read_registry(spark, str(path)).first().asDict()["scheme"] == ""
    path.write_text("source_id,url\na,b\n")
    with pytest.raises(ValueError):
        R.read_registry(spark, str(path))


def test_mmr_is_the_greedy_choice(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for q in range(4):
        vecs, scores = rng.standard_normal((20, 6)).astype("float32"), np.sort(rng.random(20))[::-1]
        rows += [(f"q{q}", i, float(scores[i]), vecs[i].tolist()) for i in range(20)]
        unit = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
        picked = [0]
        while len(picked) < 5:
            rest = [i for i in range(20) if i not in picked]
            picked.append(max(rest, key=lambda i: (0.7 * scores[i] - 0.3 * max(unit[i] @ unit[j] for j in picked), -i)))
        want[f"q{q}"] = picked
    rows.append(("null", 1, None, None))
    got: dict = {}
    for r in V.mmr(spark.createDataFrame(rows, "qid string, id long, score double, vec array<float>")).orderBy("pick").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == want | {"null": [1]}


def test_knn_plan_limits_before_the_shuffle(spark):
    q = spark.range(10).selectExpr("id AS qid", "id % 2 AS category", "array(1.0f, 2.0f) AS qvec")
    r = spark.range(1000).selectExpr("id", "id % 2 AS category", "array(cast(id AS float), 1.0f) AS vec")
    plan = V.knn(q, r, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def blocks(spark, rows):
    return spark.createDataFrame([("d", i, k, t, level) for i, (k, t, level) in enumerate(rows)], "doc_id string, pos int, kind string, text string, level int")


def test_block_windows(spark):
    b = blocks(spark, [("heading", "A", 1), ("paragraph", "x", 0), ("paragraph", "x", 0), ("heading", "B", 3), ("paragraph", "NAV", 0), ("paragraph", "12.5", 0), ("paragraph", "All rights reserved", 0), ("paragraph", "after", 0)])
    assert [r["section"] for r in B.sections(b).orderBy("pos").collect()] == ["A"] * 8
    assert [r["char_start"] for r in B.line_offsets(b).orderBy("pos").collect()][:4] == [0, 4, 6, 8]
    kept = B.paired_facts(B.before_footer(B.without_repeats(b))).orderBy("pos", "part").collect()
    assert [(r["kind"], r["text"]) for r in kept] == [("heading", "A"), ("paragraph", "x"), ("heading", "B"), ("paragraph", "NAV"), ("fact", "NAV: 12.5")]


def doc(spark, rows, key="d"):
    entry = [(i, k, t, level) for i, (k, t, level) in enumerate(rows)]
    return spark.createDataFrame([(key, "s", "https://a.example/x", entry, "2025-01-01")], "doc_id string, source_id string, url string, blocks array<struct<pos:int,kind:string,text:string,level:int>>, retrieved_at string")


def test_chunks_keep_the_limits(spark):
    long = " ".join(f"word{i}" for i in range(600)) + "."
    d = doc(spark, [("heading", "Fees", 1), ("paragraph", long, 0), ("table_row", "a | b", 0), ("fact", "NAV: 12", 0), ("heading", "How long is the lock-in here?", 3), ("paragraph", "Three years from allotment, and no less than that for anyone.", 0)])
    chunks = C.chunked(d).orderBy("chunk_index").collect()
    assert max(c["token_count"] for c in chunks) <= C.HARD
    assert any(c["faq_question"] == "How long is the lock-in here?" and c["block_kind"] == "faq" for c in chunks)
    assert len({c["chunk_id"] for c in chunks}) == len(chunks)
    assert [r["chunk_id"] for r in C.chunked(d).orderBy("chunk_index").collect()] == [c["chunk_id"] for c in chunks]
    registry = spark.createDataFrame([("other", "https://b.example/y")], "source_id string, url string")
    made = C.chunked(d)
    assert {r["invariant"]: r["broken"] for r in C.invariants(d, made, registry).collect()} == dict.fromkeys(("too_long", "repeated_id", "no_chunk", "foreign_url", "block_lost"), 0)
    broken = made.withColumn("text", F.when(F.col("chunk_index") == 0, F.lit("see https://b.example/y")).otherwise(F.col("text"))).withColumn("token_count", F.lit(999))
    found = {r["invariant"]: r["broken"] for r in C.invariants(d, broken.union(broken), registry).collect()}
    assert found["too_long"] and found["repeated_id"] and found["foreign_url"] and found["block_lost"]
    assert {r["invariant"]: r["broken"] for r in C.invariants(d, made.limit(0), registry).collect()}["no_chunk"] == 1


def test_overlap_is_carried(spark):
    rows = [("paragraph", " ".join(f"w{i}x{j}" for j in range(20)) + ".", 0) for i in range(24)]
    first, second = C.chunked(doc(spark, rows)).orderBy("chunk_index").collect()[:2]
    shared = set(first["text"].split("\n")[:-1]) & set(second["text"].split("\n")[:-1])
    assert 1 <= sum(len(x.split()) for x in shared) <= C.OVERLAP


def test_empty_documents(spark):
    d = doc(spark, []).union(doc(spark, [("paragraph", " ", 0)], "e"))
    assert C.chunked(d).count() == 0


def test_store_upsert_is_idempotent(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "store"))
    with pytest.raises(S.StoreMissing):
        store.read()
    rows = spark.createDataFrame([("a", "x", False), ("b", "y", True)], "chunk_id string, text string, discover_only boolean")
    assert store.upsert(rows) == 2
    assert store.upsert(rows) == 2
    assert store.upsert(spark.createDataFrame([("b", "z", True), ("c", "w", None)], rows.schema)) == 3
    assert {r["chunk_id"]: r["text"] for r in store.read().collect()} == {"a": "x", "b": "z", "c": "w"}
    assert store.upsert(rows.limit(1), force=True) == 1
    plan = store.read().where("NOT discover_part")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(discover_part" in plan


def test_stream_upserts_and_guards(spark, tmp_path):
    spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chunk_id string, text string").parquet(str(tmp_path / "in"))
    store = S.Store(spark, str(tmp_path / "store"))
    G.upsert_batches(stream, store, str(tmp_path / "c"))
    G.upsert_batches(stream, store, str(tmp_path / "c"))
    assert store.count() == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_html(spark):
    page = b"<html><nav><a>Menu</a></nav><div class='cookie-bar'>We set cookies</div><main><h2>Fees</h2><p>One<p>Two <b>bold</b><table><tr><td>a</td><td>b</td></tr></table><ul><li>x<li>y</ul></main><footer>end</footer>"
    got = [(b["kind"], b["text"], b["level"]) for b in parse(page)]
    assert got == [("heading", "Fees", 2), ("paragraph", "One", 0), ("paragraph", "Two bold", 0), ("table_row", "a | b", 0), ("list_item", "x", 0), ("list_item", "y", 0)]
    assert parse(b"") == [] and parse(None) == [] and "Menu" in [b["text"] for b in parse(page, True)]


def test_payloads(spark):
    raws = ['{"answer":"a","source_id":"s","off_topic":false}', "no json", '{"answer":"a","source_id":"s"}', '{"answer":"a","source_id":"s","off_topic":"true"}', '{"off_topic":true,"answer":"x"}', '{"answer":" ","source_id":"s","off_topic":false}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [(r["p"]["answer"], r["p"]["off_topic"], r["p"]["error"]) for r in df.select("i", A.parsed_payload(F.col("raw")).alias("p")).orderBy("i").collect()]
    assert got == [("a", False, None), ("", False, "invalid_json"), ("", False, "schema"), ("", False, "schema"), ("", True, None), ("", False, "schema")]


def test_finalised_gates(spark):
    hit = "array(named_struct('source_id', 's', 'text', 'the ratio is 0.52%', 'retrieved_at', '2025-01-01'))"
    rows = [("ok", "It is 0.52%.", "s", True), ("wrong", "It is 7.52%.", "s", True), ("claim", "It outperforms all.", "s", True), ("foreign", "It is 0.52%.", "t", True), ("weak", "It is 0.52%.", "s", False)]
    df = spark.createDataFrame(rows, "qid string, answer string, source_id string, grounded boolean").selectExpr("*", f"{hit} AS hits", "false AS off_topic", "cast(null AS string) AS error")
    sources = spark.createDataFrame([("s", "https://a.example", "2025-02-02"), ("t", "https://b.example", "")], "source_id string, url string, retrieved_at string")
    got = {r["qid"]: (r["status"], r["url"]) for r in A.finalised(df, sources).collect()}
    assert got == {"ok": ("ANSWERED", "https://a.example"), "wrong": ("NO_GROUNDING", None), "claim": ("REFUSED_PERFORMANCE", None), "foreign": ("NO_GROUNDING", None), "weak": ("NO_GROUNDING", None)}
