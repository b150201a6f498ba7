"""The training-data operators against brute force, and on odd input."""

import collections
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import contamination, mixing, near_duplicates, neighbours, page_body, personal_data, repeated_lines, spam_pages, splitting, varied_subset
from loomwright.llm.words import WHITE, Words

regex = pytest.importorskip("regex")
BLOCKS = "array<struct<pos:int,kind:string,text:string,level:int>>"
CLEAN = f"doc_id string, source_id string, url string, blocks {BLOCKS}, text string, warnings array<string>, retrieved_at string"


def words(t):
    return regex.findall(r"[\p{L}\p{Nd}]+", regex.sub(r"\p{Cf}+", "", unicodedata.normalize("NFKC", t or "")).lower())


def pages(spark, rows):
    """rows of (doc_id, source_id, [(kind, text), ...])"""
    return spark.createDataFrame([(d, s, None, None if b is None else [(i, k, t, 0) for i, (k, t) in enumerate(b)], None, None, None) for d, s, b in rows], CLEAN)


def test_words_match_the_definition():
    texts = ["Ab, c1-d!", "", None, "हिन्दी १२ x­yz ﬁne", "Ｆｕｌｌ　ｗｉｄｔｈ"]
    w = Words(texts)
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    hashes, owner = w.runs(2)
    assert collections.Counter(owner.tolist()) == {k: n - 1 for k, n in enumerate(len(words(t)) for t in texts) if n > 1}


# 1


def test_repeated_lines_are_those_of_the_definition(spark):
    rng = random.Random(3)
    rows = []
    for s, n in (("a", 30), ("b", 8), ("c", 3)):
        for k in range(n):
            body = [("paragraph", " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta".split()) for _ in range(9)))]
            if k % 4 == 0:
                body.append(("footnote", f"Updated {k}-01-2025 by Desk"))
            if k % 2:
                body.append(("list_item", "ALL  rights—reserved" if k % 3 else "All rights reserved."))
            rows.append((f"{s}{k}", s, body + [("heading", "Fees"), ("paragraph", "123 - 45")]))
    rows += [("empty", "a", []), ("null", "a", None), ("lost", None, [("paragraph", "x")]), rows[0]]
    df = pages(spark, rows)
    total, docs, at = collections.defaultdict(set), collections.defaultdict(set), []
    for d, s, b in rows:
        if s:
            total[s].add(d)
            for i, (kind, t) in enumerate(b or []):
                key = regex.sub(r"\P{L}+", "", unicodedata.normalize("NFKC", t).lower())
                if key:
                    docs[s, key].add(d)
                    at.append((d, i, kind, s, key))
    want = {(d, i) for d, i, kind, s, key in at if kind != "heading" and len(docs[s, key]) >= 5 and 5 * len(docs[s, key]) >= len(total[s])}
    assert {tuple(r) for r in repeated_lines.found_lines(df).collect()} == want and want
    cleaned = {r["doc_id"]: r for r in repeated_lines.cleaned_pages(df).collect()}
    assert set(cleaned) == {d for d, _, _ in rows} and "reserved" not in cleaned["a1"]["text"] and cleaned["a1"]["text"].endswith("123 - 45")


# 2


def pieces_ok(text, pieces, most=256, overlap=40):
    found = [m.span() for m in re.finditer(f"[^{WHITE}]+", text)]
    starts, ends = {a: k for k, (a, _) in enumerate(found)}, {b: k for k, (_, b) in enumerate(found)}
    before = None
    for p in pieces:
        a, b = starts[p["char_start"]], ends[p["char_end"]]
        assert p["text"] == text[p["char_start"] : p["char_end"]] and b - a + 1 == p["n_words"] <= most
        assert a == (0 if before is None else max(0, before + 1 - overlap))
        before = b
    assert before == len(found) - 1


def test_pieces_tile_the_text(spark):
    rng = random.Random(5)
    texts = {"a": " ".join(rng.choice(["word", "end.", "x" * 30, "line\n", "para\n\n", "wide　", "nb sp"]) for _ in range(9000)), "b": "one", "c": "  lead " + "y" * 3000 + " tail\n", "d": "z " * 256, "e": "z " * 257}
    df = spark.createDataFrame([*texts.items(), ("null", None), ("blank", " \n"), (None, "x"), ("b", "one")], "item string, text string").withColumn("n", F.lit(1)).withColumn("part", F.lit("?"))
    of_size = []
    for size in (100, 4096, 65_536):
        got = collections.defaultdict(list)
        for r in splitting.split_items(df, size=size).orderBy("item", "piece").collect():
            got[r["item"]].append(r)
        assert set(got) == set(texts)
        for k, t in texts.items():
            pieces_ok(t, got[k])
            assert [(r["piece"], r["n_pieces"]) for r in got[k]] == [(i + 1, len(got[k])) for i in range(len(got[k]))]
        assert len(got["d"]) == 1 and len(got["e"]) == 2
        of_size.append({k: [tuple(r) for r in v] for k, v in got.items()})
    assert of_size[0] == of_size[1] == of_size[2]  # where ranges begin changes nothing


def test_pieces_prefer_natural_cuts(spark):
    text = "\n\n".join(" ".join(f"w{i}" for i in range(90)) for _ in range(6))
    rows = splitting.split_items(spark.createDataFrame([("a", text)], "item string, text string")).orderBy("piece").collect()
    assert all(text[r["char_end"] : r["char_end"] + 2] == "\n\n" for r in rows[:-1])


@pytest.mark.parametrize("size", [64, 10_000])
def test_files_are_read_by_ranges(spark, tmp_path, size):
    text = " ".join(f"voilà{i}. निवेशक को\u00a0x" for i in range(3000)) + " 😀"
    raw = text.encode()
    (tmp_path / "f").write_bytes(raw)
    files = spark.createDataFrame([("f", str(tmp_path / "f"), len(raw)), ("none", str(tmp_path / "f"), 0)], "item string, path string, bytes long")
    rows = splitting.piece_offsets(splitting.file_ranges(files, size), in_bytes=True).orderBy("piece").collect()
    place = {b: k for k, b in enumerate(np.r_[0, np.cumsum([len(c.encode()) for c in text])].tolist())}
    in_chars = [r.asDict() | {"char_start": place[r["char_start"]], "char_end": place[r["char_end"]]} for r in rows]
    pieces_ok(text, [r | {"text": text[r["char_start"] : r["char_end"]]} for r in in_chars])


# 3

HOSTS = frozenset({"fund.example"})
CASES = [
    ("My PAN is ABCDE1234F.", [("pan", 10)]), ("card syyra-0227-f", [("pan", 5)]), ("IFSC lkst0440242", [("ifsc", 5)]), ("mail A.b+c@post.test now", [("email", 5)]),
    ("ira at mail dot place dot test", [("email", 0)]), ("write to care@www.fund.example", []), ("Aadhaar 2814 3220 3637 is wrong", [("aadhaar", 8)]), ("my demat is 1354512145162530", [("demat", 12)]),
    ("beneficiary IN12347691871011", [("demat", 12)]), ("Ring +91 60902-77073 after six", [("phone_in", 5)]), ("no. 09988616130", [("phone_in", 4)]), ("Folio no. 436930503655878", [("account", 10)]),
    ("debit account 4642 01187161621 instead", [("account", 14)]), ("The otp is 9593", [("otp", 11)]), ("code 673434 never expired", [("otp", 5)]), ("scheme code 118834", []), ("price of 53.830423188357", []),
    ("order LK-44120988, toll free 1800 443 6617", []), ("account of Mr. Sanjay T. Lokvandi", [("name", 15)]), ("Posted by Ilmadi, Kavya yesterday", [("name", 10)]), ("my name is Larkstone Gilt Fund", []),
    ("sent to Flat 7C, Well House Marg, Mangrove Park, Ferrygate - 625 528 and came", [("address", 8)]), ("Office at Tower 4, Harbour Quay", []), ("Regards,\nAnita Norvekar\nmenu", [("name", 9)]), ("in 2021 and ₹ 123456", []),
    ("Arun Quenshi | 6549174761 | ABCDE1234F", [("name", 0), ("phone_in", 15), ("pan", 28)]), (None, []), ("", []), ("सुनो ९८७६५४३२१०", [("phone_in", 5)]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_personal_items(text, want):
    assert [(s[2], s[0]) for s in personal_data.find(text, HOSTS)] == want


def test_surrogates_are_typed_distinct_and_coreferent(spark):
    rows = [("t", str(i), f"My PAN is ABCDE{i:04d}F, the otp is {i:04d}") for i in range(60)]
    rows += [("t", "x", "my name is Kavya Ilmadi"), ("t", "y", "Posted by Ilmadi, Kavya yesterday; Ms Kavya Ilmadi"), ("t", "n", None), ("t", "p", "card abcde-0001-f"), ("t", "x", "my name is Kavya Ilmadi")]
    texts = spark.createDataFrame(rows, "tab string, row_key string, text string").withColumn("label", F.lit(1))
    registry = spark.createDataFrame([("https://fund.example/a",), (None,)], "url string")
    got = {r["row_key"]: r["text"] for r in personal_data.pseudonymised(texts, registry, "k").collect()}
    assert got["n"] is None and len(got) == 64
    pans = {re.search(r"\[PAN ([A-Z]{5}\d{4}[A-Z])\]", got[str(i)]).group(1) for i in range(60)}
    assert len(pans) == 60 and not any(p.startswith("ABCDE") and p.endswith("F") for p in pans)
    assert re.sub("[^A-Z0-9]", "", re.search(r"\[PAN (.*?)\]", got["p"]).group(1).upper()) == re.search(r"\[PAN (.*?)\]", got["1"]).group(1)
    first, last = re.fullmatch(r"my name is \[NAME (\w+) (\w+)\]", got["x"]).groups()
    assert f"[NAME {last}, {first}]" in got["y"] and first.endswith("a") and f"Ms [NAME {first} {last}]" in got["y"]
    assert got == {r["row_key"]: r["text"] for r in personal_data.pseudonymised(texts, registry, "k").collect()}


# 4, 5


def vectors(spark, x, extra=()):
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "hit_id long, embedding array<float>, section string").withColumn("vec", F.lit("?")).withColumn("score", F.lit(0.0))


def test_neighbours_are_the_brute_force_ones(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((12, 16))
    x = np.concatenate([centre[rng.integers(0, 12, 700)] + 0.3 * rng.standard_normal((700, 16)), np.repeat(centre[:1], 20, axis=0)]).astype(np.float32)
    x[5] = 3 * x[6]
    df = vectors(spark, x, [(9000, None, None), (9001, [0.0] * 16, "s"), (9002, [float("nan")] * 16, "s"), (9003, [1.0, 2.0], "s"), (None, [1.0] * 16, "s"), (0, x[0].tolist(), "s")])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:5]}
    for reach, least in ((720 * 16, 1.0), (160 * 16, 0.9)):
        got = {(r["id"], r["other_id"]) for r in neighbours.nearest(df, reach=reach).collect()}
        assert len(got & want) >= least * len(want)
    assert neighbours.nearest(df.limit(0)).count() == 0 and neighbours.nearest(vectors(spark, x[:3])).count() == 6


def test_subset_spares_the_large_group(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.ones((1500, 16)) + 0.05 * rng.standard_normal((1500, 16)), rng.standard_normal((500, 16))]).astype(np.float32)
    df = vectors(spark, x, [(9000, None, None), (9001, [0.0] * 16, None), (0, x[0].tolist(), "s")])
    got = [r["id"] for r in varied_subset.varied_subset(df, 0.1).collect()]
    assert len(got) == len(set(got)) == 200 and sum(i < 1500 for i in got) < 60
    assert varied_subset.varied_subset(df.limit(0), 0.1).count() == 0 and varied_subset.varied_subset(df, 1.0).count() == 2002


# 6


def test_near_duplicates_are_the_brute_force_ones(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(45, 160))]
        for k in range(4):
            edited = base.copy()
            for _ in range(rng.randint(0, 12)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts[f"{g:02d}-{k}"] = " ".join(edited)
    texts |= {"short": "a b c", "copy": texts["00-0"].upper() + "!", "blank": " "}
    rows = [("t", k, v) for k, v in texts.items()] + [("t", "null", None), ("t", None, "x"), ("t", "00-0", texts["00-0"]), ("u", "00-0", texts["00-0"])]
    df = spark.createDataFrame(rows, "tab string, key string, text string").withColumn("set_id", F.lit(1)).withColumn("block", F.lit(2))
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, v in texts.items() if len(w := words(v)) >= 40}
    keys = sorted(sets)
    want = {("t", a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in near_duplicates.near_duplicate_keys(df).collect()}
    assert not got - want and len(want - got) <= 0.01 * len(want) and len(want) > 40
    group = {r["key"]: r["group_id"] for r in near_duplicates.near_duplicate_groups(df).where("tab = 't'").collect()}
    assert set(group) == set(sets) and all(group[a] == group[b] for _, a, b in got)
    assert near_duplicates.near_duplicate_keys(df.limit(0)).count() == 0


def test_a_block_larger_than_a_tile_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "TILE", 16)
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = [("t", f"k{i:03d}", " ".join([*base, f"end{i}"])) for i in range(120)]
    assert near_duplicates.near_duplicate_keys(spark.createDataFrame(rows, "tab string, key string, text string")).count() == 120 * 119 // 2


# 7


def test_the_cut_is_minimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        cost, box = rng.normal(0, 1.5, n), rng.integers(0, 3, n)
        label = page_body.cut_page(cost, box)

        def price(y):
            total = sum(-cost[i] if y[i] else cost[i] for i in range(n)) / 1.0
            total = sum((abs(cost[i]) if (cost[i] > 0) != y[i] else 0) for i in range(n))
            total += sum(page_body.NEXT for i in range(n - 1) if y[i] != y[i + 1])
            for b in {int(x) for x in box} - {0}:
                at = [i for i in range(n) if box[i] == b]
                total += sum(page_body.SHARED for i, j in zip(at, at[1:]) if y[i] != y[j])
            return total

        best = min(price([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert abs(price([bool(x) for x in label]) - best) < 1e-6


RAW = "raw_id string, raw_bytes binary, extracted_text string"


def test_furniture_of_held_out_pages(spark):
    rng = random.Random(5)
    menu, body = ["Home", "Funds", "Login", "Search", "Careers", "Help"], ["The scheme holds cash for a week.", "A load applies to the first slab.", "Units are allotted on the next day.", "The trustee reviews the cap each month."]

    def page(roles):
        a, b, c = rng.sample(menu, 4), rng.sample(body, 3), ["All rights reserved.", "Terms of use"]
        parts = [("nav" if roles else "div class=x1", a), ("main" if roles else "div class=x2", b), ("footer" if roles else "div class=x3", c)]
        html = "<html><body>" + "".join(f"<{t}>" + "".join(f"<p>{x}</p>" for x in xs) + f"</{t.split()[0]}>" for t, xs in parts)
        return html.encode(), "\n".join([*a, *b, *c])

    rows = [(f"r{i}", *page(i % 2 == 0)) for i in range(80)] + [("null", None, None), ("nobytes", None, "Home\nA load applies to the first slab."), ("broken", b"<div><p>Home<p", "Home"), (None, b"x", "x")]
    df = spark.createDataFrame(rows, RAW).withColumn("line", F.lit(1))
    got = {(r["row_key"], r["line_no"]) for r in page_body.furniture_lines(df, pages(spark, [("e", "s", None)])).collect()}
    want = {(f"r{i}", k) for i in range(80) for k in (0, 1, 2, 3, 7, 8)}
    assert len(got & want) >= 0.98 * len(want) and len({g for g in got if g[0].startswith("r")} - want) <= 5
    assert page_body.furniture_lines(df.limit(0), pages(spark, [])).count() == 0
    kept = {r["row_key"]: r["text"] for r in page_body.main_body(df, pages(spark, [])).collect()}
    assert kept["null"] is None and "Home" not in kept["r0"] and set(kept) == {r[0] for r in rows if r[0]}


def test_labels_count_the_whole_source(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdkmt" for b in "aeiou" for c in "lnrs"]
    notice, notes = "Call our desk on any working day", "Mutual funds bear market risk so read all of the papers with care before you put in money today"
    rows = []
    for i in range(60):
        body = [("paragraph", " ".join(rng.choice(vocabulary) for _ in range(20))) for _ in range(3)]
        rows.append((f"d{i}", "s", [*body, ("paragraph", notice)] + ([("paragraph", notes)] if i % 4 == 0 else []) + ([("paragraph", "long " * 30_000)] if i < 20 else [])))
    clean, raw = pages(spark, rows), spark.createDataFrame([], RAW)
    labelled, lines = page_body.recurring_lines(clean)
    got = collections.Counter((r["line"][:8], r["label"]) for r in labelled.join(lines, "h").where(F.col("line").isin(notice, notes) | F.col("line").startswith("long")).collect())
    assert got == {(notice[:8], 1): 60, (notes[:8], 1): 15, ("long lon", 1): 20}
    model = page_body.fit_model(raw, clean, sample_pages=2)  # a sample of a few pages holds no line five times
    assert (page_body.scores(model, [notice, notes], ["paragraph"] * 2) > 0).all() and (page_body.scores(model, [rows[0][2][0][1]], ["paragraph"]) < 0).all()
    again = page_body.fit_model(raw, clean.unionByName(clean).repartition(3), sample_pages=2)
    assert all(np.allclose(a, b) for a, b in zip(model, again))


# 8


def test_leaks_are_those_with_a_run(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(40)) for i in range(30)}
    docs, want = [], set()
    for d in range(200):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            i, n = rng.randrange(30), rng.randint(9, 20)
            at = rng.randrange(0, 40 - n)
            text[5:5] = [w.upper() + rng.choice([",", "", "!"]) for w in items[i].split()[at : at + n]]
        docs.append((d, "  ".join(text)))
    index = collections.defaultdict(set)
    for i, p in items.items():
        w = words(p)
        for k in range(len(w) - 11):
            index[tuple(w[k : k + 12])].add(i)
    for d, t in docs:
        w = words(t)
        want |= {(d, i) for k in range(len(w) - 11) for i in index[tuple(w[k : k + 12])]}
    docs += [(900, None), (901, ""), (None, "x"), docs[0], (902, items[0] + " " + "long " * 50_000)]
    want.add((902, 0))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("?"))
    ev = spark.createDataFrame([*items.items(), (99, None), (98, "too short"), (0, items[0])], "item_id long, passage string").withColumn("text", F.lit("?"))
    found = contamination.leaks(df, ev).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found if r["longest_run"] >= 12} == want
    assert contamination.leaks(df, ev.limit(0)).count() == 0 and contamination.leaks(df.limit(0), ev).count() == 0


def test_an_edited_stretch_is_a_leak(spark):
    passage = " ".join(f"term{i}" for i in range(30))
    text = passage.replace("term10", "changed").replace("term22 ", "")
    r = contamination.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, passage)], "item_id long, passage string")).first()
    assert r["longest_run"] == 11 and r["aligned_words"] >= 20 and r["edits"] == 1


# 9


def test_mixes_hit_their_budget(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["tok"] * rng.randint(1, 30)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(9001, None, "a"), (9002, "", "b"), (9003, "x　y z", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(-1)).withColumn("h", F.lit("?"))
    targets = [(1, "a", 0.5, 2, 0.2), (1, "b", 0.3, 2, 0.2), (1, "c", 0.2, 1, 0.2), (2, "a", 0.1, 3, 3.0), (2, "b", 0.9, 2, 3.0), (3, "nobody", 1.0, 5, 0.1), (4, None, 1.0, 1, 1.0), (None, "a", 1.0, 1, 1.0), (5, "a", None, 1, 0.5)]
    tg = spark.createDataFrame(targets, "mix_id int, source string, weight double, max_repeats int, size_factor double").withColumn("available", F.lit(0))
    tokens = collections.Counter()
    for _, t, s in docs:
        tokens[s] += len(re.findall(f"[^{WHITE}]+", t or ""))
    total = sum(tokens.values())
    want = {(m, s) for m, s, w, r, f in targets if m and s and (w or 0) * f * total > r * tokens[s]}
    assert {tuple(x) for x in mixing.unreachable(df, tg).collect()} == want
    for r in mixing.mix_report(df, tg).collect():
        assert r["used"] <= r["wanted"] + 1e-6 or not r["reachable"]
        assert r["wanted"] - r["used"] < 30 if r["reachable"] else r["used"] == r["max_repeats"] * r["available"]
    used = collections.Counter()
    for r in mixing.mixed_documents(df, tg).collect():
        used[r["mix_id"], r["source"]] += r["copies"] * r["tokens"]
    assert used == collections.Counter({(r["mix_id"], r["source"]): r["used"] for r in mixing.mix_report(df, tg).collect() if r["used"]})
    assert mixing.unreachable(df.limit(0), tg).count() == 0 and mixing.mix_report(df, tg.limit(0)).count() == 0


# 10


def test_spam_and_its_look_alikes(spark):
    article = "The trustee reviews the cap each month, and a copy goes to each holder. When units are bought online, the price of the next day is used. "
    spam = [
        "best index fund, cheap index fund, top index fund, " * 20, "cheap gold plan " * 60, "\n".join(f'<a href="http://x{i}.test/a/{i}">top gold plan</a>' for i in range(20)), "\n".join(f"* [Best Plan](http://y{i}.test/p/{i})" for i in range(20)),
        " ".join(f"#bestplan{i} #topfund #cheaploan" for i in range(30)), "Our gold plan is the gold plan you need when you want gold plan. Choose gold plan, because gold plan means gold plan and more gold plan. " * 6,
        "\n".join(f"SKU {i} cheap gold plan new ₹{i} add to cart" for i in range(20)),
    ]
    fine = [
        article * 5, article * 4 + "\nSee also:\n" + "\n".join(f"https://fund.example/doc/{i}" for i in range(4)), article * 3 + "\nTags: gold plan, index fund, cap", "Charges by slab\n" + "\n".join(f"₹ {i},000 to ₹ {i},900 | 0.{i}% | day {i}" for i in range(10, 40)),
        "\n".join(f"* {article}" for _ in range(6)), "निवेशक को वार्षिक विवरण में बैंक का आदेश 30 दिन तक दिखाया गया है। " * 6, "Expense ratio: what the scheme charges a year for its running.\nLoad: what is paid when units are sold before the end of a term.\n",
    ]
    rows = [(i, t, f"https://h{i % 5}.example/x", "s") for i, t in enumerate(spam)] + [(100 + i, t, f"https://h{i % 5}.example/x", "s") for i, t in enumerate(fine)] + [(200, None, None, None), (201, "  ", None, None), (0, spam[0], "https://h0.example/x", "s"), (None, spam[0], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, source string").withColumn("words", F.lit(1)).withColumn("host", F.lit("?"))
    assert sorted(r["doc_id"] for r in spam_pages.spam_documents(df).collect()) == list(range(len(spam)))
    assert spam_pages.spam_documents(df.limit(0)).count() == 0


def test_sketches_are_the_same_beside_short_texts():
    import pandas as pd

    text = " ".join(f"w{i}" for i in range(60))
    alone, beside = (near_duplicates._sketched.func(pd.Series(x)).iloc[0] for x in ([text], [text, "x", None]))
    assert all(alone[c] == beside[c] for c in ("set_id", "n_set", "bits_a", "bits_b"))
