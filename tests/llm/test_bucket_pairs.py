"""Lines that resemble each other, but not the smallest line of their bucket, are one cluster."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from loomwright.llm import repeated_lines

CLEAN = "doc_id string, source_id string, blocks array<struct<pos:int,kind:string,text:string,level:int>>"


@pytest.mark.parametrize("tile", [512, 2])
def test_every_line_meets_every_other_of_its_bucket(spark, monkeypatch, tile):
    monkeypatch.setattr(repeated_lines, "TILE", tile)
    buckets = {1: [5, 1, 9, 7, 3, 8], 2: [4], 3: [2, 9], 4: [1, 5], 5: list(range(20, 50))}
    rows = [(b, m, bytearray(24)) for b, ms in buckets.items() for m in ms]
    got = [(r["a"], r["b"]) for r in repeated_lines.bucket_pairs(spark.createDataFrame(rows, "bucket long, mask_id long, sig binary")).collect()]
    assert sorted(got) == sorted({p for ms in buckets.values() for p in itertools.combinations(sorted(ms), 2)})


def test_variants_beside_a_smaller_line(spark, monkeypatch):
    # one bucket for all lines: whichever line is its smallest, the variants of the other notice are still compared
    signed = repeated_lines._signed
    monkeypatch.setattr(repeated_lines, "_signed", lambda c: repeated_lines.F.struct(repeated_lines.F.array(repeated_lines.F.lit(0).cast("long")).alias("bands"), signed(c)["sig"].alias("sig")))
    first, second = "please read every paper of the offer before you sign anything at the desk", "units may be redeemed on each business day until three in the afternoon"
    rows = [(f"d{i}", "s", [(0, "paragraph", f"{first} {'abcdef'[i]}", 0), (1, "paragraph", f"{second} {'uvwxyz'[i]}", 0)]) for i in range(6)]
    _, stats = repeated_lines.repeated_lines(spark.createDataFrame(rows, CLEAN))
    assert [(r["line_docs"], r["cluster_docs"]) for r in stats.collect()] == [(1, 6)] * 12


def test_clusters_against_brute_force():
    """Pairs of similarity 0.8 and more, by bands and minimum hashes."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    lines = []
    for _ in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 20))]
        lines += [" ".join(base)] + [" ".join(base[:i] + [rng.choice(vocabulary)] + base[i + 1 :]) for i in (rng.randrange(len(base)) for _ in range(4))]
    low = repeated_lines.minimum_hashes(lines)
    grams = [{x[i : i + 4] for i in range(len(x) - 3)} for x in lines]
    near, met = 0, 0
    for i, j in itertools.combinations(range(len(lines)), 2):
        common = len(grams[i] & grams[j])
        if common >= 0.8 * (len(grams[i]) + len(grams[j]) - common):
            near += 1
            bands = (low[i] == low[j]).reshape(repeated_lines.BANDS, repeated_lines.ROWS).all(axis=1)
            met += bool(bands.any()) and (low[i] == low[j]).sum() >= repeated_lines.AGREE
    assert near > 100 and met >= 0.99 * near


def test_masks_and_letters():
    keys, masks = repeated_lines.line_keys(["Updated 12-01-2025 by Asha Rao at 10:30", "UPDATED by asha rao at", "ﬁne — print", "12 %", "", "Fine print!"])
    assert masks[0] == "updated 0 by § at 0" and masks[3] == "0 %" and masks[4] == ""
    assert keys[0] == keys[1] and keys[2] == keys[5] and keys[3] is keys[4] is None and keys[0] != keys[2]


def test_rows_and_facts_stay(spark):
    blocks = lambda i: [(0, "table_row", f"₹ {i}000 to ₹ {i}500 | {i}.06% | day {i}", 0), (1, "fact", "Riskometer: Very High", 0), (2, "heading", "Fees", 1), (3, "footnote", f"Updated on {i} May", 0), (4, None, "no kind", 0)]
    df = spark.createDataFrame([(f"d{i}", "s", blocks(i)) for i in range(8)], CLEAN)
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in repeated_lines.cleaned_pages(df).collect()}
    assert got == {f"d{i}": (1, f"₹ {i}000 to ₹ {i}500 | {i}.06% | day {i}\nRiskometer: Very High\nFees\nno kind") for i in range(8)}


def test_tiles_over_frames():
    rows = pd.DataFrame({"tile": [1, 1, 2, 2, 2, 3], "side": [0, 0, 0, 1, 1, 0], "mask_id": [1, 2, 3, 4, 5, 6], "sig": [bytes(24)] * 6})
    for cut in range(7):
        got = pd.concat(list(repeated_lines._tiles(iter([rows[:cut], rows[cut:]]))))
        assert sorted(map(tuple, got.to_numpy().tolist())) == [(1, 2), (3, 4), (3, 5)], cut
    assert np.unique(got["a"]).tolist() == [1, 3]
