"""Stretches of exactly min_words words with one word replaced, added or missing are found."""

import random

import pytest

from loomwright.llm import contamination


@pytest.mark.parametrize("letters", [1, 2, 4, 5, 7, 10])
def test_every_edit_of_the_shortest_stretch(spark, letters):
    rng = random.Random(letters)
    alphabet = "".join(map(chr, range(0x4E00, 0x4E00 + 2000))) if letters < 3 else "abcdefghijklmnopqrstuvwxyz"

    def word(n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    items, docs, want = [], [], set()
    for i in range(12):
        stretch = [word(letters) for _ in range(12)]
        items.append((i, " ".join(stretch)))
        for n, new in enumerate([None, *(word(m) for m in (letters, 9, 40))]):
            for kind in ("missing",) if new is None else ("replaced", "added"):
                at = rng.randint(2, 9) if i else 5
                text = stretch[:at] + ([] if new is None else [new]) + stretch[at + (kind != "added") :]
                d = len(docs)
                docs.append((d, " ".join([word(6) for _ in range(30)] + text + [word(6) for _ in range(30)])))
                want.add((d, i))
    found = contamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and all(r["aligned_words"] == 12 and r["edits"] == 1 for r in found)
