"""Planted leaks with edits, markup and damage are found; quotations and stock sentences are not."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import leakage as L

STOCK = "This market resolves to Yes if the condition is met, otherwise it resolves to No."


def sentence(rnd, k):
    return " ".join("".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiouéü") for _ in range(rnd.randint(1, 4))) for _ in range(k)).capitalize() + "."


def plain_align(a, b, match=2.0, mismatch=-1.0, gap=-0.7):
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0.0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap)
    return h


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=20))
def test_alignment_score_equals_plain_dynamic_programme(a, b):
    best = max(map(max, plain_align(a, b)))
    x, y = np.array(a), np.array(b)
    hits, first, last = L.align((x, x), (y, y))
    assert (best > 0) == (hits > 0)
    if hits:  # the span found reaches the best score by itself
        assert abs(max(map(max, plain_align(a, b[first : last + 1]))) - best) < 1e-6


def test_leaks(spark):
    rnd = random.Random(3)
    items = [(i, " ".join([sentence(rnd, 12) for _ in range(5)] + [STOCK])) for i in range(12)]
    noise = lambda k: " ".join(sentence(rnd, 11) for _ in range(k))
    docs, want = [], set()

    def add(text, *leaks):
        docs.append((len(docs), text))
        want.update((len(docs) - 1, i) for i in leaks)

    for i, p in items:
        w = p.split()
        add(noise(4) + " " + p + " " + noise(2), i)
        add(noise(2) + "\n> " + p.upper().replace(". ", ".\n> "), i)
        add("<p>" + p.replace(". ", ".</p>\n<p>") + "</p>", i)
        add(noise(1) + p.encode("utf-8").decode("latin-1"), i)
        add("".join(c if c.isascii() else "�" for c in p) + noise(1), i)
        add(noise(1) + " ".join(x for k, x in enumerate(w) if k % 7) + noise(1), i)
        add(" ".join(w[: len(w) // 2] + "so far the first half and it goes on like this".split() + w[len(w) // 2 :]), i)
        add(noise(3) + " ".join(w[: int(len(w) * 0.3)]) + noise(3))
        add(noise(3) + " ".join(w[10:18]) + STOCK)
        add(" ".join(rnd.sample(w, len(w))))
    add(items[0][1] + noise(3) + items[1][1], 0, 1)
    docs += [(900, None), (901, ""), (902, noise(1) * 300), (None, items[0][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([*[(i, p, 1) for i, p in items], (50, None, 1), (51, "", 1), (52, "?!", 1)], "item_id long, passage string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(df, it).collect()}
    assert got == want
    assert {(r.doc_id, r.item_id) for r in L.find_leaks(df, it, block=1_500).collect()} == want
    assert L.find_leaks(df.limit(0), it).count() == 0 and L.find_leaks(df, it.limit(0)).count() == 0


def test_words_changed_too_often_are_not_carried():
    """Of 60 words 40 % or 50 % equal in turns with changed ones are no leak; a few changed ones here and there are none the less."""
    item = [f"w{i}" for i in range(60)]
    turns = lambda equal, changed: " ".join(w if i % (equal + changed) < equal else f"x{i}" for i, w in enumerate(item))
    items = L.Items.of([(1, " ".join(item))])
    carried = lambda text: [x[1] for x in items.leaks(text, 0.0, 0.0)][0]
    assert carried(" ".join(item)) == 60
    assert carried(turns(3, 5)) <= 30 and carried(turns(3, 3)) <= 30
    assert not items.leaks(turns(3, 5), 0.6, 0.0) and not items.leaks(turns(3, 3), 0.6, 0.0)
    assert carried(turns(9, 1)) == 59 and carried(turns(5, 1)) == 59 and carried(turns(5, 3)) == 39 + 7
    assert items.leaks(turns(5, 1), 0.6, 0.0)
    assert carried(" ".join(item[:20] + ["so", "far"] + item[20:40])) == 40


def test_many_reposts_stay_found(spark):
    rnd = random.Random(4)
    item = " ".join(sentence(rnd, 12) for _ in range(5))
    rows = [(i, item + " " + (sentence(rnd, 8) if i % 2 else "")) for i in range(200)] + [(i, sentence(rnd, 40)) for i in range(200, 400)]
    got = L.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, passage string"), rare_least=3)
    assert sorted(r.doc_id for r in got.collect()) == list(range(200))
