"""Benchmark items that are edited or cut are still found; parts and repeats of them aren't."""

import random

from veldspar.llm import decontam


def test_contained_items(spark):
    rng = random.Random(6)
    prose = lambda n: ["".join(rng.choice(["ka", "lo", "mi", "ter", "sun", "ve"]) for _ in range(rng.randint(2, 5))) for _ in range(n)]
    items = {n: prose(n) for n in range(15, 41, 5)} | {6: prose(6), 1: ["same"] * 20, 2: None, 3: [], 4: prose(2)}
    docs, want = [], set()

    def add(part, item=None):
        docs.append((len(docs), " ".join(prose(9) + part + prose(30))))
        want.update([] if item is None else [(len(docs) - 1, item)])

    for n, w in items.items():
        if n < 15:
            continue
        for at in range(n):  # one word is another, or lost
            add([*w[:at], "other", *w[at + 1 :]], n)
            add([*w[:at], *w[at + 1 :]], n)
        for cut in (0, n // 8, n // 4):  # three quarters of it, and half
            add(w[cut : cut + 3 * n // 4], n)
        add([*w[: n // 3], *w[n // 3 + n // 5 :]], n)  # a line is lost
        add(w[: n // 2])
        add(w[:8] * 9 if n > 15 else w[:5] * 9)
        add([x for s in range(0, n, 3) for x in [*w[s : s + 3], *prose(9)]])  # scattered
    add(items[6], 6)
    add(items[6][:5])
    add(["same"] * 3)
    add(["same"] * 25, 1)
    add(items[4], 4)
    docs += [(len(docs), None), (len(docs) + 1, "")]
    table = spark.createDataFrame([(k, None if w is None else " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = decontam.contained_items(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), table).collect()
    assert {(r.doc_id, r["item"]) for r in got} == want
    assert all(0.66 < r.containment <= 1 for r in got)
