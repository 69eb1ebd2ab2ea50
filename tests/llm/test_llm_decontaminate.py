from __future__ import annotations

import random

from plain_words import alnum

from millrace.llm import decontaminate as D


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        words, hit, found = alnum(text), set(), set()
        for item_id, item in items:
            iw = alnum(item)
            size = min(13, len(iw))
            windows = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if size else set()
            for i in range(len(words) - size + 1 if size else 0):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found.add(item_id)
        out.append((doc_id, len(words), len(hit), tuple(sorted(i for i in found if i is not None))))
    return sorted(out, key=repr)


def run(spark, docs, items):
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got.collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: " ".join(rng.choice(["the", "of", "Cat", "dog", "9", "é", "x-y"]) for _ in range(n))
    items = [(i, word(rng.choice([1, 2, 3, 5, 12, 13, 14, 40]) + 3 * (i % 2))) for i in range(12)] + [(90, ""), (91, None), (None, word(20)), (92, word(6))]
    items += [(93, items[0][1]), (94, items[3][1].upper())]
    docs = []
    for i in range(40):
        middle = (rng.choice(items)[1] or "") if i % 2 else ""
        docs.append((i, f"{word(rng.randint(0, 30))} {middle}! {word(rng.randint(0, 30))}"))
    docs += [(50, None), (51, ""), (None, items[1][1]), (0, docs[0][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_long_items_only(spark):
    rng = random.Random(4)
    text = [f"w{rng.randint(0, 400)}" for _ in range(900)]
    items = [(1, " ".join(text[100:160])), (2, " ".join(text[300:313])), (3, " ".join(text[500:512]) + " end")]
    docs = [(1, " ".join(text)), (2, " ".join(text[95:112])), (3, " ".join(text[101:113]))]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert [n for _, _, n, _ in got] == [73, 0, 0]


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "seven eight nine ten", "x"), (None, None, None)], "item_id long, text string, row string")
    got = D.contamination(odd, bench).select("doc_id", "n_words", "n_hit").collect()
    assert len(got) == odd.count()
    assert sum(r.n_hit for r in got) == 8
    assert D.contamination(none, bench).count() == 0
    assert {r.n_hit for r in D.contamination(odd, bench.limit(0)).collect()} == {0}
