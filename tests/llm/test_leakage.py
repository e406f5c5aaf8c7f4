import random

from runweave.llm import leakage

WORDS = [f"w{i}" for i in range(60)] + ["don't", "Größe", "123", "4b"]


def brute(docs, items, n):
    def grams(t):
        w = leakage.words(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    of = {i: grams(t) for i, t in items if t}
    return {(k, i) for k, t in docs if t for i, g in of.items() if grams(t) & g}


def case():
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(5, 40)))) for i in range(30)] + [(99, None), (98, ""), (97, "short one")]
    items.append((96, items[0][1]))
    docs = []
    for k in range(200):
        w = [rnd.choice(WORDS) for _ in range(rnd.randrange(0, 60))]
        if rnd.random() < 0.5:
            src = leakage.words(rnd.choice(items[:30])[1])
            a, m = rnd.randrange(len(src)), rnd.randrange(6, 20)
            w[5:5] = src[a : a + m]
        sep = rnd.choice([" ", "\n", ", ", " -- ", "　"])
        t = sep.join(w)
        docs.append((k, t.upper() if rnd.random() < 0.3 else t))
    return [*docs, (500, None), (501, ""), (1, docs[1][1])], items


def frames(spark, docs, items):
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item_id long")
    return d, spark.createDataFrame(items, "item_id long, text string")


def test_both_ways_equal_brute_force(spark):
    docs, items = case()
    d, i = frames(spark, docs, items)
    want = brute(docs, items, 10)
    assert len(want) > 20
    for limit in (leakage.MAX_BROADCAST_CHARS, 10):
        got = [tuple(r) for r in leakage.leaks(d, "doc_id", "text", i, "item_id", "text", limit=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert leakage.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leakage.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_spans_are_taken_out(spark):
    docs, items = case()
    d, i = frames(spark, docs, items)
    clean = [(r["doc_id"], r["text"]) for r in leakage.clean(d, "doc_id", "text", i, "item_id", "text").collect()]
    leaked = {k for k, _ in brute(docs, items, 10)}
    assert len(clean) == len(docs)
    same = dict(docs)
    assert all(t == same[k] for k, t in clean if k not in leaked)
    windows = leakage.ItemWindows([(0, "a b c d e f g h i j k l")])
    assert windows.without_spans("Before. A, b! c d e f g h i j K l; after İ") == "Before. ; after İ"
    assert windows.without_spans("İİ a b c d e f g h i j x") == "İİ  x"


def test_spans_are_taken_out_without_broadcast(spark):
    docs, items = case()
    docs += [(600, "İİ " + items[0][1]), (None, items[1][1].upper() + " end"), (601, docs[2][1])]
    d, i = frames(spark, docs, items)
    out = [sorted(map(tuple, leakage.clean(d, "doc_id", "text", i, "item_id", "text", limit=n).select("doc_id", "text").collect()), key=str) for n in (leakage.MAX_BROADCAST_CHARS, 10)]
    assert len(out[1]) == len(docs) and out[0] == out[1]
    assert leakage.clean(d, "doc_id", "text", i.where("item_id = 98"), "item_id", "text", limit=-1).exceptAll(d.select("doc_id", "text")).count() == 0
