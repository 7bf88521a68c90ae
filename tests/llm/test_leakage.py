"""Leak search against brute force, and what does and does not count as a change."""

import random

from tabulon.llm import leakage as L

DOCS = "doc_id long, text string, item_id string"
ITEMS = "item_id long, suite string, lang string, passage string, question string, answer string"


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, "s", "en", p, "", "") for i, p in items], ITEMS)
    return {(r["doc_id"], r["item_id"]) for r in L.leaks(d, q).collect()}


W = [f"w{i}x{i * 7}" for i in range(60)]
PASSAGE = " ".join(W)


def test_changes(spark):
    nineteen, twenty = " ".join(W[5:24]), " ".join(W[5:25])
    three, four = W[5:25], W[5:25]
    for i in (3, 8, 13):
        three = [*three[:i], "other", *three[i + 1 :]]
    for i in (3, 8, 13, 16):
        four = [*four[:i], "other", *four[i + 1 :]]
    docs = [
        (1, nineteen), (2, "before " + twenty + " after"), (3, " ".join(three)), (4, " ".join(four)), (5, " ".join(reversed(W))), (6, None), (7, ""),
        (8, twenty.upper().replace(" ", " ,\n")), (9, " ".join(W[5:15]) + "\n\n12 / 7 Q 11/2000\n\n[3] " + " ".join(W[15:25])), (10, " ".join(W[5:15])[:-2] + "-\n" + " ".join(W[5:15])[-2:] + " " + " ".join(W[15:25])), (2, "before " + twenty + " after"),
        (13, " ".join([*W[5:10], "█████", *W[11:17], "[redacted]", *W[18:26]])), (11, ("filler " * 20_000) + PASSAGE), (12, "x" * 500_000),
    ]
    assert found(spark, docs, [(1, PASSAGE), (2, "too short"), (3, None), (4, "")]) == {(d, 1) for d in (2, 3, 8, 9, 10, 11, 13)}


def test_accents_and_han(spark):
    p = "Où est le café de l'été près du théâtre où Zoé dîna hier soir à côté de Noël et François après la fête du village"
    assert found(spark, [(1, p.replace("é", "e").replace("è", "e").replace("ê", "e"))], [(1, p)]) == {(1, 1)}
    rnd = random.Random(1)
    chars = "".join(chr(0x4E00 + rnd.randint(0, 3000)) for _ in range(80))
    part = chars[10:50]
    six, seven = list(part), list(part)
    for i in (1, 6, 12, 18, 24, 30):
        six[i] = seven[i] = "口"
    seven[36] = "口"
    docs = [(1, "前" + "，".join([part[:7], part[7:]]) + "后"), (2, "".join(six)), (3, "".join(seven)), (4, part[:39])]
    assert found(spark, docs, [(1, chars)]) == {(1, 1), (2, 1)}


def test_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"v{i}" for i in range(120)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(20, 60)))) for i in range(12)]
    docs = []
    for d in range(60):
        words = rnd.choices(vocab, k=80)
        if d % 2:
            src = rnd.choice(items)[1].split()
            a = rnd.randint(0, len(src) - 20)
            cut = src[a : a + rnd.randint(17, 26)]
            for _ in range(rnd.randint(0, 5)):
                cut[rnd.randrange(len(cut))] = rnd.choice(vocab)
            at = rnd.randint(0, 40)
            words[at : at + len(cut)] = cut
        docs.append((d, " ".join(words)))
    want = set()
    for d, t in docs:
        x = t.split()
        for i, p in items:
            y = p.split()
            if any(x[s] == y[q] and x[s + 19] == y[q + 19] and sum(a == b for a, b in zip(x[s : s + 20], y[q : q + 20], strict=False)) >= 17 for s in range(len(x) - 19) for q in range(len(y) - 19)):
                want.add((d, i))
    assert found(spark, docs, items) == want and len(want) > 10


def test_segments_of_long_items(spark):
    long = [f"u{i}" for i in range(1500)]
    assert found(spark, [(1, " ".join(long[700:725])), (2, " ".join(long[505:530]))], [(1, " ".join(long))]) == {(1, 1), (2, 1)}


def test_empty(spark):
    d = spark.createDataFrame([], DOCS)
    q = spark.createDataFrame([], ITEMS)
    assert L.leaks(d, q).count() == 0 and found(spark, [(1, "a b")], []) == set()


def test_sketches_are_smaller_than_their_items(spark):
    for n in range(2, 600):
        k = L.sketch_size(n)
        assert k < n and (n < 16 or k >= 0.75 * n)
    q = spark.createDataFrame([(1, "s", "en", PASSAGE, "", ""), (1, "s", "en", PASSAGE + " more", "", "")], ITEMS)
    assert [r["k"] for r in L.sketches(q).collect()] == [L.sketch_size(56), L.sketch_size(57)]


def test_recall_of_the_sketches(spark):
    """Leaks of 20 to 40 words with up to three changes, against all windows tried one by one."""
    rnd = random.Random(11)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(rnd.randint(30, 120)))) for i in range(200)]
    docs, want = [], set()
    for d in range(1000):
        i, p = items[d % 200]
        words = p.split()
        n = rnd.randint(20, 30)
        a = rnd.randint(0, len(words) - n)
        part = words[a : a + n]
        for c in rnd.sample(range(1, n - 1), rnd.randint(0, 3)):
            part[c] = "changed"
        docs.append((d, "some words before " + " ".join(part) + " and after"))
        want.add((d, i))
    got = found(spark, docs, items)
    assert got <= want and len(got) >= 0.99 * len(want)
