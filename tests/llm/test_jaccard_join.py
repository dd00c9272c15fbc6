import random

from quillmill.llm import jaccard_join, near_copies

from .helpers import LONG, ODD, SF, documents, driver_rows


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """By all pairs of rows; rows of one id are one document."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for y, (i, _) in enumerate(rows):
        for x in range(y):
            both = len(sets[x] & sets[y])
            alike = both and 100 * both >= 80 * len(sets[x] | sets[y])
            if i is not None and rows[x][0] is not None and (alike or (rows[x][0] == i and sets[x] and sets[y])):
                a, b = sorted((find(x), find(y)))
                group[b] = a
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            r = find(x)
            least[r] = min(i, least.get(r, i))
    return sorted(((i, len(sets[x]), None if i is None else least[find(x)]) for x, (i, _) in enumerate(rows)), key=repr)


def got(spark, rows):
    docs = documents(spark, rows).selectExpr("*", "1 AS first", "'x' AS digest", "2 AS component_id")
    return sorted((tuple(r) for r in jaccard_join.components(docs).collect()), key=repr)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in driver_rows("documents", SF)]
    want = brute(rows)
    assert got(spark, rows) == want and any(i != c for i, _, c in want)


def test_links_at_the_threshold_and_not_below(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(0, 240, 3):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(204)]
        like, unlike = list(base), list(base)
        for k in range(4):  # 180 of 220 shingles
            like[20 + 40 * k] = "changed"
        for k in range(5):  # 175 of 225
            unlike[20 + 40 * k] = f"other{k}"
        rows += [(i, " ".join(base)), (i + 1, " ".join(like)), (i + 2, " ".join(unlike))]
    rows += [(1000, "a b c d e f g h"), (1001, "a b c d e f g h i"), (1002, "A B c d e f g h i  j"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "one two three")]
    want = brute(rows)
    assert {c for i, _, c in want if i < 3} == {0, 2} and dict((i, c) for i, _, c in want)[1002] == 1000
    assert got(spark, rows) == want


def chains(seed, families, each, words):
    rnd = random.Random(seed)
    rows = []
    for f in range(families):
        now = [f"f{f}w{k}" for k in range(words)]
        for k in range(each):
            now[rnd.randrange(words)] = f"x{k}"
            rows.append((rnd.randrange(10**9), "common words that all of them begin with " + " ".join(now)))
    return rows


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Each text is like its neighbours in a chain only, shingles are shared by more than SMALL, and short texts share most of theirs unlike others."""
    for name, value in (("SMALL", 3), ("BLOCK", 16), ("LARGE", 24)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rows = chains(2, 3, 60, 80) + chains(3, 12, 6, 8)
    rows += [(10**9 + k, f"common words that all of them begin with and end {k}") for k in range(40)]
    assert got(spark, rows) == brute(rows)


def test_groups_of_equal_prefix_and_size(spark):
    """The same sentences in another order are other texts with nearly the same shingles."""
    rnd = random.Random(4)
    parts = [" ".join(f"p{k}w{j}" for j in range(40)) for k in range(8)]
    rows = []
    for i in range(60):
        rnd.shuffle(parts)
        rows.append((i, " ".join(parts)))
    loop = "u v w x y z " * 30
    rows += [(100, loop), (101, loop + "u"), (102, "v " + loop), (103, loop.upper())]
    want = brute(rows)
    assert len({c for _, _, c in want}) < 20 and got(spark, rows) == want


def test_odd_rows(spark):
    rows = [*ODD, (7, "A b  C"), (20, LONG + " end"), (5, LONG), (21, "no id here at all"), (22, "é ñ 你好 🙂 é ñ 你好 🙂 "), (23, "É ñ 你好 🙂 é ñ 你好 🙂"), (24, "x y z"), (24, None)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_a_common_shingle_does_not_pair_all(spark):
    rows = [(i, f"{i} the same long passage of words " + " ".join(f"d{i}w{k}" for k in range(60))) for i in range(300)]
    docs = documents(spark, rows).select("doc_id", "text")
    counts = jaccard_join.shingle_counts(jaccard_join.first_pass(docs))
    groups = jaccard_join.prefixes(docs, counts).selectExpr("kind", "doc_id AS group", "m", "prefix", "1 AS members")
    assert jaccard_join.met_groups(groups).count() == 0  # rare shingles come first, so the passage is in no prefix


def test_words_numbered_or_ranked_compare_the_same(monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abc") for _ in range(n)) for n in (0, 1, 4, 5, 6, 9, 30, 60, 60)] + ["A b\tc a", "a B c a b c a b c", "x"]
    want = [[100 * len(shingles(x) & shingles(y)) >= 80 * len(shingles(x) | shingles(y)) if shingles(x) else False for y in texts] for x in texts]
    for base in (6208, 2):
        monkeypatch.setattr(jaccard_join, "BASE", base)
        assert [[jaccard_join.Shingles(x.encode()).similar(y.encode()) for y in texts] for x in texts] == want
    assert [jaccard_join.Shingles(x.encode()).count() for x in texts[1:]] == [len(shingles(x)) for x in texts[1:]]


def test_hashes_of_words_follow_the_words_alone(monkeypatch):
    text = "Ab  é ab\x0b12 AB\n" * 7 + "x" * 50
    words = jaccard_join.WordHashes()
    whole = words.words(text.lower().encode())
    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    assert words.words(text.lower().encode()).tolist() == whole.tolist()
    named = list(zip(text.lower().split(), whole.tolist(), strict=True))
    assert len(set(named)) == len({w for w, _ in named}) == len({h for _, h in named}) == 4
