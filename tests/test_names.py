"""Dictionary names in text: the automaton, and the join that stands in for it when there are too many."""

import random

from quillmill.operators import names as N


def brute(tokens, known):
    out, at = [], 0
    while at < len(tokens):
        n = max((len(k) for k in known if tuple(tokens[at : at + len(k)]) == k), default=0)
        if n:
            out.append((at, n))
        at += n or 1
    return out


def test_automaton_against_all_names():
    rnd = random.Random(1)
    for _ in range(400):
        word = lambda: rnd.choice("abcd")
        known = {tuple(word() for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(0, 12))}
        tokens = [word() for _ in range(rnd.randrange(0, 25))]
        assert N.Automaton([list(k) for k in known]).matches(tokens) == brute(tokens, known), (known, tokens)


def test_both_ways_find_the_same(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["ann", "Bo", "CÉ", "d", "e5"])
    known = {tuple(word().lower() for _ in range(rnd.randrange(1, 4))) for _ in range(15)} | {("zz", "ann")}
    texts = [" ".join(word() + rnd.choice(["", ",", "-", "!"]) for _ in range(rnd.randrange(0, 12))) for _ in range(60)] + ["", None, "...", "Ann's Bo"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[0]])], "id long, sentence string, name2 string")
    names = spark.createDataFrame([(" ".join(k),) for k in known] + [("ANN   bo",), ("ann, bo",), ("",), (None,), ("-",)], "name string")
    known |= {("ann", "bo")}
    import regex

    want = sorted((i, s, " ".join(w[s : s + n])) for i, t in enumerate([*texts, texts[0]]) for w in [regex.findall(N.WORD, (t or "").lower())] for s, n in brute(w, known))
    for most in (N.NAME_BYTES, 0):
        got = N.matches(rows, names, most=most)
        assert got.columns == ["id", "sentence", "name2", "start", "name"]
        assert sorted((r.id, r.start, r.name) for r in got.collect()) == want
    assert N.matches(rows, names.limit(0)).count() == 0 == N.matches(rows.limit(0), names, most=0).count()


def test_counts_are_those_of_the_matches(spark):
    texts = ["Ann Bo, ann; bo", "bo ANN bo ann", None, "", "x-Bo"]
    rows = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(None, "bo")], "id long, sentence string")
    names = spark.createDataFrame([("Ann Bo",), ("bo",), ("x y",)], "name string")
    want = [(0, "ann bo", 3), (0, "bo", 1), (2, "bo", 1), (None, "bo", 1)]
    for most in (N.NAME_BYTES, 0):
        assert sorted(map(tuple, N.counts(rows, names, "id", most=most).collect()), key=repr) == sorted(want, key=repr)


def test_counts_store_no_sentences(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(N, "materialize", lambda df, what: stored.append(what) or df)
    N.counts(spark.createDataFrame([(1, "Bo")], "id long, sentence string"), spark.createDataFrame([("Bo",)], "name string"), "id").collect()
    assert stored == ["names"]


def test_a_name_of_very_many_words(spark):
    text = " ".join(["Und"] * 6000)
    rows = spark.createDataFrame([(1, text), (2, text + " x und")], "id long, sentence string")
    assert sorted(map(tuple, N.counts(rows, spark.createDataFrame([(text,), ("x",)], "name string"), "id").collect())) == [(1, text.lower(), 1), (2, text.lower(), 1), (2, "x", 1)]
