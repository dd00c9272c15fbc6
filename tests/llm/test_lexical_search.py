import math
import random
import re
from collections import Counter

import numpy as np

from quillmill.llm import lexical_search
from quillmill.llm.lexical_search import Plan

from .helpers import LONG, ODD, documents

ITEMS = "item_id long, text string"


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", low)


def brute(rows, items, k):
    docs = [(i, ts) for i, t in rows if (ts := terms(t))]
    n, total = len(docs), sum(len(ts) for _, ts in docs)
    df = Counter(t for _, ts in docs for t in set(ts))
    out = []
    for item, text in set(items):
        scored = []
        for i, ts in docs:
            tf, m, score = Counter(ts), 50 + 50 * len(ts) * n // total, 0
            for t in set(terms(text)) & set(tf):
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, **how):
    docs = documents(spark, docs).selectExpr("*", "1 AS rank", "2 AS score", "'x' AS terms")
    return sorted((tuple(r) for r in lexical_search.search(docs, spark.createDataFrame(items, ITEMS), **how).collect()), key=repr)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    word = lambda: f"w{int(rnd.paretovariate(0.7)) % 400}"
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(1, 60)))) for i in range(n)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(80)]  # copies: equal scores
    items = [(i, " ".join(word() for _ in range(rnd.randrange(1, 25)))) for i in range(25)]
    return rows, items


def test_against_all_scores(spark):
    for seed, k in ((1, 50), (2, 5), (3, 1)):
        rows, items = corpus(seed)
        assert got(spark, rows, items, k=k) == brute(rows, items, k)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rows, items = corpus(4)
    want = brute(rows, items, 7)
    assert got(spark, rows, items, k=7, rows=9) == want == got(spark, rows, items, k=7, size=900)
    monkeypatch.setattr(lexical_search, "CELLS", 64)
    monkeypatch.setattr(lexical_search, "EXPANDED", 16)
    monkeypatch.setattr(lexical_search, "HELD", 8)
    assert got(spark, rows, items, k=7) == want


def test_odd_rows(spark):
    rows = [*ODD, (11, "ONE Two, ½² é-É 你好!"), (11, "ONE Two, ½² é-É 你好!"), (12, "one " + LONG), (13, "...")]
    items = [(1, "one TWO"), (1, "one TWO"), (2, None), (3, ""), (4, "?!"), (5, "absent"), (None, "é É 你好"), (6, "w5 the id"), (6, "here"), (7, LONG)]
    assert got(spark, rows, items, k=50) == brute(rows, items, 50)
    assert got(spark, [], items) == [] == got(spark, rows, []) == got(spark, [(1, None)], items)


def test_pruning_is_safe_and_does_prune():
    rnd = random.Random(5)
    most = np.array([rnd.randrange(1, 1000) for _ in range(60)])
    items = [rnd.sample(range(60), 20) for _ in range(30)]
    bound = np.array([rnd.randrange(1, 9000) for _ in items])
    plan = Plan(items, np.ones(60, np.int64), most, 1, 1, 10, bound)
    starts, of = plan.joining
    for i, ts in enumerate(items):
        joining = {t for t in range(60) if i in of[starts[t] : starts[t + 1]].tolist()}
        left = set(ts) - joining
        assert plan.rest[i] == most[list(left)].sum() < bound[i]
        assert not joining or plan.rest[i] + min(most[list(joining)]) >= bound[i]
    assert len(of) < 30 * 20


def test_seeds_leave_few_candidates(spark, monkeypatch):
    """Pairs that are scored in full are few of those that share a term."""
    rows, items = corpus(6, 1500)
    seen = []
    real = lexical_search.joined
    monkeypatch.setattr(lexical_search, "joined", lambda table, plan: seen.append(plan) or real(table, plan))
    lexical_search.search_block(documents(spark, rows), [(i, sorted(set(terms(t)))) for i, t in items], 10)
    first, last = seen
    assert (last.bound >= first.bound).all() and last.bound.sum() > first.bound.sum()
    assert len(last.joining[1]) < len(first.joining[1]) <= len(last.every[1])
