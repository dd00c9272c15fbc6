import math
import zlib
from collections import Counter

import numpy as np

from quillmill.llm import langid

from .helpers import ODD, documents, driver_rows


def tree_of(text, order=4):
    """How often each byte follows each context of up to four bytes, from a plain loop."""
    data = langid.text_bytes(text).tolist()
    tree = {}
    for i in range(order, len(data)):
        for n in range(order + 1):
            tree.setdefault(tuple(data[i - n : i]), Counter())[data[i]] += 1
    return tree


def brute_bits(tree, text, order=4):
    """PPM with exclusion, byte by byte."""
    data = langid.text_bytes(text).tolist()
    total = 0.0
    for i in range(order, len(data)):
        out, ruled = 0.0, set()
        for n in range(order, -1, -1):
            seen = {s: k for s, k in tree.get(tuple(data[i - n : i]), {}).items() if s not in ruled}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                out -= math.log2(seen[data[i]] / whole)
                break
            out -= math.log2(len(seen) / whole)
            ruled |= set(seen)
        else:
            out += math.log2(256 - len(ruled))
        total += out
    return total


def model_of(texts):
    return langid.PPM.learn({k: np.unique(langid.grams(langid.text_bytes(t)), return_counts=True) for k, t in texts.items()})


def test_code_lengths_are_exact():
    texts = {"x": "the cat sat on the mat and the dog", "y": "der hund und die katze è"}
    model = model_of(texts)
    for probe in ["the hat", "und ñ!", "A", "è è", "zzz", "the cat sat on the mat", "d", "ad the dog and the mat sat"]:
        for lang, bits in zip(model.languages, model.lengths(probe), strict=True):
            assert abs(bits - brute_bits(tree_of(texts[lang]), probe)) < 1e-3 * max(1, bits), (lang, probe)


def test_code_lengths_of_documents_are_exact():
    rows = [r for r in driver_rows("documents") if r["text"]]
    texts = {k: " ".join(r["text"] for r in rows if r["lang"] == k)[:60_000] for k in ("en", "de", "fr")}
    model, trees = model_of(texts), {k: tree_of(t) for k, t in texts.items()}
    for r in rows[:40]:
        probe = r["text"][:600]
        for lang, bits in zip(model.languages, model.lengths(probe), strict=True):
            assert abs(bits - brute_bits(trees[lang], probe)) < 1e-3 * max(1, bits)


def test_probabilities_of_a_context_add_up_to_one():
    model = model_of({"x": "some text to learn from, once and once more", "y": "other words"})
    for context in (b"some", b" to ", b"zzzz", b"once", b"    ", b"xxto"):
        codes = np.array([int.from_bytes(context + bytes([c]), "big") for c in range(256)], np.int64)
        assert np.allclose(np.exp2(-model._lengths(codes)).sum(axis=0), 1, atol=1e-4)


def test_places_find_what_is_there_and_nothing_else():
    rnd = np.random.default_rng(3)
    codes = np.unique(rnd.integers(0, 1 << 40, 20_000))
    places = langid.Places(codes)
    probe = np.concatenate([codes, rnd.integers(0, 1 << 40, 20_000)])
    want = {c: i for i, c in enumerate(codes.tolist())}
    assert places.of(probe).tolist() == [want.get(c, len(codes)) for c in probe.tolist()]
    assert langid.Places(codes[:0]).of(probe).tolist() == [0] * len(probe)


def test_a_repeated_id_hides_no_language_and_counts_once(spark):
    many = [(7, f"some english words that are said over and over {i}", "en", "s", 1) for i in range(5000)]
    few = [(i, f"der hund und die katze sind im haus {i}", "de", "s", 1) for i in range(100, 130)]
    docs = spark.createDataFrame(many + few, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.learn(docs)
    assert model.languages == ["de", "en"]
    # one text of the repeated id is learned
    assert model.total[0][0][model.languages.index("en")] < np.log2(200)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in driver_rows("documents", sf)}
    got = langid.identify(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    out = [r.lang_pred == rows[r.doc_id]["lang"] for r in got if r.held_out]
    assert sum(out) / len(out) > 0.98, sum(out) / len(out)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", langid.F.when(langid.held_out("doc_id"), "zz").otherwise(langid.F.col("lang"))).selectExpr("*", "1 as score", "2 as held_out")
    same = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(df).collect())
    assert same(docs) == same(other)


def test_odd_rows_and_empty_table(spark):
    got = langid.identify(documents(spark, [*ODD, (50, "123 !!"), (51, "x" * 3_000_000)])).collect()
    assert len(got) == len(ODD) + 2
    pred = {r.doc_id: r.lang_pred for r in got}
    assert [pred[i] for i in (1, 2, 3, 50)] == ["und"] * 4 and pred[51] == "en"
    assert langid.identify(documents(spark, [])).count() == 0
    nothing = documents(spark, [(1, "text")]).withColumn("lang", langid.F.lit(None).cast("string"))
    assert langid.identify(nothing).first().lang_pred == "und"
