import numpy as np

from quillmill.llm import langid

from .test_langid import brute_bits, model_of, tree_of


def test_all_byte_values_have_statistics():
    # 64 two-byte letters of each script, so that over 127 byte values are in use; the last language has least text
    scripts = {k: "".join(map(chr, range(at, at + 64))) for k, at in (("a", 0x400), ("b", 0x5C0), ("c", 0x700), ("d", 0x3040))}
    texts = {k: (" ".join(s) + " " + s) * (1 if k == "d" else 50) for k, s in scripts.items()} | {"e": "".join(map(chr, range(32, 127))) * 60}
    assert len({c for t in texts.values() for c in t.encode()}) > 127
    model, trees = model_of(texts), {k: tree_of(t) for k, t in texts.items()}
    for probe in [*scripts.values(), "abc \u0401", "\U0001f642"]:
        for lang, bits in zip(model.languages, model.lengths(probe), strict=True):
            want = brute_bits(trees[lang], probe)
            assert abs(bits - want) < 1e-3 * max(1, want), (lang, probe)
    assert all(model.predict(s)[0] == k for k, s in scripts.items())


def test_numbers_are_no_letters():
    model = langid.PPM.learn({k: np.unique(langid.grams(langid.text_bytes(t)), return_counts=True) for k, t in {"x": "one text", "y": "und mehr"}.items()})
    for text in ("½", "² ③", "Ⅷ", "_ 12", "٣", "\u0301", "🙂"):
        assert model.predict(text) == (langid.UNDETERMINED, 0.0)
    for text in ("ª", "你", "½ a", "ʰ", "ñ"):
        assert model.predict(text)[0] in ("x", "y")
