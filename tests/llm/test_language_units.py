"""Language identification reads all of a word, and all of a text without spaces."""

import numpy as np
import pyarrow as pa


def test_all_trigrams_and_units():
    from freightlens.llm import lang_crf as lc

    texts = ["abcdef abcdefg ab", "x" * 35 + " " + "y" * 36, "中文字" * 50 + " é" + "aé" * 40, ""]
    w = lc.split_words(pa.array(texts, pa.large_string()))
    raw = w.data.tobytes()
    for i, t in enumerate(texts):
        parts = [raw[a:b].decode() for a, b in zip(w.start[w.off[i] : w.off[i + 1]], w.end[w.off[i] : w.off[i + 1]])]
        assert "".join(parts) == t.replace(" ", "") and all(len(x.encode()) <= lc.LONG + 3 for x in parts)
        again = lc.split_words(pa.array([" ".join(parts)], pa.large_string()))
        assert again.hash.tolist() == w.hash[w.off[i] : w.off[i + 1]].tolist()
    weights = np.random.default_rng(1).normal(size=(1 << lc.ROWS_BITS, 3))
    got = lc.emissions(weights, w, np.arange(len(w.hash)))
    for j, (a, b) in enumerate(zip(w.start, w.end)):
        tri = [raw[p : p + 3] for p in range(a, b - 2)]
        rows = lc._rows(lc.tv.mix(np.array([int.from_bytes(x) + (9 << 40) for x in tri], np.uint64)), lc.ROWS_BITS)
        assert np.allclose(got[j], weights[lc.affixes(w, np.array([j]))[0]].sum(0) + weights[rows].sum(0))


def test_language_of_unspaced_text(spark):
    from freightlens.llm.lang_crf import predict

    rng = np.random.default_rng(6)
    both = [chr(x) for x in rng.integers(0x4E00, 0x9FA5, 300)]
    own = {"xa": ["".join(chr(x) for x in rng.integers(0x3041, 0x3096, 3)) for _ in range(20)], "xb": ["".join(chr(x) for x in rng.integers(0xAC00, 0xD7A3, 3)) for _ in range(20)]}
    rows = []
    for i in range(160):
        lang = ("xa", "xb")[i % 2]
        t = [own[lang][rng.integers(20)] if 3 < j < 390 and rng.random() < 0.03 else both[rng.integers(300)] for j in range(400)]
        rows.append((i, "".join(t), lang))
    got = [r for r in predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r.held_out]
    assert len(got) > 20 and np.mean([r.lang_pred == rows[r.doc_id][2] for r in got]) > 0.95


def test_more_than_64_languages(spark):
    from freightlens.llm.lang_crf import predict

    rng = np.random.default_rng(7)
    own = [["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(12)] for _ in range(70)]
    rows = [(i, " ".join(own[i % 70][j] for j in rng.integers(0, 12, 20)), f"l{i % 70}") for i in range(70 * 12)]
    got = [r for r in predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r.held_out]
    assert len(got) > 100 and np.mean([r.lang_pred == rows[r.doc_id][2] for r in got]) > 0.98
