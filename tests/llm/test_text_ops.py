"""Scoring, secrets, packing, sampling, classifier and language operators."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from messy import BASE, ROWS, empty, fold, messy, words

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_words_and_hashes():
    from freightlens.llm import textvec as tv

    texts = [r[1] for r in ROWS]
    w = tv.split_words(pa.array(texts))
    got = [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    want = [words(t) for t in texts]
    assert got == [x for t in want for x in t]
    assert np.diff(w.off).tolist() == [len(t) for t in want]
    assert len(set(w.hash.tolist())) == len(set(got))
    index = tv.HashIndex(4)
    u = np.unique(w.hash)
    index.add(u)
    assert index.find(w.hash).tolist() == np.searchsorted(u, w.hash).tolist()
    assert index.find(np.array([12345], np.uint64)).tolist() == [-1]


# --- packing


def check_packing(rows, texts, size=1024):
    from tokenizers import Tokenizer
    import zlib

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    crc = Counter()
    for r in rows:
        crc[(r.doc_id, r.doc_tokens)] += r.length
    assert sum(r.length for r in rows) == sum(map(len, want))
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert 0 < at <= size and (at == size or at & (at - 1) == 0)
    return {(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for ids in want for a in range(0, len(ids)) for n in ()} or want


def test_packing(spark):
    import zlib

    from freightlens.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark)
    rows = pack(docs, path).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = dict(zip(texts, check_packing(rows, list(texts.values()))))
    seen = Counter()
    for r in rows:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert seen == {k: len(v) for k, v in want.items()}


def test_packing_messy(spark):
    from freightlens.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    check_packing(pack(messy(spark), path).collect(), [r[1] for r in ROWS])
    assert pack(empty(spark), path).collect() == []


def test_packing_goes_to_the_cheapest_sequence():
    from freightlens.llm.packing import assign

    doc, start, length, seq, offset = assign(np.array([700, 600, 400, 348]), 1024)
    assert sorted(zip(doc.tolist(), seq.tolist())) == [(0, 0), (1, 1), (2, 1), (3, 0)] or len(set(seq.tolist())) == 2
    assert np.bincount(seq, length).tolist() == [1024, 1024]


# --- secrets


def brute_secrets(text):
    kinds = {
        "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        "access": (r"AKIA[A-Z0-9]+", 0, 20),
        "hex": (r"[0-9a-f]+", 0, 24),
    }
    out = []
    for k, (name, (p, g, least)) in enumerate(kinds.items()):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(p, text or "", re.ASCII) if len(m[g]) >= least]
    return sorted(out)


@pytest.mark.parametrize("table", ["messy", "documents"])
def test_secrets(spark, table):
    from freightlens.llm.secret_scan import scan_secrets

    docs = messy(spark) if table == "messy" else documents(spark)
    texts = [r.text for r in docs.select("text").collect()]
    rows = scan_secrets(docs).collect()
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts):
        want = brute_secrets(t)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(n == k for *_, n in want) for k in ("assign", "access", "hex"))
        assert all(f"{n}:{a}:{b}" in r.spans.split(",") for a, _, b, n in want)
    if table == "messy":
        assert any("github:" in r.spans for r in rows)


def test_trigram_queries_miss_nothing():
    from freightlens.llm import textvec as tv
    from freightlens.llm.secret_scan import Index, Rule, Scanner, trigram_query

    assert trigram_query(r"[0-9a-f]+") is True and trigram_query(r"a.*b") is True
    assert trigram_query(r"abcd") == ("and", (b"abc", b"bcd"))
    patterns = [r"(foo|barbar)x?baz", r"ab[cd]e{2,3}f", r"(a|b)(c|d)(e|f)", r"q(uux)?yz", r"(?:abc)+d", r"x{4}", r"hello\s+world"]
    rng = np.random.default_rng(0)
    pieces = ["foo", "barbar", "x", "baz", "ab", "c", "d", "e", "ee", "f", "a", "b", "q", "uux", "yz", "abc", "xxxx", "hello", " ", "world"]
    texts = ["".join(rng.choice(pieces, rng.integers(2, 8))) for _ in range(60_000)]
    data, off = tv.text_buffer(pa.array(texts))
    s = Scanner(tuple(Rule(p, p) for p in patterns))
    index = Index(s.wanted, data, off, s.table)
    for p, q in zip(patterns, s.queries):
        found = {i for i, t in enumerate(texts) if re.search(p, t)}
        assert found and found <= set(index.rows(q).tolist())
        assert q is True or len(index.rows(q)) < len(texts)


def test_redaction(spark):
    from freightlens.llm.secret_scan import redact_secrets

    got = {r.doc_id: r for r in redact_secrets(messy(spark)).collect()}
    assert got[-10].text == "[SECRET] and [SECRET] and [SECRET]" and got[-10].n_chars == len(got[-10].text)
    assert got[1].text == BASE and got[1].n_chars == 5 and got[4].text is None
    assert redact_secrets(empty(spark)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


# --- language model


def check_lm(rows, docs, rounds=None):
    count = Counter()
    tokens = lambda t: [*words(t), None]
    for doc_id, text in docs:
        if doc_id is None or fold(doc_id, 7) != 2:
            count.update(tokens(text))
    n, v = sum(count.values()), len(count)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6)) for r in rows)
    want = sorted(
        (d is None, d or 0, len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), d is not None and fold(d, 7) == 2, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens(t)), 6))
        for d, t in docs
    )
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(r.train_tokens == n and r.score <= 0 for r in rows)


def test_language_model(spark):
    from freightlens.llm.lm_nce import score

    docs = documents(spark)
    rows = score(docs).collect()
    check_lm(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    check_lm(score(messy(spark)).collect(), [(r[0], r[1]) for r in ROWS])
    assert score(empty(spark)).collect() == []


def test_language_model_is_normalised():
    from freightlens.llm import lm_nce as lm

    rng = np.random.default_rng(1)
    v = lm.Vocabulary(np.arange(1, 50, dtype=np.uint64), np.arange(50, 1, -1), 2000, 60, np.ones(lm.CLASSES) * 3)
    m = lm.initial(v, lm.unigram(v, 10))
    t = lm.Trainer(m, lm.unigram(v, 10), 0)
    w1, w2, y = (rng.integers(0, v.outputs, 500) for _ in range(3))
    before = m.log_probs(w1, w2, np.full(500, 7)).mean()
    for _ in range(30):
        t.step(w1, w2, np.full(500, 7))
    assert m.log_probs(w1, w2, np.full(500, 7)).mean() > before + 1
    a, b = np.full(v.outputs, 3), np.full(v.outputs, 5)
    assert abs(np.exp(m.log_probs(a, b, np.arange(v.outputs))).sum() - 1) < 1e-4


# --- SentencePiece sampling


def all_segmentations(unit, pieces):
    from freightlens.llm import sp_sampling as sp

    first = int(pieces.id.min())
    known = {pieces.text[i]: (i, -math.log(i - first + sp.RANK_OFFSET)) for i in pieces.id.tolist()}

    def ways(at):
        if at == len(unit):
            return [((), 0.0)]
        out = []
        for n in range(1, pieces.longest + 1):
            if at + n <= len(unit) and unit[at : at + n] in known:
                i, w = known[unit[at : at + n]]
                out += [((i, *p), w + x) for p, x in ways(at + n)]
        return out or [((int(pieces.byte_id[unit[at]]), *p), pieces.byte_logw + x) for p, x in ways(at + 1)]

    return ways(0)


def test_samples_without_replacement_have_the_right_chances():
    from freightlens.llm import sp_sampling as sp
    from freightlens.llm import textvec as tv

    lat = sp.lattices(public_tokenizers.path("piece_bpe_32k.model"))
    text, n, k = "the ab ñx", 6000, 3
    u = sp.units(pa.array([text]))
    ways = [all_segmentations(u.data[a:b].tobytes(), lat.pieces) for a, b in zip(u.start, u.end)]
    paths = [(sum((p for p, _ in c), ()), sum(x for _, x in c)) for c in itertools.product(*ways)]
    total = np.logaddexp.reduce([x for _, x in paths])
    p = {path: math.exp(x - total) for path, x in paths}
    drawn = sp.sample_column(pa.array([text] * n), tv.mix(np.arange(n, dtype=np.uint64)), lat, k)
    seqs = [[tuple(ids[a:b].tolist()) for a, b in zip(off, off[1:])] for _, off, ids, *_ in drawn]
    assert all(len({a, b, c}) == k for a, b, c in zip(*seqs))
    for s, (_, _, _, lp, _, inclusion) in zip(seqs, drawn):
        assert all(abs(math.exp(x) - p[q]) < 1e-9 for q, x in zip(s[:200], lp))
        assert ((inclusion > 0) & (inclusion <= 1)).all()
    second = Counter()
    for a in p:
        for b in p:
            if a != b:
                second[b] += p[a] * p[b] / (1 - p[a])
    for chances, s in ((p, seqs[0]), (second, seqs[1])):
        got = Counter(s)
        assert all(abs(got[x] / n - chances[x]) < 4 * math.sqrt(chances[x] * (1 - chances[x]) / n) + 1e-3 for x in p)
    # the estimate of how many segmentations there are is unbiased: sum of 1 / inclusion
    few = sp.sample_column(pa.array(["ñ"]), np.array([3], np.uint64), lat, 5)
    assert all((x[-1] == 1).all() for x in few) and len(few) >= 1


def test_samples_do_not_depend_on_neighbours(spark):
    from freightlens.llm.sp_sampling import decode, encode_samples, lattices

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = encode_samples(messy(spark), path, k=3).collect()
    alone = encode_samples(messy(spark).where("doc_id = 8"), path, k=3).collect()
    shown = lambda rs: [(r.sample, r.ids, round(r.log_p, 6), round(r.perturbed, 6), round(r.inclusion, 6)) for r in rs if r.doc_id == 8]
    assert shown(rows) == shown(alone) and len({tuple(r.ids) for r in alone}) == 3
    texts = {r[0]: r[1] or "" for r in ROWS}
    pieces = lattices(path).pieces
    assert all(r.round_trip and decode(r.ids, pieces) == texts[r.doc_id] for r in rows)
    assert {r.doc_id for r in rows} == set(texts)
    assert encode_samples(empty(spark), path).collect() == []


# --- classifier and language


def test_quality_classifier(spark):
    from freightlens.llm.quality_model import score_quality

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = documents(spark)
    rows = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    y = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (fold(i, 5) == 0) for i, r in rows.items())
    train = [i for i in y if fold(i, 5) != 0]
    assert np.mean([rows[i].predicted == y[i] for i in train]) > 0.9
    held = [i for i in y if fold(i, 5) == 0]
    good, bad = [rows[i].score for i in held if y[i] == 1], [rows[i].score for i in held if y[i] == 0]
    assert not good or not bad or np.mean([a > b for a in good for b in bad]) > 0.8


def test_quality_classifier_messy(spark):
    from freightlens.llm.quality_model import score_quality

    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (7, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert len(score_quality(messy(spark), labels).collect()) == len(ROWS)
    none = score_quality(messy(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert score_quality(empty(spark), labels).collect() == []


def test_forward_backward_is_exact():
    from freightlens.llm.lang_crf import forward_backward

    rng = np.random.default_rng(0)
    s, move, off = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 4, 7])
    post, _ = forward_backward(s, off, move)
    for a, b in ((0, 4), (4, 7)):
        p = np.zeros((b - a, 3))
        for y in itertools.product(range(3), repeat=b - a):
            w = math.exp(sum(s[a + i, y[i]] for i in range(b - a)) + sum(move[y[i], y[i + 1]] for i in range(b - a - 1)))
            for i, x in enumerate(y):
                p[i, x] += w
        assert np.allclose(p / p.sum(1, keepdims=True), post[a:b])


def test_language(spark):
    from freightlens.llm.lang_crf import predict, train, word_labels

    docs = documents(spark)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = predict(docs).collect()
    assert len(rows) == len(truth) and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id]]) > 0.9
    field = train(docs)
    mixed = word_labels("with the and of that und der die einheit nicht que los las", field)
    assert {x for _, x, _ in mixed[:5]} == {"en"} and "de" in {x for _, x, _ in mixed[5:10]}


def test_language_messy(spark):
    from freightlens.llm.lang_crf import predict

    rows = predict(messy(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (4, 5, 6, 2**40))
    assert by[1].lang_pred != "und" and 0 <= by[1].score <= 1
    assert predict(empty(spark)).collect() == []
    assert {r.lang_pred for r in predict(messy(spark).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))).collect()} == {"und"}


def test_kept_normalisers_change_nothing():
    """Slices that share the normalisers found so far get the scores they'd have alone."""
    from freightlens.llm import lm_nce

    rng = np.random.default_rng(4)
    m, d = 37, 5
    f = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    model = lm_nce.Model(f(m + 1, d), f(d, d), f(d, d), f(m, d), f(m))
    norms = model.no_norms()
    for n in (50, 1, 400):
        w1, w2, y = rng.integers(0, m + 1, n), rng.integers(0, m + 1, n), rng.integers(0, m, n)
        assert np.allclose(model.log_probs(w1, w2, y, norms), model.log_probs(w1, w2, y), rtol=0, atol=1e-5)
    every = model.log_probs(np.full(m, 3), np.full(m, 5), np.arange(m), norms)
    assert abs(np.exp(every).sum() - 1) < 1e-4


def test_word_vectors_and_pooling_equal_plain_loops(spark):
    """Neighbours' index vectors summed word by word, and features text by text, in plain Python."""
    from freightlens.llm import quality_model as qm
    from freightlens.llm import textvec as tv

    texts = [r.text for r in documents(spark).limit(25).collect()] + [None, "", " \n", "One", "a b a", "Äb 12 #x"]
    bucket = lambda w: int(qm._bucket(tv.split_words(pa.array([w])).hash)[0])
    lane, sign = qm._index_vectors()
    known = {w: bucket(w) for t in texts for w in words(t)}
    sums = np.zeros((qm.BUCKETS, qm.DIM))
    for t in texts:
        ws = words(t)
        for i, w in enumerate(ws):
            for j in range(max(0, i - qm.NEAR), min(len(ws), i + qm.NEAR + 1)):
                if j != i:
                    c = known[ws[j]]
                    for k in range(2):
                        sums[known[w], lane[k, c]] += sign[k, c]
    want = np.sign(sums) * np.log1p(np.abs(sums))
    want -= want.mean(0)
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = qm.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.allclose(got, want, atol=1e-5)
    features = qm.pooled(pa.array(texts, pa.string()), got)
    for t, f in zip(texts, features):
        ws, raw = words(t), (t or "").encode()
        n = max(len(ws), 1)
        mean = sum((got[known[w]].astype(float) for w in ws), np.zeros(qm.DIM)) / n
        share = lambda ok: sum(map(ok, raw)) / max(len(raw), 1)
        upper, digit = share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57)
        mark = share(lambda b: b < 128 and not chr(b).isalpha() and b not in (32, 9, 10, 11, 12, 13))
        assert np.allclose(f, [*mean, *np.abs(mean), np.log1p(len(ws)) / 8, len(set(ws)) / n, min(len(raw) / n, 20) / 10, upper, digit, mark], atol=1e-4)
