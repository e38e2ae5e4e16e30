"""Byte-level BPE, token alignment and phrase mining against brute force."""

import base64
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from messy import empty, messy
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "  ", "a ", " a", "a  ", "\n", " \n\n b", "it's 'tis I'll've'", "'s's''s", "x" * 300, "é" * 90, " " * 100 + "z", "中文字" * 40, "a  b   c", "▁ x", "<|endoftext|><s>",
        "tab\tand\r\nlines \n x", "é ½²3", "\x00\x01 a", "=" * 200 + "'re", "😀 😀😀", "　 w", "a\u0085 b", "\x1c x\x1f y"]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def own_rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- byte-level BPE

PIECES = st.lists(st.sampled_from(["'", "s", "re", "ve", "ll", "d", "T", " ", "  ", "\n", "\t", "7", "²", "é", "中", "!", "=-", " ", "word", " the", "́", "😀"]) | st.characters(exclude_categories=["Cs"]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES | st.none(), max_size=6))
def test_bpe_equals_library(texts):
    from freightlens.llm.byte_bpe import encoder

    want = reference()
    ids, begin, off = encoder(RANKS).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        ours = ids[off[i] : off[i + 1]].tolist()
        assert ours == want.encode_ordinary(t or "")
        sizes = [len(want.decode_single_token_bytes(x)) for x in ours]
        assert begin[off[i] : off[i + 1]].tolist() == [sum(sizes[:k]) for k in range(len(sizes))]


def test_scan_equals_steps():
    """The scan over composed functions gives the states of a walk from left to right."""
    from freightlens.llm import byte_bpe as bb

    rng = np.random.default_rng(3)
    to, _ = bb._scanner()
    for n in (0, 1, 255, 256, 257, 70_000):
        f = rng.integers(0, 8, n).astype(np.uint8)
        f[rng.random(n) < 0.01] += 8
        state, walk = bb.FRESH, []
        for x in f.tolist():
            walk.append(state)
            state = to[bb.FRESH if x >= 8 else state, x % 8]
        assert bb._scan(f).tolist() == walk


def test_long_slices_and_cache():
    from freightlens.llm.byte_bpe import Encoder, Vocabulary, merge_all, merge_one

    want, enc = reference(), Encoder(RANKS, keep=3)
    for t in ("ab" * 5000, "x" * 3000 + " " * 900, "=-" * 700, "a b c d e f g a b"):
        assert enc.encode(pa.array([t]))[0].tolist() == want.encode_ordinary(t)
    vocab = Vocabulary(RANKS)
    rng = np.random.default_rng(5)
    parts = [bytes(rng.choice(list(b"theraionsd \xc3\xa9"), rng.integers(1, 60)).tolist()) for _ in range(300)]
    ids, n = merge_all(vocab, np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]))
    assert ids.tolist() == [x for p in parts for x in merge_one(vocab, p)]
    assert n.sum() == len(ids)


def check_bpe(spark, docs):
    from freightlens.llm.byte_bpe import decode, digests, encode

    want = reference()
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    encoded = encode(docs, RANKS)
    got = sorted(digests(encoded, RANKS).collect(), key=str)
    rows = []
    for doc_id, t in texts:
        ids = want.encode_ordinary(t)
        rows.append((doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
    assert sorted((r.doc_id or 0, bytes(r.bytes).decode()) for r in decode(encoded, RANKS).collect()) == sorted((d or 0, t) for d, t in texts)


def test_byte_bpe(spark):
    check_bpe(spark, documents(spark))
    check_bpe(spark, messy(spark))
    check_bpe(spark, own_rows(spark, HARD))
    check_bpe(spark, empty(spark))


# --- alignment


def brute_alignment(texts):
    """(n_a, n_b, groups text, links) of each text, by walking the two token lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(FILES[0])
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out = []
    for t in texts:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        a_bytes = [bytes(char[c] for c in tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + t).encode() if t else b""
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b, a_bytes, b_bytes = [], [], [], []
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            x, y = i, j
            while i < len(a) and a_ends[i] <= end:
                i += 1
            while j < len(b) and b_ends[j] <= end:
                j += 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            links += [(a[p], b[q]) for p in range(x, i) for q in range(y, j) if a_ends[p] == b_ends[q]]
        out.append((len(a), len(b), ";".join(groups), links, sorted(set(a_ends) & set(b_ends))))
    return out


def check_alignment(spark, docs, most):
    from freightlens.llm.token_align import align, pair_counts, weigh

    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    brute = brute_alignment([t for _, t in rows])
    count = Counter(x for b in brute for x in b[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    aligned = align(docs, *FILES)
    got = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.groups, r.group_ends, [(x >> 32, x & 0xFFFFFFFF) for x in r.links]) for r in aligned.collect()), key=str)
    assert got == sorted(((d, b[0], b[1], b[2].count("|"), b[2], b[4], b[3]) for (d, _), b in zip(rows, brute)), key=str)
    pairs = pair_counts(aligned)
    assert {(r.pair >> 32, r.pair & 0xFFFFFFFF): (r.n, r.best) for r in pairs.collect()} == {p: (n, best[p[1]] == n) for p, n in count.items()}
    got = sorted(map(tuple, weigh(aligned, pairs, most).select("doc_id", "n_links", "n_best", "count_sum").collect()), key=str)
    assert got == sorted(((d, len(b[3]), sum(count[p] == best[p[1]] for p in b[3]), sum(count[p] for p in b[3])) for (d, _), b in zip(rows, brute)), key=str)


def test_token_alignment(spark):
    from freightlens.llm.token_align import FREQUENT

    check_alignment(spark, documents(spark).limit(60), FREQUENT)
    check_alignment(spark, documents(spark).limit(60), 50)  # most pairs go by the join
    check_alignment(spark, messy(spark), 3)
    check_alignment(spark, own_rows(spark, HARD + HARD), 0)
    check_alignment(spark, empty(spark), FREQUENT)


def test_overlaps_expand():
    from freightlens.llm.token_align import coalesce, overlaps

    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.sort(rng.choice(np.arange(1, 40), rng.integers(1, 12), replace=False)) for _ in range(2))
        b[-1] = a[-1] = 41
        a0, b0 = np.append(0, a[:-1]), np.append(0, b[:-1])
        i, j = overlaps(a0, a, b0, b)
        assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(len(a)) for y in range(len(b)) if a0[x] < b[y] and b0[y] < a[x]}
        order, group = coalesce(np.append(a0, b0), np.append(a, b), np.repeat([0, 1], [len(a), len(b)]))
        ends = [int(np.append(a, b)[order][group == g].max()) for g in range(group[-1] + 1)]
        assert ends == sorted(set(a.tolist()) & set(b.tolist()))


def test_alignment_of_units_equals_whole_texts(spark):
    """A vocabulary that joins across spaces takes whole texts as units; the result is the same."""
    from freightlens.llm.token_align import Aligner, byte_level, sentence_piece

    texts = pa.array([r.text for r in documents(spark).limit(20).collect()] + HARD)
    by_unit, whole = Aligner(byte_level(FILES[0]), sentence_piece(FILES[1]), keep=50), Aligner(byte_level(FILES[0]), sentence_piece(FILES[1]))
    whole.splits = False
    a, b = by_unit.align(texts), whole.align(texts)
    assert a["counts"].tolist() == b["counts"].tolist()
    for k in ("text", "ends", "links"):
        assert a[k][0].tolist() == b[k][0].tolist() and a[k][1].tolist() == b[k][1].tolist()


# --- phrases


def brute_collocations(rows, least, top=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^ \t]+", piece)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f["und" if lang is None else lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        n = sum(c for g, c in count.items() if len(g) == 1)
        good = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        hidden = {g[i : i + k] for g, a in good.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= 80 * count[g[i : i + k]]}
        best = []
        for g, a in good.items():
            if g not in hidden:
                score, cut = min((2000000 * a // (count[g[:k]] + count[g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), count[g[:cut]], count[g[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def check_phrases(docs, least, top=2000, sample=8):
    from freightlens.llm.phrases import collocations

    got = sorted(map(tuple, collocations(docs, least, top, sample).collect()))
    assert got == brute_collocations([(r.text, r.lang) for r in docs.collect()], least, top)
    return got


def test_phrases(spark):
    assert check_phrases(documents(spark), 30)
    assert check_phrases(documents(spark), 4, top=50)
    check_phrases(messy(spark), 2)
    check_phrases(empty(spark), 30)


def test_border_failures_are_expanded(spark, monkeypatch):
    """A sample that proposes nothing: words, then pairs, threes and fours are found in passes."""
    from freightlens.llm import phrases

    passes = []
    count = phrases._count
    monkeypatch.setattr(phrases, "_count", lambda rows, old, new: passes.append(new is None) or count(rows, old, new))
    docs = documents(spark)
    got = check_phrases(docs, 6, sample=1 << 40)
    assert passes == [True, False, False, False, False]
    passes.clear()
    assert check_phrases(docs, 6, sample=1) == got
    assert passes == [True, False]


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    """Chance hits, here nearly everywhere, only make more phrases be counted."""
    from freightlens.llm import phrases

    bitmap = phrases.bitmap
    monkeypatch.setattr(phrases, "bitmap", lambda keys, bits=7: bitmap(keys, bits))
    check_phrases(documents(spark).limit(80), 5)


def test_scores_beyond_64_bits(spark):
    a, part = 10**13, 10**13 + 7
    expr = "cast((cast(a as decimal(28, 0)) * 2000000) div (cast(l as decimal(28, 0)) + r) as bigint)"
    assert spark.createDataFrame([(a, part, part + 1)], "a long, l long, r long").select(F.expr(expr)).first()[0] == 2000000 * a // (2 * part + 1)
