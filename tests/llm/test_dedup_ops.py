"""Quality rules, line dedup, n-gram join, fingerprints and the pipeline."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from line_brute import Sets, brute
from messy import BASE, ROWS, empty, messy, words

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- n-gram join


def brute_components(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids, groups = sorted(sets), Sets()
    held = defaultdict(list)
    for i in ids:
        groups.find(groups[i])
        for s in sets[i]:
            held[s].append(i)
    for i in ids:
        for j in {j for s in sets[i] for j in held[s] if j < i}:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                groups.join(i, j)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


def near_copies(n=40, length=120, seed=4):
    """A large group with a few edits each, and words that many documents share."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**6, length)]
    common = "this passage of some words is found in very many documents of all kinds".split()
    out = []
    for i in range(n):
        w = list(base)
        for j in rng.integers(0, length, rng.integers(0, 5)):
            w[j] = f"e{rng.integers(10**9)}"
        out.append((i, " ".join(w)))
    for i in range(n, 2 * n):
        out.append((i, " ".join([f"u{x}" for x in rng.integers(0, 10**6, 20)] + common)))
    return out


@pytest.mark.parametrize("k, percent, source", [(4, 85, "documents"), (5, 80, "copies")])
def test_ngram_join(spark, k, percent, source):
    from freightlens.llm.ngram_join import near_duplicates

    rows = [(r.doc_id, r.text) for r in documents(spark).collect()] if source == "documents" else near_copies()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    want = brute_components(rows, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_ngram_join_messy(spark):
    from freightlens.llm.ngram_join import near_duplicates, one_of_each

    got = near_duplicates(messy(spark), 4, 70).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[1][1] == by[2][1] == by[3][1] == 1 and by[4] == (0, 4) and by[5] == (0, 5) and by[None][1] is None
    assert near_duplicates(empty(spark)).collect() == []
    kept = Counter(r.doc_id for r in one_of_each(messy(spark), 4, 70).collect())
    assert kept[1] == 1 and kept[2] == kept[3] == 0 and kept[4] == kept[5] == kept[None] == 1


# --- lines


def fuzzy_documents():
    rng = np.random.default_rng(9)
    base = [[f"w{x}" for x in rng.integers(0, 10**6, n)] for n in (40, 60, 90)]
    rows = []
    for i in range(60):
        w = list(base[i % 3])
        if i % 4:
            w[int(rng.integers(len(w)))] = f"e{rng.integers(10**6)}"
        rows.append((i, " ".join(w) + "\nshort line\n" + f"unique line number {i} with words {rng.integers(10**9)}"))
    return rows


@pytest.mark.parametrize("source", ["documents", "fuzzy"])
def test_line_dedup(spark, source):
    from freightlens.llm.line_dedup import dedup_lines

    docs = documents(spark).select("doc_id", "text") if source == "documents" else spark.createDataFrame(fuzzy_documents(), "doc_id long, text string")
    gone = brute(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert gone
    for r in dedup_lines(docs).collect():
        lines = texts[r.doc_id].split("\n")
        assert (r.n_lines, r.n_removed) == (len(lines), len(gone[r.doc_id]))
        assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in gone[r.doc_id])


def test_simhash(spark):
    from pyspark.sql import functions as F

    from freightlens.llm.line_dedup import simhashes

    texts = ["a b c d e f g", "one", "x y " * 20_000]
    df = spark.createDataFrame([(t.strip(),) for t in texts], "line string")
    rows = simhashes(df, ["line"]).select(F.col("sim").alias("s"), F.transform(F.array_distinct(F.split("line", " ")), lambda w: F.xxhash64(w)).alias("h")).collect()
    assert len(rows) == 3
    for r in rows:
        h = np.array(r.h, np.int64).view(np.uint64)
        bits = [(2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)) << b for b in range(64)]
        assert np.int64(r.s).astype(np.uint64) == np.uint64(sum(bits))


def test_line_dedup_messy(spark):
    from freightlens.llm.line_dedup import dedup_lines, without_repeated_lines

    rows = dedup_lines(messy(spark)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(rows) == len(ROWS)
    assert by[1][0].text == BASE and [r.text for r in by[2]] == ["", ""]
    assert by[4][0].text is None and by[5][0].text == "" and by[6][0].text == " \n\t "
    assert by[8][0].text == "first line with seven words in it\n\nCafé Ärger 中文 😀 line with words"
    assert by[9][0].text == "second line with other seven words here"
    assert dedup_lines(empty(spark)).collect() == []
    left = Counter(r.doc_id for r in without_repeated_lines(messy(spark)).collect())
    assert left[2] == 0 and left[1] == left[4] == left[5] == left[6] == 1


# --- quality rules


def test_quality_rules_messy(spark):
    from freightlens.llm.quality_rules import judge, without_rejected

    rows = judge(messy(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and by[1].kept and by[1].n_words == 34 and by[1].word_chars == len(BASE.replace(" ", ""))
    assert by[4].base_failed and by[4].n_words == 0 and by[7].base_failed and by[7].n_repeat_words == 15_000
    assert by[8].n_dup_lines == 1 and by[2**40].n_symbols == 6 and not by[2**40].kept
    assert judge(empty(spark)).collect() == []
    kept = without_rejected(messy(spark))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)


def test_boilerplate_lines_go_and_copies_stay(spark):
    from freightlens.llm.quality_rules import judge, without_rejected

    rng = np.random.default_rng(2)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    notice = "All rights reserved by the owner of this very site"
    rows = [(i, f"{line(30)}\n{notice}\n{line(30)}", "h") for i in range(30)]
    rows += [(i, f"{line(3)}\n{notice}\n{line(2)}", "h") for i in range(30, 50)]
    copy = "\n".join(line(20) for _ in range(4))
    rows += [(i, copy, "h") for i in range(50, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in judge(docs).collect()}
    n = len(notice.split())
    assert all(got[i].removed_words == n and got[i].kept for i in range(30))
    assert all(got[i].removed_words == n and not got[i].kept and not got[i].base_failed for i in range(30, 50))
    assert all(got[i].removed_words == 0 and got[i].kept for i in range(50, 90))
    full = docs.selectExpr("doc_id", "text", "'en' AS lang", "source", "cast(1 as long) AS n_chars")
    texts = {r.doc_id: r.text for r in without_rejected(full).collect()}
    assert notice not in texts[0] and texts[0].count("\n") == 1 and texts[60] == copy and 30 not in texts


# --- fingerprints


def test_fingerprints(spark):
    from freightlens.llm.fingerprint import fingerprints

    docs = documents(spark)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    edited = {i: texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[after[i]][: len(texts[i]) // 4] for i in ids}
    rows = {r.doc_id: r for r in fingerprints(docs, 7).collect()}
    assert set(rows) == set(ids)
    whole = {r.doc_id: r.fingerprint for r in fingerprints(spark.createDataFrame(list(edited.items()), "doc_id long, text string")).collect()}
    prints = defaultdict(set)
    for i, r in rows.items():
        assert r.n_chars == len(texts[i])
        assert r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        assert r.edited_fingerprint == whole[i]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[r.fingerprint].add("\n".join(sorted(texts[i].split("\n"))))
    assert all(len(x) == 1 for x in prints.values()) and len(prints) == len({"\n".join(sorted(t.split("\n"))) for t in texts.values()})
    assert np.median([r.near_edited for r in rows.values()]) > 0.6 and np.median([r.near_next for r in rows.values()]) < 0.2


def test_fingerprints_messy(spark):
    from freightlens.llm.fingerprint import fingerprints

    rows = fingerprints(messy(spark)).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint != by[3].fingerprint and by[4].fingerprint == by[5].fingerprint
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    edits = Counter((r.doc_id, r.edited_sha256) for r in rows)
    want = Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        t, n = a[1] or "", len(a[1] or "") // 4
        want[(a[0], hashlib.sha256((t[: len(t) - n] + (b[1] or "")[:n]).encode()).hexdigest())] += 1
    assert edits == want
    assert fingerprints(empty(spark)).collect() == []


def test_fingerprints_add_and_delete(spark):
    """Order does not matter, and sums of paragraphs' vectors are the documents'."""
    from freightlens.llm.fingerprint import SUMS, vectors

    rows = [(1, "a b c\nd e f\n\ng"), (2, "g\n\nd e f\na b c"), (3, "a b c"), (4, "d e f"), (5, ""), (6, "g")]
    got = {r["k"]: [r[c] for c in SUMS] for r in vectors(spark.createDataFrame(rows, "k long, t string"), ["k"]).collect()}
    assert got[1] == got[2] == [sum(x) for x in zip(*(got[i] for i in (3, 4, 5, 6)))]


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = documents(spark)
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        rows = {r.doc_id: r for r in out.collect()}
        assert 0.5 * len(before) < len(rows) <= len(before)
        assert all(r.n_chars == len(r.text) for i, r in rows.items() if r.text != before[i].text)
        docs, before = spark.createDataFrame(list(rows.values()), out.schema), rows
    tokens = sum(r.length for r in cp.STAGES[-1][1](spark, docs, SF).collect())
    assert tokens >= len(before)
    assert sum(r.length for r in cp.run(spark, SF).collect()) == tokens


def test_pipeline_messy(spark):
    import corpus_pipeline as cp

    for table in (messy(spark), empty(spark)):
        docs, before = table, Counter(r.doc_id for r in table.collect())
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            rows = docs.collect()
            left = Counter(r.doc_id for r in rows)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(n <= before[i] for i, n in left.items())
            assert all(words(r.text) for r in rows)
            before = left
        packed = cp.STAGES[-1][1](spark, docs, SF).collect()
        assert {r.doc_id for r in packed} == set(before)
        # Of the first row's near copies one stays; short, empty and null texts go; the row without an id stays.
        assert set(before) == set() if table.isEmpty() else before[1] == 1 and not before[3] and not before[5] and not before[4] and before[None] == 1


def test_components_in_two_goes(spark):
    import random

    from freightlens.llm.components import components, joined

    rng = random.Random(5)
    first = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)]
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(60)] + [(None, 3), (7, 7)]

    def brute(links):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in links:
            if a is not None and a != b:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        return {x: find(x) for x in root}

    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    rows = lambda df: sorted((r["node"], r["comp"]) for r in df.collect())
    comps = components(frame(first))
    assert rows(comps) == sorted(brute(first).items())
    assert rows(joined(comps, frame(more))) == sorted(brute(first + more).items())
    assert rows(joined(comps, frame([]))) == rows(comps)
    assert rows(components(frame([]))) == []
