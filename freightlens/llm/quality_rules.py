"""Quality rules with cross-document line frequency, in DataFrame functions only.

In-document counts need no shuffle.  Lines are normalised (lower case, white space
runs to one space, trimmed) and hashed; for each host and line the documents that
hold it are counted, and how many different neighbours (lines before and after) it
has there.  A line above the limits is boilerplate: it is in at least ``min_docs``
documents and ``min_share`` of its host's, and its neighbours differ in at least
``min_spread`` of them.  The last limit tells boilerplate from copies of one
document, whose lines always meet the same neighbours; copies are the dedup
stages' work.  A document is depleted if, without such lines, fewer than
``min_words`` words or ``min_left`` of its words are left.

Defined cases: null text has no words and fails the base rule; null source is one
host of its own; equal rows (doc_id, text and source) count as one document and get
equal verdicts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.shared import let, table, words

LIMITS = {"min_docs": 10, "min_share": 0.01, "min_spread": 0.5, "min_words": 10, "min_left": 0.3}


def _repeated_words(window_hashes: Column, n: int = 5) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in order."""

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, j: F.least(F.lit(n), F.coalesce(F.get(at, j + 1) - p, F.lit(n))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        near = lambda e, j: (e["h"] == F.get(s, j)["h"])
        at = F.transform(s, lambda e, j: F.when(F.coalesce(near(e, j - 1), F.lit(False)) | F.coalesce(near(e, j + 1), F.lit(False)), e["i"]))
        return let(F.sort_array(F.array_compact(at)), covered)

    pairs = F.transform(window_hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(window_hashes)) == F.size(window_hashes), F.lit(0)).otherwise(let(F.sort_array(pairs), twice))


def _key() -> Column:
    """With doc_id, tells rows apart that differ."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull(), F.coalesce("source", F.lit("")), F.col("source").isNull())


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, key and the counts inside each document."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def windows(h: Column) -> Column:
        at = F.when(F.size(h) >= 5, F.sequence(F.lit(0), F.size(h) - 5)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))

    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    inner = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    counted = let(inner, lambda h: F.struct(F.size(h).alias("n"), let(windows(h), _repeated_words).alias("r")))
    lines = let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = docs.select(
        "doc_id", _key().alias("key"), counted.alias("c"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
    )
    return out.select("doc_id", "key", F.col("c.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("c.r").cast("long").alias("n_repeat_words"))


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text, empty ones too, in order."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


def line_table(docs: DataFrame) -> DataFrame:
    """One row for each document and distinct line: its words there, and its first neighbours."""
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    each = F.transform(normal_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("h"), F.when(x == "", 0).otherwise(spaces(x) + 1).alias("w")))

    def context(a: Column) -> Column:
        none = F.lit(0).cast("long")
        return F.transform(a, lambda e, i: F.struct(e["h"].alias("h"), e["w"].alias("w"), F.xxhash64(F.coalesce(F.get(a, i - 1)["h"], none), F.coalesce(F.get(a, i + 1)["h"], none)).alias("c")))

    rows = docs.select("doc_id", _key().alias("key"), F.coalesce(F.col("source"), F.lit("")).alias("host"), F.posexplode(let(each, context)).alias("pos", "e"))
    rows = rows.where(F.col("e.w") > 0).select("doc_id", "key", "host", F.col("e.h").alias("line"), F.col("e.c").alias("c"), F.col("e.w").alias("w"), "pos")
    # pos and the low 32 bits of the neighbours' hash share a long, so that the first neighbours are a plain minimum
    first = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("c").bitwiseAND(F.lit(0xFFFFFFFF)))
    return rows.groupBy("doc_id", "key", "host", "line").agg(F.sum("w").alias("w"), F.min(first).bitwiseAND(F.lit(0xFFFFFFFF)).alias("near"))


def boilerplate(lines: DataFrame, docs: DataFrame, limits: dict) -> DataFrame:
    """(host, line) above the limits."""
    hosts = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("host")).agg(F.count("*").alias("host_docs"))
    near = lines.groupBy("host", "line", "near").agg(F.count("*").alias("d"))
    seen = near.groupBy("host", "line").agg(F.sum("d").alias("d"), F.count("*").alias("spread"))
    seen = seen.where((F.col("d") >= limits["min_docs"]) & (F.col("spread") >= limits["min_spread"] * F.col("d")))
    return seen.join(hosts, "host").where(F.col("d") >= limits["min_share"] * F.col("host_docs")).select("host", "line")


def _counted(docs: DataFrame, limits: dict) -> tuple[DataFrame, DataFrame]:
    """Counts and verdicts by (doc_id, key), with the number of equal rows; and the lines that go."""
    lines = table(line_table(docs), "lines")
    hit = table(lines.join(table(boilerplate(lines, docs, limits), "boilerplate"), ["host", "line"]).select("doc_id", "key", "line", "w"), "boilerplate-lines")
    removed = hit.groupBy("doc_id", "key").agg(F.sum("w").alias("w"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    a = measures(docs).groupBy("doc_id", "key").agg(F.count("*").alias("rows"), *[F.max(c).alias(c) for c in counts]).alias("a")
    b = removed.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left")
    # the lines' words are a sum over equal rows
    both = both.select("a.*", F.coalesce(F.col("b.w") / F.col("a.rows"), F.lit(0)).cast("long").alias("removed_words"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    fine = (F.col("removed_words") == 0) | ((left >= limits["min_words"]) & (left >= limits["min_left"] * F.col("n_words")))
    return both.withColumn("base_failed", failed).withColumn("kept", ~failed & fine), hit


def judge(docs: DataFrame, **limits) -> DataFrame:
    """Counts and verdict of every document: base_failed, removed_words, kept."""
    out, _ = _counted(docs.select("doc_id", "text", "source"), LIMITS | limits)
    return out.withColumn("rows", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).drop("rows", "key")


def without_rejected(docs: DataFrame, **limits) -> DataFrame:
    """The documents' columns without rejected documents and without lines above the limits."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    verdict, hit = _counted(docs, LIMITS | limits)
    good = table(verdict.where("kept").select("doc_id", "key"), "kept")
    gone = hit.groupBy("doc_id", "key").agg(F.collect_set("line").alias("gone")).alias("g")
    k = good.alias("k")
    marks = k.join(gone, F.col("k.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("k.key") == F.col("g.key")), "left").select("k.doc_id", "k.key", "gone").alias("m")
    rows = docs.withColumn("key", _key()).alias("d").join(marks, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.key") == F.col("m.key"))).select("d.*", "gone")

    def left(names: Column) -> Column:
        stays = lambda x, i: ~F.coalesce(F.array_contains("gone", F.get(names, i)), F.lit(False))
        return F.array_join(F.filter(F.split("text", "\n"), stays), "\n")

    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(F.transform(normal_lines(F.col("text")), lambda x: F.xxhash64(x)), left))
    n = F.when(F.col("gone").isNull(), F.col("n_chars")).otherwise(F.length("new").cast("long"))
    return rows.withColumn("new", new).select("doc_id", F.col("new").alias("text"), "lang", "source", n.alias("n_chars"))
