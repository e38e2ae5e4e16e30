"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A document is the multiset of its paragraphs (lines).  Each paragraph is hashed to
a wide vector, a document's fingerprint is the sum of its paragraphs' vectors, lane
by lane modulo 2^32.  So paragraphs can be added to or taken from a fingerprint
without the rest of the text, and their order does not matter.

Lanes: ``IDENTITY`` lanes are halves of seeded 64-bit hashes of the whole
paragraph, they decide equality.  ``LIKENESS`` lanes count, for each bit, the
paragraph's three-word shingles (shorter at its end) whose hash has that bit; with
the number of shingles they give the signed sum of the shingles' +1/-1 vectors, and
the cosine of two such sums estimates how much of the texts is shared.

Defined cases: null text is an empty text, whose one paragraph is empty; two texts
without words are alike to 1, one without to 0; equal doc_ids are ordered by text; a null
doc_id is ordered first; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.llm.shared import let, words

IDENTITY, LIKENESS = 8, 64
_LOW = (1 << 31) - 1
SUMS = [f"i{k}" for k in range(IDENTITY)] + ["n"] + [f"s{k}" for k in range(LIKENESS // 2)]


def _shingles(paragraph: Column) -> Column:
    return let(words(paragraph), lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))


def vectors(texts: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the paragraphs' vectors for each value of ``by``; ``texts`` has ``by`` and t.

    Lane sums are exact here (two of 31 bits to a long), so they can be added and
    subtracted; ``lanes`` takes them modulo 2^32.
    """
    p = F.col("p")
    hashes = [F.xxhash64(F.lit(seed), p) for seed in range(IDENTITY // 2)]
    halves = [x for h in hashes for x in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    paragraphs = texts.select(*by, F.explode(F.split("t", "\n")).alias("p"))
    paragraphs = paragraphs.select(*by, F.array(*halves).alias("i"), _shingles(p).alias("s"))
    rows = paragraphs.select(*by, "i", F.posexplode_outer("s").alias("nth", "h"))
    head = F.coalesce(F.col("nth"), F.lit(0)) == 0
    h = F.coalesce(F.col("h"), F.lit(0).cast("long"))
    both = (1 << 31) | 1
    sums = [F.sum(F.when(head, F.col("i")[k]).otherwise(F.lit(0).cast("long"))).alias(f"i{k}") for k in range(IDENTITY)]
    sums += [F.count("h").alias("n")]
    sums += [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(both))).alias(f"s{k}") for k in range(LIKENESS // 2)]
    return rows.groupBy(*by).agg(*sums)


def _likeness_lanes(v: dict[str, Column]) -> list[Column]:
    low = [v[f"s{k}"].bitwiseAND(F.lit(_LOW)) for k in range(LIKENESS // 2)]
    high = [F.shiftright(v[f"s{k}"], 31) for k in range(LIKENESS // 2)]
    return low + high


def lanes(v: dict[str, Column]) -> Column:
    """The fingerprint's lanes as an array: identity, number of shingles, likeness."""
    return F.array(*[x.bitwiseAND(F.lit(0xFFFFFFFF)) for x in [v[f"i{k}"] for k in range(IDENTITY)] + [v["n"]] + _likeness_lanes(v)])


def text_form(lane_array: Column) -> Column:
    return F.lower(F.array_join(F.transform(lane_array, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: cosine of the signed likeness sums, 1 for equal fingerprints."""

    def signed(x: Column) -> Column:
        n = F.get(x, F.lit(IDENTITY))
        return F.transform(F.slice(x, IDENTITY + 2, LIKENESS), lambda c: (2 * c - n).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, p: acc + p)

    def cosine(x: Column) -> Column:
        return let(signed(b), lambda y: F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))), F.lit(0.0)))

    none = (F.get(a, F.lit(IDENTITY)) == 0) & (F.get(b, F.lit(IDENTITY)) == 0)
    return F.when(a.eqNullSafe(b) | none, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), let(signed(a), cosine))))


def _buckets(docs: DataFrame, count: int) -> tuple[list[float], list]:
    """Split points of doc_id for ``count`` buckets of about the same size, at most."""
    probs = [i / count for i in range(1, count)]
    got = docs.select(F.percentile_approx(F.col("doc_id").cast("double"), probs, 10_000)).first()[0] or []
    return [float("-inf"), *sorted(set(got)), float("inf")]


def ordered(docs: DataFrame, count: int) -> DataFrame:
    """Rows with the text that follows in the order of doc_id; the last is followed by the first.

    Rows are dealt by ranges of doc_id; the first row of each range is also given
    to the range before, as ``guest``, so a window of one range sees what follows.
    Only the ranges' first ids, at most ``count``, go through the driver.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("double").alias("at"))
    splits = _buckets(docs, count)
    dealt = Bucketizer(splits=splits, inputCol="at", outputCol="range", handleInvalid="keep").transform(docs) if len(splits) > 2 else docs.withColumn("range", F.lit(0.0))
    null = F.col("doc_id").isNull()
    dealt = dealt.withColumn("range", F.when(null, -1).otherwise(F.col("range").cast("int")))
    firsts = {r["range"]: r["first"] for r in dealt.groupBy("range").agg(F.min("doc_id").alias("first")).collect()}
    held = sorted(firsts)
    before = {r: held[i - 1] for i, r in enumerate(held)}
    pairs = F.create_map(*[F.lit(x) for r in held for x in (r, before[r])]) if held else F.create_map(F.lit(0), F.lit(0))
    first = F.create_map(*[F.lit(x) for r in held if firsts[r] is not None for x in (r, firsts[r])]) if any(x is not None for x in firsts.values()) else F.create_map(F.lit(0), F.lit(0).cast("long"))
    order = ["doc_id", "text"]
    is_first = null | (F.col("doc_id") == F.try_element_at(first, F.col("range")))
    # of rows that share a range's first id, the window picks the one with the least text
    copies = F.when(is_first, F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")), F.struct(F.try_element_at(pairs, F.col("range")).alias("range"), F.lit(True).alias("guest"))))
    own = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")))
    spread = dealt.select("doc_id", "text", F.inline(F.coalesce(copies, own)).alias("range", "guest"))
    w = Window.partitionBy("range").orderBy("guest", *order)
    return spread.select("*", F.row_number().over(w).alias("pos"), F.lead("text").over(w).alias("next"), F.lag("guest").over(w).alias("after_guest"))


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to it and the next.

    The edited text's vector is the text's, less the paragraphs from the cut on, plus
    the new ones: the paragraphs before the cut are hashed once.
    """
    spark = docs.sparkSession
    count = ranges or max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = ordered(docs, count).where(~F.col("guest") | ~F.col("after_guest"))
    n = F.length("text")
    cut = n - F.floor(n / 4)
    rows = rows.withColumn("cut", cut.cast("int")).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("cut")), F.substring("next", F.lit(1), F.col("n_chars").cast("int") - F.col("cut"))))
    kept_part = F.substring_index(F.substring("text", F.lit(1), F.col("cut")), "\n", -1)
    from_ = F.col("cut") - F.length(kept_part) + 1
    rest = F.lit(2**31 - 1)
    head = F.when(from_ > 1, F.substring("text", F.lit(1), from_ - 2))
    parts = F.array(F.struct(F.lit(0).alias("part"), head.alias("t")), F.struct(F.lit(1).alias("part"), F.substring("text", from_, rest).alias("t")), F.struct(F.lit(2).alias("part"), F.substring("edited", from_, rest).alias("t")))
    key = ["range", "pos", "doc_id", "guest", "n_chars", "edited_sha256", "part"]
    edited = F.when(F.col("guest"), F.lit(None)).otherwise(F.sha2(F.col("edited").cast("binary"), 256))
    split = rows.select("range", "pos", "doc_id", "guest", "n_chars", edited.alias("edited_sha256"), F.inline(parts).alias("part", "t")).where(F.col("t").isNotNull())
    sums = vectors(split, key)
    of = lambda *parts: {c: F.coalesce(F.sum(F.when(F.col("part").isin(*parts), F.col(c))), F.lit(0).cast("long")) for c in SUMS}
    whole = sums.groupBy(*key[:-1]).agg(lanes(of(0, 1)).alias("a"), lanes(of(0, 2)).alias("b"))
    w = Window.partitionBy("range").orderBy("pos")
    out = whole.withColumn("c", F.lead("a").over(w)).where(~F.col("guest"))
    return out.select("doc_id", "n_chars", "edited_sha256", text_form(F.col("a")).alias("fingerprint"), text_form(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
