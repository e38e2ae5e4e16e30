"""Near-duplicate documents by the Jaccard similarity of their word n-grams: grouped prefix join.

A document is the set of hashes of its distinct n-grams (all its words as one, if
fewer).  All sets are ordered by one global order, rare first: n-grams are counted,
over all documents, in ``COUNTERS`` hash counters, and a counter's rank heads the
n-gram's token.  Two sets that are similar enough share a token among their first
``n - ceil(t * n) + 1``, their prefix.

1. Equal sets are one node.  Nodes of one size and prefix are one group.
2. A token's groups are joined with the token's leader, the group with the fewest
   tokens of its own; pairs are filtered by size and position, expanded to the
   groups' members, filtered by parity bitmaps and verified on whole sets.  Links give
   components.
3. What is left to find are links between components (``components.merged``): pairs of
   nodes of different components that share a token, filtered and verified likewise.
   So a large group of near copies is never expanded into all its pairs, and no link
   between components is lost.

A set's parity bitmap has one bit for each of 256 hash classes: whether the class has an
odd number of its tokens.  Two sets differ in at least as many tokens as their bitmaps
in bits, so the filter drops no pair that is similar enough.

Defined cases: null or empty text has no n-grams and links with nothing; a null doc_id
has no component; rows with equal doc_id count as one document for links; an empty
table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm import textvec as tv
from freightlens.llm.components import merged
from freightlens.llm.shared import table

WORDS, PERCENT = 5, 80
COUNTER_BITS, BLOCK = 18, 1 << 14
BITMAP_BITS = 22
BITS = ["g0", "g1", "g2", "g3"]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_hashes(w: tv.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of all rows, and the rows' offsets; repeats stay."""
    n = np.diff(w.off)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    off = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(off[-1]) - np.repeat(off[:-1] - w.off[:-1], count)
    size = np.minimum(np.repeat(n, count), k)
    h = size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    padded = np.concatenate((w.hash, np.zeros(k, np.uint64)))
    for j in range(k):
        h = h + np.where(size > j, padded[at + j] * _ODD[j % len(_ODD)] ** np.uint64(1 + j // len(_ODD)), np.uint64(0))
    return tv.mix(h), off


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def token_sets(w: tv.Words, k: int, rank: np.ndarray | None) -> list[np.ndarray]:
    """Each row's sorted distinct tokens; tokens are the hashes if there are no ranks."""
    h, off = shingle_hashes(w, k)
    if rank is not None:
        shift = np.uint64(64 - COUNTER_BITS)
        h = (rank[_counter(h)] << shift) | (h & ((np.uint64(1) << shift) - np.uint64(1)))
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        s = np.sort(h[a:b])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
    return out


def counter_ranks(docs: DataFrame, k: int) -> np.ndarray:
    """Ranks of the counters by how many documents' n-grams they hold; of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for b in tv.slices(batches):
            sets = token_sets(tv.split_words(b.column(0)), k, None)
            total += np.bincount(_counter(np.concatenate(sets)), minlength=len(total))
        parts = total.reshape(-1, BLOCK)
        some = np.flatnonzero(parts.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([parts[i].astype("<u4").tobytes() for i in some], pa.binary())], names=["block", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for b in batches:
            for x in b.column(b.schema.get_field_index("counts")).to_pylist():
                total += np.frombuffer(x, "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])

    schema = "block long, counts binary"
    total = np.zeros(1 << COUNTER_BITS, np.int64)
    for r in docs.select("text").mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).collect():
        total[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.int64)
    rank = np.empty(len(total), np.uint64)
    rank[np.argsort(total, kind="stable")] = np.arange(len(total), dtype=np.uint64)
    return rank


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefixes(docs: DataFrame, k: int, percent: int, rank: np.ndarray) -> DataFrame:
    """doc_id, a hash of the text, set size n, a 128-bit sum and the parity bitmap of the set, its prefix in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.slices(batches):
            sets = token_sets(tv.split_words(b.column(2)), k, rank)
            n = [len(s) for s in sets]
            sums = [[int(np.add.reduce(tv.mix(s ^ salt))) for s in sets] for salt in _ODD[:2]]
            cut = [s[: _prefix(len(s), percent)].view(np.int64) if len(s) else s.view(np.int64) for s in sets]
            odd = np.array([np.bincount((tv.mix(s ^ _ODD[2]) & np.uint64(255)).astype(np.int64), minlength=256) & 1 for s in sets], np.uint8)
            bits = np.packbits(odd, axis=1, bitorder="little").view(np.int64)
            off = np.concatenate(([0], np.cumsum([len(c) for c in cut])))
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(cut), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *[pa.array(np.array(s, np.uint64).view(np.int64)) for s in sums], *[pa.array(bits[:, j]) for j in range(4)], lists], names=["doc_id", "text_key", "n", "s1", "s2", *BITS, "prefix"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, n long, s1 long, s2 long, g0 long, g1 long, g2 long, g3 long, prefix array<long>")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, 2^BITMAP_BITS bits whatever their number."""
    x = F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP_BITS)) + 1
    got = ids.groupBy(F.bitmap_bucket_number(x).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).collect()
    out = np.zeros(1 << BITMAP_BITS, bool)
    for r in got:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        out[(r["k"] - 1) * len(bits) : r["k"] * len(bits)] = bits
    return out


def whole_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set) of the documents whose id is in ``ids``: sorted tokens as bytes."""
    wanted = np.packbits(_bitmap(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(wanted).astype(bool)
        for b in batches:
            keep = flags[b.column(1).to_numpy(zero_copy_only=False)]
            b = b.filter(pa.array(keep))
            for c in tv.slices(iter([b]), "text"):
                sets = token_sets(tv.split_words(c.column(2)), k, None)
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    x = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP_BITS)).cast("int")
    sets = docs.where("doc_id IS NOT NULL").select("doc_id", x.alias("x"), "text").mapInArrow(run, "id long, set binary")
    return sets.join(ids, "id", "left_semi")


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    pairs = table(pairs.distinct(), "pairs")
    ids = table(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "pair-ids")
    sets = table(whole_sets(docs, ids, k), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    rows = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return table(rows.mapInArrow(run, "a long, b long"), "verified")


def _close(percent: int, m: F.Column, at: F.Column) -> F.Column:
    """Size and position filter of two entries (n, pos) and (m, at) of one token."""
    need = (F.col("n") + m) * percent
    most = F.least(F.col("n") - F.col("pos"), m - at)
    return (F.col("n") * 100 >= m * percent) & (m * 100 >= F.col("n") * percent) & (most * (100 + percent) >= need)


def _few_odd(percent: int, m: F.Column, other) -> F.Column:
    """Parity filter: the bitmaps differ in no more bits than similar sets of sizes n and m may."""
    differ = sum((F.bit_count(F.col(g).bitwiseXOR(other(g))) for g in BITS), F.lit(0))
    return differ * (100 + percent) <= (F.col("n") + m) * (100 - percent)


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, and a hash of its text."""
    tv.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rank = counter_ranks(docs, k)
    sets = table(prefixes(docs, k, percent, rank), "prefixes")
    keys = ["n", "s1", "s2"]
    full = sets.where("n > 0 AND doc_id IS NOT NULL")
    nodes = table(full.groupBy(*keys).agg(F.min("doc_id").alias("node")), "nodes")

    first = full.join(nodes, keys).where("doc_id = node").select("node", "n", *BITS, F.xxhash64("prefix").alias("ph"), "prefix")
    first = table(first.dropDuplicates(["node", "n", "ph"]), "node-prefixes")
    groups = first.groupBy("n", "ph").agg(F.min("node").alias("grp"), F.count("*").alias("size"))
    members = table(first.select("node", "n", "ph", *BITS).join(groups, ["n", "ph"]).select("grp", "node", "n", "size", *BITS), "members")
    alone = first.join(groups, ["n", "ph"]).where("node = grp")
    posts = alone.select("grp", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    own = table(posts.join(shared, "token"), "postings")

    # the group with the fewest tokens before its first shared one leads; ties by hash
    ahead = own.groupBy("grp").agg(F.min("pos").alias("own"))
    rated = own.join(ahead, "grp").withColumn("key", F.shiftleft(F.col("own").cast("long"), 40).bitwiseOR(F.shiftrightunsigned(F.xxhash64("grp"), 24)))
    rated = table(rated.select("token", "grp", "n", "pos", "key"), "rated")
    best = rated.groupBy("token").agg(F.min("key").alias("key"))
    leaders = rated.join(best, ["token", "key"]).select("token", F.col("grp").alias("lead"), F.col("n").alias("m"), F.col("pos").alias("at"))
    stars = rated.join(leaders, "token").where(F.col("grp") != F.col("lead")).where(_close(percent, F.col("m"), F.col("at"))).select("grp", "lead").distinct()
    # groups to members: each member with the other group's first, and with its own group's first
    pairs = stars.join(members.select("grp", "node"), "grp").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    pairs = pairs.unionAll(members.where("node <> grp").select(F.col("node").alias("a"), F.col("grp").alias("b")))
    bits = members.select("node", "n", *BITS)
    pairs = pairs.distinct().join(bits.withColumnRenamed("node", "a"), "a")
    pairs = pairs.join(bits.select(F.col("node").alias("b"), F.col("n").alias("m"), *[F.col(g).alias(f"_{g}") for g in BITS]), "b")
    pairs = pairs.where(_few_odd(percent, F.col("m"), lambda g: F.col(f"_{g}")))
    links = verified(docs, pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), k, percent)

    # between components: all members of all groups, under the prefix's tokens and the group itself
    wide = rated.select("token", "grp", "pos").unionAll(members.where("size > 1 AND node = grp").select(F.xxhash64("grp", F.lit("group")).alias("token"), "grp", F.lit(0).alias("pos")))
    entries = wide.join(members.select("grp", "node", "n"), "grp").select("token", "node", "n", "pos")
    near = lambda c: _close(percent, c("n"), c("pos")) & _few_odd(percent, c("n"), c)
    comps = merged(entries, links, ["n", "pos", *BITS], near, lambda pairs: verified(docs, pairs, k, percent), bits.drop("n"))

    final = nodes.join(comps, "node", "left").select(*keys, F.coalesce("comp", "node").alias("component_id"))
    linked = full.select("doc_id", "text_key", *keys).join(final, keys).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_key")
    single = sets.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key")
    return linked.unionAll(single)


def one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents' columns; of each component only the rows with its least doc_id stay."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    copies = table(near_duplicates(docs, k, percent).where("doc_id <> component_id").select("doc_id", "text_key").distinct(), "copies")
    return docs.withColumn("text_key", F.xxhash64("text")).join(copies, ["doc_id", "text_key"], "left_anti").drop("text_key")
