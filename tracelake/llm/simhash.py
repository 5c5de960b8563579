"""SimHash near-duplicates by covering locality-sensitive hashing (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix64, unclashed, written
from .components import components

#: Fingerprints of a bucket that a task compares with each other; larger buckets are split by further masks.
BUCKET = 4096
#: Texts and shingles of a block; a task compares two blocks of a candidate group. Larger groups have more blocks.
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 1 << 19
#: Texts of a large group that each of its blocks meets before pairs of blocks do.
LEADERS = 8


def simhash(words: list[bytes], width: int) -> int:
    """A bit is set if it is in over half of the XXH64 values (seed 42) of the word shingles, repeats included."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[lo : lo + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def words_of(text: str | None) -> list[bytes]:
    """Words between white space (space, bytes 9 to 13), A to Z in lower case."""
    return (text or "").encode().lower().split()


def covering_masks(radius: int, seed: int) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits: each bit position has a random non-zero vector of radius+1 bits, and mask v
    keeps the positions whose vector has an odd product with v.

    Any `radius` positions span less than the whole space, so some v is orthogonal to all of them: that mask keeps none
    of the positions in which a pair within the radius differs, and the pair agrees under it.
    """
    dims = radius + 1
    draws = np.random.default_rng(seed).permutation(np.resize(np.arange(1, 1 << dims), 64)).tolist()
    return [sum(1 << i for i, d in enumerate(draws) if (d & v).bit_count() % 2) for v in range(1, 1 << dims)]


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of rows (family, mask, key, fp) sorted by these; rows of larger buckets come back as they are.

    A bucket of up to BUCKET fingerprints gives the links that join what is within the radius (a forest, not all pairs).
    Only one bucket is held, and of a larger one no more than BUCKET rows.
    """
    held: list[np.ndarray] = []
    at, n_held, large = None, 0, False

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(np.full(len(a), at[0], np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "family", "a", "b"])

    def ended() -> Iterator[pa.RecordBatch]:
        if n_held > 1 and not large:
            a, b = forest(np.concatenate(held), radius)
            if len(a):
                yield out(0, a, b)

    for batch in batches:
        mask, key, fp = (np.asarray(batch.column(c)).view(np.uint64) for c in ("mask", "key", "fp"))
        if not len(fp):
            continue
        family = np.asarray(batch.column("family"))
        new = np.flatnonzero((family[1:] != family[:-1]) | (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(fp)]])
        for first in (True, False):  # the bucket that goes on from the batch before; then those that aren't alone
            if first:
                spans = [(0, ends[0])]
                if at is not None and (family[0], mask[0], key[0]) != at:
                    yield from ended()
                    held, n_held, large = [], 0, False
                elif at is None:
                    held, n_held, large = [], 0, False
            else:
                keep = (ends - starts > 1) | (ends == len(fp))
                keep[0] = False
                spans = list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))
            for lo, hi in spans:
                if not first:
                    yield from ended()
                    held, n_held, large = [], 0, False
                at = (family[lo], mask[lo], key[lo])
                held.append(fp[lo:hi])
                n_held += hi - lo
                if large or n_held > BUCKET:
                    large, deep = True, np.concatenate(held)
                    held = []
                    yield out(1, np.full(len(deep), at[1]), deep)
    yield from ended()


def forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) of a forest over the pairs of distinct fingerprints within the radius."""
    fp = np.sort(fp)
    root = np.arange(len(fp))
    step = max(1, (1 << 20) // len(fp))
    for lo in range(0, len(fp), step):
        near = np.bitwise_count(fp[lo : lo + step, None] ^ fp[None, :]) <= radius
        for i, j in zip(*np.nonzero(near), strict=True):
            i += lo
            if j < i:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                while root[j] != j:
                    root[j] = j = root[root[j]]
                root[max(i, j)] = min(i, j)
    for i in range(len(root)):  # a root is smaller than what it holds
        root[i] = root[root[i]]
    own = np.flatnonzero(root != np.arange(len(root)))
    return fp[own], fp[root[own]]


def near_links(fps: DataFrame, radius: int = 3, seed: int = 1) -> DataFrame:
    """Links (family, a, b) between distinct fingerprints (columns family int, fp long) of one family whose closure is that
    of all pairs within the radius.

    Each round masks the fingerprints by all covering masks, so each pair within the radius meets in a bucket. Buckets
    above BUCKET go to the next round, where each is covered again on the bits that its mask left free; as fingerprints
    are distinct and each round about halves the free bits, no bucket is large after a few rounds. Rounds go on until
    none is; that they don't end can't happen, and would be an error.
    """
    rows, links, depth = fps.select("family", F.lit(0).cast("long").alias("mask"), "fp"), None, 0
    while True:
        masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius, seed + depth)]
        masked = rows.select("family", F.explode(F.array(*[F.col("mask").bitwiseOR(F.lit(m)) for m in masks])).alias("mask"), "fp")
        keyed = (masked.distinct() if depth else masked).withColumn("key", F.col("mask").bitwiseAND(F.col("fp"))).repartition("family", "mask", "key").sortWithinPartitions("family", "mask", "key")
        found = written(keyed.mapInArrow(lambda it: bucket_links(it, radius), "kind int, family int, a long, b long"), "links")
        own = found.filter("kind = 0").select("family", "a", "b")
        links = own if links is None else links.union(own)
        rows, depth = found.filter("kind = 1").select("family", F.col("a").alias("mask"), F.col("b").alias("fp")), depth + 1
        if rows.isEmpty():
            return links
        if depth == 64:
            raise RuntimeError("buckets of distinct fingerprints stay large")


def word_prints(words: list[bytes], prints: int) -> list[int]:
    """Independent fingerprints of the set of words; fingerprint k mixes k into each word's XXH64."""
    if not words:
        return [0] * prints
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in sorted(set(words))], np.uint64)
    return [majority(mix64(hashes, k)) for k in range(prints)]


def shingles_of(words: list[bytes], width: int) -> np.ndarray:
    """The set of XXH64 values of the word shingles; of the whole text where it is shorter, nothing without words."""
    if not words:
        return np.zeros(0, np.uint64)
    runs = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    return np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in runs], np.uint64))


def same_words(words: list[bytes]) -> int:
    """A digest of the words in order, as a signed long; zero without words."""
    x = xxhash.xxh64_intdigest(b" ".join(words), 42) if words else 0
    return x - (1 << 64) if x >> 63 else x


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the smallest index that pairs of at least this Jaccard similarity reach. All pairs count that share a member."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    label = np.arange(n)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    held, owner = np.unique(flat, return_inverse=True)[1], owner[order]
    count = np.bincount(held)
    first, off = np.cumsum(count) - count, np.concatenate([[0], np.cumsum(sizes)])
    for i in range(1, n):
        own = held[off[i] : off[i + 1]]
        own = own[count[own] > 1]
        if not len(own):
            continue
        per = count[own]
        at = np.repeat(first[own] - (np.cumsum(per) - per), per) + np.arange(per.sum())
        both = np.bincount(owner[at], minlength=n)[:i]
        near = (both > 0) & (both + 1e-9 >= similarity * (sizes[:i] + sizes[i] - both))
        roots = np.unique(np.append(label[:i][near], label[i]))
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    return label


def fingerprints(docs: DataFrame, width: int | None, prints: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, fp0, fp1, ..., node) of each row, as signed longs; null texts have no words and fingerprint 0. With a width there
    is one fingerprint, of the word shingles; without one there are `prints`, of the words. `t` is the text's hash, `node`
    the digest of the words in order."""
    names = [f"fp{k}" for k in range(prints)]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = list(map(words_of, batch.column("text").to_pylist()))
        rows = [[simhash(w, width)] if width else word_prints(w, prints) for w in words]
        fps = np.array(rows, np.uint64).reshape(len(rows), prints).view(np.int64)
        return pa.record_batch([batch.column("id"), batch.column("t"), *(pa.array(fps[:, k]) for k in range(prints)), pa.array([same_words(w) for w in words], pa.int64())], ["id", "t", *names, "node"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    return map_arrow(rows, each, f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in ['t', *names, 'node'])}")


def near_duplicates(docs: DataFrame, width: int | None = 3, radius: int = 3, prints: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of each row: SimHash of word shingles, and the smallest id that links of at most
    `radius` differing bits reach.

    With `width` None the fingerprints are of the words instead of shingles, and there are `prints` of them, each with
    its own bits: rows are linked if they are near in any. Edits change few words, but up to five of five-word shingles,
    so word fingerprints stay near for texts whose five-word shingles agree to 0.8 or more, and several of them miss few.

    Copies share a fingerprint, so masks, buckets and links work on distinct fingerprints; the ids are joined at the end
    (a join that Spark can split where a fingerprint is hot). Rows with no words have fingerprint zero and are linked
    like others. Repeated rows give a row each, an empty table none. Null ids are the smallest only where no other is.
    """
    prints = 1 if width else prints
    rows = written(fingerprints(docs, width, prints, id_col, text_col).drop("node", "t"), "fps")
    firsts = written(rows.groupBy("fp0").agg(F.min("id").alias("first")), "firsts")
    roots = written(components(print_links(rows, firsts, radius, prints)), "roots")
    rooted = firsts.join(roots, firsts["fp0"] == roots["node"], "left").select("fp0", "first", F.coalesce("root", "fp0").alias("root"))
    lowest = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")  # so that a hot root's rows can be split
    classes = written(rooted.join(lowest, "root").select("fp0", "component_id"), "classes")
    return rows.join(classes, "fp0", "left").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def print_links(rows: DataFrame, firsts: DataFrame, radius: int, prints: int) -> DataFrame:
    """Links between the values of fp0 whose rows are near in any fingerprint; firsts has each value of fp0 once."""
    if prints == 1:
        return near_links(firsts.select(F.lit(0).alias("family"), F.col("fp0").alias("fp")), radius).select("a", "b")
    # Equal fp0 are one node; a value of another fingerprint stands for its smallest node.
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.col(f"fp{k}").alias("fp")) for k in range(prints)]))
    pairs = written(rows.select("fp0", values.alias("v")).select("fp0", "v.family", "v.fp").distinct(), "prints")
    node = written(pairs.groupBy("family", "fp").agg(F.min("fp0").alias("node")), "nodes")
    found = near_links(node.select("family", "fp"), radius)
    ends = found.join(node.select("family", F.col("fp").alias("a"), F.col("node").alias("x")), ["family", "a"]).join(node.select("family", F.col("fp").alias("b"), F.col("node").alias("y")), ["family", "b"])
    return ends.select("x", "y").union(pairs.join(node, ["family", "fp"]).filter("fp0 <> node").select("fp0", "node")).toDF("a", "b")


def _verified(docs: DataFrame, similarity: float, width: int, prints: int, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, lowest): the fingerprints' rows, and for each node (digest of words) the row `low` (none, id, t) that stands for
    its class: the smallest id, a null one only where no other is; of one id the smallest hash of the text."""
    rows = written(fingerprints(docs, None, prints, id_col, text_col), "fps")
    firsts = written(rows.groupBy("fp0").agg(F.min("id").alias("first")), "firsts")
    near = written(components(print_links(rows, firsts, radius, prints)), "roots").select(F.col("node").alias("fp0"), F.col("root").alias("group"))
    own = F.struct(F.col("id").isNull().alias("none"), "id", "t")
    nodes = written(rows.groupBy("node").agg(F.min(own).alias("first"), F.first("fp0").alias("fp0")), "texts")
    grouped = written(nodes.join(near, "fp0", "left").select("node", "first", F.coalesce("group", "fp0").alias("group")), "groups")
    several = written(grouped.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1"), "several")
    suspects = grouped.join(several.select("group"), "group").select(F.col("first.id").alias("_id"), F.col("first.t").alias("_t"), "node", "group")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles = [shingles_of(words_of(x), width).view(np.int64) for x in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("node"), batch.column("group"), pa.array(map(len, shingles), pa.int64()), pa.array(shingles, pa.list_(pa.int64()))], ["node", "group", "size", "shingles"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    texts = texts.join(suspects, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).select("node", "group", "text")
    held = written(map_arrow(texts, sets, "node long, group long, size long, shingles array<long>").dropDuplicates(["node"]), "shingles")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    leaders = F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(LEADERS)]))
    groups = written(held.groupBy("group").agg(F.greatest(blocks, F.lit(1)).alias("blocks"), leaders.alias("leaders")), "blocks")
    dealt = held.join(groups, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)

    def verified(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        label = alike([np.asarray(x, np.int64).view(np.uint64) for x in t.column("shingles").to_numpy(zero_copy_only=False)], similarity)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": node[linked], "b": node[label[linked]]})

    # Each block with the group's leaders first: that links a class of near copies as a whole, with each text sent once.
    first = dealt.withColumn("i", F.explode(F.when(F.array_contains("leaders", F.col("node")), every).otherwise(F.array("own"))))
    links = written(first.select("group", "i", "node", "shingles").groupBy("group", "i").applyInArrow(verified, "a long, b long"), "verified")
    so_far = written(components(links), "roots").withColumnRenamed("root", "_root")
    apart = held.select("group", "node").join(so_far, "node", "left").groupBy("group").agg((F.min(F.coalesce("_root", "node")) < F.max(F.coalesce("_root", "node"))).alias("apart")).filter("apart")
    open_ = written(apart.join(groups.filter("blocks > 1"), "group").select("group"), "open")
    if not open_.isEmpty():  # what is left in several parts meets in all pairs of blocks
        rest = dealt.join(open_, "group").withColumn("other", F.explode(F.filter(every, lambda k: k != F.col("own"))))
        rest = rest.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles")
        links = links.union(written(rest.groupBy("group", "i", "j").applyInArrow(verified, "a long, b long"), "verified"))
    roots = written(components(links), "roots").withColumnRenamed("root", "_root")
    rooted = written(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("_root", "node").alias("root")), "rooted")
    lowest = written(rooted.groupBy("root").agg(F.min("first").alias("low")), "lowest")
    return rows, written(rooted.join(lowest, "root").select("node", "low"), "classes")


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, prints: int = 4, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of each row: the smallest id that links of texts reach whose sets of word shingles have a Jaccard
    similarity of `similarity` or more.

    The groups of near word fingerprints (see near_duplicates) are only candidates: every pair of texts inside such a
    group is compared by its shingles, and what agrees less is no link. Equal words are one node, so copies are compared
    once. A group above BLOCK_TEXTS or BLOCK_SHINGLES is dealt into blocks, each a task's group, and LEADERS of its
    texts meet all of them; that joins a class of near copies, however large, with each text sent once. Where a group is
    in several parts then, each pair of its blocks is compared, so no link is left out. Rows without words are copies of each other. Rows with
    null ids are compared like others; a class of null ids only has a null component_id.
    """
    rows, classes = _verified(docs, similarity, width, prints, radius, id_col, text_col)
    return rows.join(classes, "node", "left").select(F.col("id").alias(id_col), F.col("low.id").alias("component_id"))


def one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5, prints: int = 4, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near copies (see near_copies): one row of each class, that with the smallest id; a null id
    stays only where its class has no other, and of repeated rows one stays. All columns are kept."""
    rows, classes = _verified(docs, similarity, width, prints, radius, id_col, text_col)
    stay = classes.select(F.col("low.id").alias("id"), F.col("low.t").alias("t")).distinct()
    again = rows.groupBy("id", "t").agg(F.count("*").alias("n")).filter("n > 1")  # the same text under the same id
    of = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & F.col(f"{a}.t").eqNullSafe(F.col(f"{b}.t"))
    stay = written(stay.alias("s").join(again.alias("r"), of("s", "r"), "left").select("s.id", "s.t", F.col("n").isNotNull().alias("repeated")), "stay")
    id_, t, found = unclashed(docs, "_id"), unclashed(docs, "_t"), unclashed(docs, "_repeated")
    kept = docs.join(stay.toDF(id_, t, found), F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(t)))
    once = kept.filter(~F.col(found))
    if not stay.filter("repeated").isEmpty():
        once = once.union(kept.filter(F.col(found)).dropDuplicates([id_, t]))
    return once.select(*docs.columns)
