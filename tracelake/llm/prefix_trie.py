"""Prefix tries of conversations by truncation peeling (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes of a turn's digest; a path is the digests of a conversation's turns end to end.
WIDTH = 16
#: Turns that one task peels, about.
TURNS_A_TASK = 2_000_000
#: Open nodes whose ids are broadcast at most (40 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Stands for a null id in a task.
NO_ID = (1 << 63) - 1
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Nodes at the edge of a task's range, which other tasks may share, with the sums of what lies below them in this task alone.
PEELED = f"{NODE}, is_open boolean, key binary, parent_key binary, size long"


def turn_digest(role: Column, text: Column) -> Column:
    """WIDTH bytes that stand for a turn: SHA-256 of role and text, cut."""
    return F.substring(F.unhex(F.sha2(F.concat_ws("\n", F.octet_length(role).cast("string"), role, text), 256)), 1, WIDTH)


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): a row for each conversation with its turns in order (turn, null first; then role and digest), each as
    struct<digest, size> with the text's UTF-8 bytes. Null roles and texts are empty. Texts aren't shuffled."""
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = F.struct(F.col(turn).cast("long").alias("turn"), said(role).alias("role"), turn_digest(said(role), said(text)).alias("digest"), F.octet_length(said(text)).cast("long").alias("size"))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("turns"))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """(path, sizes, conv_id, n_convs, ends_sha256): a row for each distinct sequence of turns, with its smallest id, its
    number of conversations and SHA-256 of their ids. The ids of a group of copies pass one task in order, as their
    digest is made in order; nothing of the group is kept."""
    path, sizes = F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), ""), F.transform("turns", lambda x: x["size"])
    rows = convs.select("conv_id", F.unhex(path).alias("path"), sizes.alias("sizes")).withColumn("group", F.unhex(F.sha2("path", 256)))
    dealt = rows.repartition("group").sortWithinPartitions("group", F.asc_nulls_last("conv_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = head = sha = None
        out, kinds = [], (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())

        def closed() -> tuple:
            return (*head[:3], head[3], sha.hexdigest())

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], ["path", "sizes", "conv_id", "n_convs", "ends_sha256"])
            out.clear()
            return made

        for batch in batches:
            ids, groups = batch.column("conv_id").to_pylist(), batch.column("group").to_pylist()
            for i, (conv, group) in enumerate(zip(ids, groups, strict=True)):
                said = "" if conv is None else str(conv)
                if group == last:
                    head[3] += 1
                    sha.update(f",{said}".encode())
                    continue
                if head is not None:
                    out.append(closed())
                    if len(out) >= 1024:
                        yield flush()
                last, head, sha = group, [batch.column("path")[i].as_py(), batch.column("sizes")[i].as_py(), conv, 1], hashlib.sha256(said.encode())
        if head is not None:
            out.append(closed())
        if out:
            yield flush()

    return dealt.mapInArrow(run, "path binary, sizes array<bigint>, conv_id long, n_convs long, ends_sha256 string")


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their front."""
    if a[:WIDTH] != b[:WIDTH]:
        return 0
    n = min(len(a), len(b)) // WIDTH * WIDTH
    x, y = np.frombuffer(a, np.uint8, n).reshape(-1, WIDTH), np.frombuffer(b, np.uint8, n).reshape(-1, WIDTH)
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n // WIDTH


def _keys(path: bytes) -> list[bytes]:
    """A digest for each prefix of a path, from the root's on."""
    chain = hashlib.sha256()
    out = [chain.digest()[:WIDTH]]
    for lo in range(0, len(path), WIDTH):
        chain.update(path[lo : lo + WIDTH])
        out.append(chain.copy().digest()[:WIDTH])
    return out


def peel(paths: list[bytes], sizes: list[list[int]], ids: np.ndarray, counts: np.ndarray, ends: list[str]) -> Iterator[pa.RecordBatch]:
    """The nodes of distinct paths in ascending order, from the deepest up: at each depth the paths that end there join the
    nodes left of the depth below, the last turn goes, and neighbours with equal rests become one node with their sums.
    A node's row goes out at the depth above it, where its parent is known.

    Nodes on the first and the last path are open: other tasks may hold more of them. They count in no sums but those
    of members and least ids; open_nodes() does the rest."""
    n, count = len(paths), lambda k: np.zeros(k, np.int64)
    length = np.array([len(p) // WIDTH for p in paths])
    shared = np.array([*map(_shared, paths, paths[1:]), -1])
    edges = _keys(paths[0]), _keys(paths[-1])
    to_first = np.minimum.accumulate(np.concatenate([length[:1], shared[:-1]]))
    to_last = np.minimum.accumulate(np.concatenate([shared[:-1], length[-1:]])[::-1])[::-1]
    flat, start = np.fromiter((x for s in sizes for x in s), np.int64), np.cumsum(length) - length
    ended, at = np.argsort(-length, kind="stable"), 0
    # Left of the depth below: first and last path, members and least id, what it adds to its parent, its rows.
    first, last, members, least, kids, leaves, saved, rows = *[count(0)] * 7, None
    for depth in range(int(length.max()), -1, -1):
        stop = int(np.searchsorted(-length[ended], -depth, "right"))
        new, at = np.sort(ended[at:stop]), stop
        order = np.argsort(np.concatenate([first, new]), kind="stable")
        join = lambda old, own: np.concatenate([old, own])[order]
        first, last, is_new = join(first, new), join(last, new), join(count(len(first)), count(len(new)) + 1) > 0
        begins = np.concatenate([[True], (first[1:] != last[:-1] + 1) | (shared[last[:-1]] < depth)])
        begin, node = np.flatnonzero(begins), np.cumsum(begins) - 1
        total = lambda old: np.add.reduceat(join(old, count(len(new))), begin)
        members, least = np.add.reduceat(join(members, counts[new]), begin), np.minimum.reduceat(join(least, ids[new]), begin)
        kids, leaves, saved = total(kids), total(leaves), total(saved)
        ender = count(len(begin)) - 1
        ender[node[is_new]] = first[is_new]
        first, last = first[begin], last[np.concatenate([begin[1:], [len(last)]]) - 1]
        on_first, on_last = to_first[first] >= depth, to_last[last] >= depth
        is_open = on_first | on_last
        key = [edges[0][depth] if a else edges[1][depth] if b else None for a, b in zip(on_first.tolist(), on_last.tolist(), strict=True)]
        if rows is not None:
            yield _batch(rows, node[~is_new], least, is_open, key)
        size = flat[start[first] + depth - 1] if depth else count(len(first))
        leaves = np.where(~is_open & (kids == 0), 1, leaves)
        saved = saved + np.where(is_open, 0, (members - 1) * size)
        rows = [count(len(first)) + depth, least, members, kids, leaves, saved, [ends[i] if i >= 0 else NOTHING for i in ender.tolist()], is_open, key, size]
        kids, leaves, saved = (~is_open).astype(np.int64), np.where(is_open, 0, leaves), np.where(is_open, 0, saved)
    yield _batch(rows, count(len(first)), least, is_open, [None] * len(first), root=True)


def _batch(rows: list, parent: np.ndarray, least: np.ndarray, is_open: np.ndarray, key: list, root: bool = False) -> pa.RecordBatch:
    """PEELED rows of one depth; `parent` is each node's place in the depth above. An open parent is told by its key only."""
    depth, conv, members, kids, leaves, saved, ends, own_open, own_key, size = rows
    ids = lambda x, gone: pa.array(x, pa.int64(), mask=(x == NO_ID) | gone)
    columns = [pa.array(depth), ids(conv, False), ids(least[parent], root | is_open[parent]), *map(pa.array, (members, kids, leaves, saved)), pa.array(ends, pa.string())]
    columns += [pa.array(own_open), pa.array(own_key, pa.binary()), pa.array([key[i] for i in parent.tolist()], pa.binary()), pa.array(size)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PEELED.split(", ")])


def _peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches([*batches]) if (batches := [*batches]) else None
    if rows is not None and len(rows):
        ids = rows.column("conv_id").fill_null(NO_ID).to_numpy()
        yield from peel(rows.column("path").to_pylist(), rows.column("sizes").to_pylist(), ids, rows.column("n_convs").to_numpy(), rows.column("ends_sha256").to_pylist())


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """open_nodes: sums of the tree of open nodes, from the deepest up."""
    rows = pa.Table.from_batches(batches).to_pylist() if (batches := [*batches]) else []
    by_key = {r["key"]: r for r in rows}
    for r in sorted(rows, key=lambda r: -r["depth"]):
        r["n_leaves"] = r["n_leaves"] if r["n_children"] else 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["size"]
        if (up := by_key.get(r["parent_key"])) is not None:
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
            r["parent_conv_id"] = up["conv_id"]
    schema = pa.schema([("key", pa.binary()), *[(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in (x.split()[0] for x in NODE.split(", "))]])
    for lo in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_pylist([{c: r[c] for c in schema.names} for r in rows[lo : lo + 4096]], schema)


def prefix_trie(convs: DataFrame, turns_a_task: int = TURNS_A_TASK) -> DataFrame:
    """Nodes of the trie of all conversations (conv_id, turns: array of struct<digest, size>): for each distinct sequence of
    first turns its smallest conv_id, depth, parent's conv_id, numbers of conversations, children and leaves below,
    saved_tokens (over the nodes from it down: members but one, times the size of their last turn), and ends_sha256 of
    the ids that end there.

    Copies of a whole conversation count as one path with a number. Paths are dealt out in ranges of their order, so a
    popular front spreads over many tasks; each peels its range at all depths. Nodes that two tasks may share lie on the
    first and last path of a range: these alone meet in one task, at most two paths for each range. A conversation is a
    row of 24 bytes a turn.

    A conversation without turns ends at the root. A null id is a conversation that counts after all others, with an
    empty decimal. No conversations: no nodes, not even a root. Equal ids in several rows count once each.
    """
    paths = written(distinct_paths(convs), "paths")
    turns = paths.agg(F.sum(F.size("sizes"))).first()[0] or 0
    dealt = paths.repartitionByRange(1 + turns // turns_a_task, "path").sortWithinPartitions("path")
    peeled = written(dealt.mapInArrow(_peeled, PEELED), "peeled")
    names = [x.split()[0] for x in NODE.split(", ")]
    shared = peeled.filter("is_open").groupBy("key").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NOTHING, F.col("ends_sha256"))), F.lit(NOTHING)).alias("ends_sha256"), F.first("parent_key").alias("parent_key"), F.first("size").alias("size"),
    )
    met = written(shared.coalesce(1).mapInArrow(_meet, f"key binary, {NODE}"), "open")
    closed = peeled.filter("NOT is_open")
    above = met.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    side = F.broadcast(above) if above.count() <= BROADCAST_NODES else above
    under = closed.filter("parent_key IS NOT NULL").join(side, "parent_key", "left").withColumn("parent_conv_id", F.col("above"))
    return closed.filter("parent_key IS NULL").select(names).union(under.select(names)).union(met.select(names))


def rebuilt(convs: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """convs with other fronts: of each id c the first h turns of c - c % family, then its own turns after its first h; h is
    crc32 of c's decimal modulo `most`. A null id keeps its turns."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    fronts = convs.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_front"))
    rows = convs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % family).withColumn("_h", F.coalesce(h, F.lit(0)).cast("int")).join(fronts, "_base", "left")
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    none = F.slice("turns", 1, 0)
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("_front", F.lit(1), F.col("_h")), none), own).alias("turns"))
