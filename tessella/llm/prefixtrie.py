"""Trie of conversation prefixes: LOUDS shards built in tasks, heavy upper levels merged apart.

1. A turn is known by 128 bits of SHA-256 of its role and text.  Turns are sorted by range of
   (conversation, turn) and numbered by running sums over partitions, so no conversation, however
   long, is one task's group; in the same way each turn gets the key of the prefix that ends with
   it, the exclusive or of the position-salted turns up to it.  A node is such a key.
2. Nodes come from partial sums by key: copies of a conversation are gone before the shuffle.
   One conversation for each distinct sequence (that with the smallest id) stands for its copies.
3. A node under which more than `shard_nodes` turns of distinct sequences lie is heavy, and so are
   all above it; the subtrees below are the prefix shards.  A task takes whole shards, lays their
   nodes out in level order as a LOUDS bitvector with label arrays, and rolls sums up over it
   with np.add.at from the last level to the first.
4. Sums of shard tops are added to their heavy parents, and heavy nodes are rolled up by pointer
   doubling: as many joins as the heavy depth has binary digits, of heavy nodes alone.
5. The ids that end at a node are joined in stretches of sorted ranges and hashed as a stream.

Different prefixes have one key with probability 2^-128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import Workspace, near, pick, table
from .minhash import whole_groups

#: Turns of distinct sequences below a node that one shard may hold; bytes of ids hashed at a time.
SHARD_NODES, STRETCH_IDS = 200_000, 20_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------ LOUDS


class Louds:
    """A forest in level order: for each node as many ones as it has children and a zero, after those of a super-root.

    Nodes are numbered from 0 in level order.  `label` holds two 64-bit halves of each node's turn.
    """

    def __init__(self, bits: np.ndarray, label: np.ndarray):
        self.bits, self.label = bits.astype(bool), label
        self.ones = np.flatnonzero(self.bits)
        self.zeros = np.flatnonzero(~self.bits)

    @classmethod
    def build(cls, depth: np.ndarray, key: np.ndarray, up: np.ndarray, label: np.ndarray) -> tuple[Louds, np.ndarray]:
        """From rows (keys and parents' keys as numbers from 0 on; a parent outside is -1): the trie, and the row of each node."""
        n = len(depth)
        row_of = np.full(int(key.max(initial=-1)) + 1, -1, dtype=np.int64)
        row_of[key] = np.arange(n)
        parent_row = np.where(up >= 0, row_of[np.maximum(up, 0)], -1)
        by_depth = np.argsort(depth, kind="stable")
        levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if n else []
        number = np.full(n + 1, -1, dtype=np.int64)  # the last stands for the super-root
        order, done = [], 0
        for level in levels:
            p = number[parent_row[level]]
            level = level[np.lexsort((label[level, 1], label[level, 0], p))]
            number[level] = done + np.arange(len(level))
            done += len(level)
            order.append(level)
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        # Forests whose tops lie at different depths: ordered anew so that parents never fall.
        parent = number[parent_row[order]]
        while (np.diff(parent) < 0).any():
            again = np.argsort(parent, kind="stable")
            renumber = np.empty(n, dtype=np.int64)
            renumber[again] = np.arange(n)
            order, parent = order[again], np.where(parent[again] >= 0, renumber[parent[again]], -1)
        children = np.bincount(parent + 1, minlength=n + 1)
        bits = np.zeros(2 * n + 1, dtype=bool)
        bits[np.arange(n) + np.repeat(np.arange(n + 1), children)] = True
        return cls(bits, label[order]), order

    def __len__(self) -> int:
        return len(self.label)

    def parents(self) -> np.ndarray:
        """Parent of each node, -1 for tops: zeros before a node's one, less the super-root's."""
        return self.ones - np.arange(len(self)) - 1

    def n_children(self) -> np.ndarray:
        return np.diff(self.zeros) - 1

    def children(self, node: int) -> range:
        """Numbers of a node's children (-1: of the super-root)."""
        lo = 0 if node < 0 else int(self.zeros[node]) + 1
        first = lo - node - 1
        return range(first, first + int(self.zeros[node + 1]) - lo)

    def find(self, path: np.ndarray) -> int:
        """The node that a sequence of labels leads to, -1 where there is none (or the path is empty)."""
        node = -1
        for a, b in path:
            kids = self.children(node)
            rows = self.label[kids.start : kids.stop]
            at = np.flatnonzero((rows[:, 0] == a) & (rows[:, 1] == b))
            if not len(at):
                return -1
            node = kids.start + int(at[0])
        return node

    def roll_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, tops included, level by level from the last."""
        total = values.astype(np.int64).copy()
        parent = self.parents()
        # A level is the children of the one before.
        edges, hi = [0], int(np.searchsorted(parent, 0))
        while hi < len(parent):
            edges.append(hi)
            hi = int(np.searchsorted(parent, hi))
        for lo, to in zip(edges[:0:-1], [len(parent), *edges[:0:-1]], strict=False):
            np.add.at(total, parent[lo:to], total[lo:to])
        return total


# ------------------------------------------------------------------ running sums over ranges


_POSITION = np.uint64(0xD6E8FEB86659FD93)


def _halves(column: pa.Array) -> np.ndarray:
    """16-byte binary values as rows of two numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 2)


def _number_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, label, size) -> part, number of the row within its conversation and part."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch["conv"].to_numpy()
        new = np.append(True, conv[1:] != conv[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        at = np.arange(len(conv)) - start + 1
        if last is not None and conv[0] == last:
            at[start == 0] += n
        last, n = conv[-1], at[-1]
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["label"], batch["size"], pa.array(np.full(len(conv), part)), pa.array(at)], names=["conv", "label", "size", "part", "n"])


def _prefix_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, depth, label, size) -> own and running keys (exclusive or within conversation and part)."""
    part, last, held = TaskContext.get().partitionId(), None, np.zeros(2, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch["conv"].to_numpy()
        label, salt = _halves(batch["label"]), tk.mix(batch["depth"].to_numpy().astype(np.uint64) * _POSITION)
        own = np.stack([tk.key_hash(label[:, 0] ^ salt, label[:, 1], s) for s in (0, 1)], axis=1)
        new = np.append(True, conv[1:] != conv[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        run = np.bitwise_xor.accumulate(own, axis=0)
        run ^= np.concatenate([np.zeros((1, 2), np.uint64), run])[start]
        if last is not None and conv[0] == last:
            run[start == 0] ^= held
        last, held = conv[-1], run[-1].copy()
        longs = [pa.array(x.view(np.int64)) for x in (np.ascontiguousarray(own[:, 0]), np.ascontiguousarray(own[:, 1]), np.ascontiguousarray(run[:, 0]), np.ascontiguousarray(run[:, 1]))]
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["depth"], batch["label"], batch["size"], pa.array(np.full(len(conv), part)), *longs], names=["conv", "depth", "label", "size", "part", "o1", "o2", "k1", "k2"])


def _carried(ws: Workspace, rows: DataFrame, name: str, *totals: Column) -> DataFrame:
    """What the parts before hold of a conversation that several parts share: (conv, part, totals).

    Ranges are cut at most once between two parts, so these are no more rows than twice the parts.
    """
    names = [f"t{i}" for i in range(len(totals))]
    per = rows.groupBy("conv", "part").agg(*[t.alias(n) for t, n in zip(totals, names, strict=True)])
    over = Window.partitionBy("conv")
    per = ws.save(per.withColumn("parts", F.count(F.lit(1)).over(over)).where("parts > 1").drop("parts"), f"{name}_parts")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ops = [F.sum(n).over(earlier) if n == "t0" and len(names) == 1 else F.expr(f"bit_xor({n})").over(earlier) for n in names]
    return ws.save(per.select("conv", "part", *[F.coalesce(o, F.lit(0)).alias(n) for o, n in zip(ops, names, strict=True)]), name)


def label_of(role: str | Column, text: str | Column) -> Column:
    """16 bytes that stand for a turn."""
    role, text = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (role, text))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def numbered_turns(ws: Workspace, conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv, pos from 1, label, size (code points), ordered by turn (null first), ties by label.

    Rows without a conv_id are in no conversation.
    """
    turns = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    turns = turns.select(F.col("conv_id").cast("long").alias("conv"), "turn", label_of("role", "text").alias("label"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    order = ["conv", F.col("turn").asc_nulls_first(), "label"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ws.save(ranged.select("conv", "label", "size").mapInArrow(_number_local, "conv long, label binary, size long, part long, n long"), "turns")
    before = _carried(ws, rows, "turns_before", F.max("n"))
    joined = rows.join(near(before), ["conv", "part"], "left")
    return joined.select("conv", (F.col("n") + F.coalesce("t0", F.lit(0))).alias("pos"), "label", "size")


def prefix_keys(ws: Workspace, steps: DataFrame) -> DataFrame:
    """(conv, depth, label, size) -> with k1, k2 (key of the prefix up to here) and p1, p2 (up to the turn before)."""
    order = ["conv", "depth"]
    ranged = steps.select("conv", "depth", "label", "size").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ws.save(ranged.mapInArrow(_prefix_local, "conv long, depth long, label binary, size long, part long, o1 long, o2 long, k1 long, k2 long"), "prefixes")
    before = _carried(ws, rows, "prefixes_before", F.expr("bit_xor(o1)"), F.expr("bit_xor(o2)"))
    joined = rows.join(near(before), ["conv", "part"], "left")
    k = {f"k{i + 1}": F.col(f"k{i + 1}").bitwiseXOR(F.coalesce(f"t{i}", F.lit(0))) for i in range(2)}
    return joined.select("conv", "depth", "label", "size", *[c.alias(n) for n, c in k.items()], *[c.bitwiseXOR(F.col(f"o{n[1]}")).alias(f"p{n[1]}") for n, c in k.items()])


# ------------------------------------------------------------------ shards


_NODE = [("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("label", pa.binary())]
_ROLLED = pa.schema(_NODE + [("parent_conv_id", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("top", pa.bool_())])
ROLLED = "k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, n_convs long, label binary, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, top boolean"


def _trie_of(t: pa.Table) -> tuple[Louds, np.ndarray]:
    n = t.num_rows
    both = [np.concatenate([t[f"k{i}"].to_numpy(), t[f"p{i}"].to_numpy()]).view(np.uint64) for i in (1, 2)]
    number, _ = tk.numbers(*both)
    known = np.zeros(number.max(initial=-1) + 1, dtype=bool)
    known[number[:n]] = True
    return Louds.build(t["depth"].to_numpy(), number[:n], np.where(known[number[n:]], number[n:], -1), _halves(t["label"]))


def _roll_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, "shard", 16 << 20):
        t = t.combine_chunks()
        trie, order = _trie_of(t)
        parent, children = trie.parents(), trie.n_children()
        row = pa.array(order)
        conv, saved = t["conv_id"].to_numpy()[order], ((t["n_convs"].to_numpy() - 1) * t["size"].to_numpy())[order]
        up = pa.array(np.where(parent >= 0, conv[np.maximum(parent, 0)], 0), mask=parent < 0)
        cols = [t[name].combine_chunks().take(row) for name, _ in _NODE]
        yield pa.RecordBatch.from_arrays([*cols, up, pa.array(children), pa.array(trie.roll_up(children == 0)), pa.array(trie.roll_up(saved)), pa.array(parent < 0)], schema=_ROLLED)


_SHARD = pa.schema([("shard", pa.int64()), ("n_nodes", pa.int64()), ("louds", pa.binary()), ("labels", pa.binary()), ("conv_ids", pa.list_(pa.int64()))])


def _store_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in whole_groups(batches, "shard", 1):
        whole = whole.combine_chunks()
        shard = whole["shard"].to_numpy()
        for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))), strict=True):
            t = whole.slice(lo, hi - lo).combine_chunks()
            trie, order = _trie_of(t)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([shard[lo]], [len(trie)], [np.packbits(trie.bits).tobytes()], [trie.label.astype("<u8").tobytes()], [t["conv_id"].to_numpy()[order]]), _SHARD, strict=True)], schema=_SHARD)


def load_shard(louds: bytes, labels: bytes, n_nodes: int) -> Louds:
    """A trie as `shards` stores it."""
    bits = np.unpackbits(np.frombuffer(louds, np.uint8))[: 2 * n_nodes + 1]
    return Louds(bits, np.frombuffer(labels, dtype="<u8").reshape(-1, 2))


def _hash_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (k1, k2, conv) -> stretches of comma-joined ids of one node, numbered."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        k1, k2, conv = (batch[x].to_numpy() for x in ("k1", "k2", "conv"))
        cut = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])) if len(k1) else np.zeros(0, np.int64)
        edges = np.unique(np.concatenate([cut, np.arange(0, len(k1), STRETCH_IDS)])).astype(np.int64)
        body = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(edges, np.append(edges[1:], len(k1)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(k1[edges]), pa.array(k2[edges]), pa.array(np.full(len(edges), part)), pa.array(seq + np.arange(len(edges))), pa.array(body, pa.string())], names=["k1", "k2", "part", "seq", "body"])
        seq += len(edges)


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches -> the digest of each node's ids; only the running digest is held."""
    key, sha = None, None
    for batch in batches:
        out: list[tuple] = []
        for k1, k2, body in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["body"].to_pylist(), strict=True):
            if (k1, k2) == key:
                sha.update(b"," + body.encode())
                continue
            if key:
                out.append((*key, sha.hexdigest()))
            key, sha = (k1, k2), hashlib.sha256(body.encode())
        yield _hashed(out)
    if key:
        yield _hashed([(*key, sha.hexdigest())])


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["k1", "k2", "ends_sha256"])


def _ends_sha(ends: DataFrame) -> DataFrame:
    order = ["k1", "k2", "conv"]
    stretches = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_hash_stretches, "k1 long, k2 long, part long, seq long, body string")
    return stretches.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part", "seq").mapInArrow(_hash_streams, "k1 long, k2 long, ends_sha256 string")


def _roll_heavy(ws: Workspace, heavy: DataFrame) -> DataFrame:
    """Heavy nodes (k1, k2, p1, p2, depth, leaves, saved) -> k1, k2 and sums over their subtrees, by pointer doubling.

    After round r a node has the sum of all below it within 2^r levels and points 2^r levels up.
    """
    at = ws.save(heavy.select("k1", "k2", F.when(F.col("depth") > 0, F.col("p1")).alias("u1"), F.when(F.col("depth") > 0, F.col("p2")).alias("u2"), "leaves", "saved"), "up0")
    deepest = heavy.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    for r in range(1, int(deepest).bit_length() + 1):
        below = at.where("u1 is not null").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.sum("leaves").alias("x"), F.sum("saved").alias("y"))
        above = at.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        step = at.join(below, ["k1", "k2"], "left").join(above, ["u1", "u2"], "left")
        new = step.select("k1", "k2", F.col("v1").alias("u1"), F.col("v2").alias("u2"), (F.col("leaves") + F.coalesce("x", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("y", F.lit(0))).alias("saved"))
        at = ws.save(new, f"up{r}")
        ws.drop(f"up{r - 1}")
    return at.select("k1", "k2", "leaves", "saved")


def _light_nodes(ws: Workspace, steps: DataFrame, convs: DataFrame, shard_nodes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Light nodes with their shard, heavy nodes (the root among them), and each conversation's end (conv, k1, k2)."""
    last = steps.groupBy("conv").agg(F.max_by(F.struct("k1", "k2", "depth"), "depth").alias("e"))
    ends = convs.select("conv").join(last, "conv", "left")
    ends = ws.save(ends.select("conv", *[F.coalesce(f"e.{x}", F.lit(0)).alias(x) for x in ("k1", "k2")], F.coalesce("e.depth", F.lit(0)).alias("len")), "ends")
    # One conversation stands for its copies: the smallest id.
    reps = ws.save(ends.where("len > 0").groupBy("k1", "k2").agg(F.min(F.struct("conv", "len")).alias("r")).select("r.conv", "r.len"), "reps")
    own = ws.save(steps.join(reps, "conv").select("conv", "len", "depth", "k1", "k2"), "own")
    weight = own.groupBy("k1", "k2").agg(F.sum(F.col("len") - F.col("depth") + 1).alias("weight"))
    nodes = steps.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.min(F.struct("depth", "p1", "p2", "size", "label")).alias("s"))
    nodes = nodes.join(weight, ["k1", "k2"]).select("k1", "k2", "n_convs", "conv_id", "s.*", (F.col("weight") > shard_nodes).alias("heavy"))
    nodes = ws.save(nodes, "nodes")
    root = ends.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("k1"), zero.alias("k2"), "n_convs", "conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("size"), F.unhex(F.lit("00" * 16)).alias("label"))
    heavy = ws.save(nodes.where("heavy").drop("heavy").unionByName(root), "heavy")
    # The heavy nodes of a path are its first ones; the next one is the top of its shard.
    above = own.join(near(heavy.select("k1", "k2")), ["k1", "k2"]).groupBy("conv").agg(F.max("depth").alias("d"))
    tops = own.join(above, "conv", "left").where(F.col("depth") == F.coalesce("d", F.lit(0)) + 1).select(F.col("conv").alias("conv_id"), F.col("k1").alias("shard"))
    light = nodes.where("not heavy").drop("heavy").join(ws.save(tops, "tops"), "conv_id")
    return light, heavy, ends


def _build(ws: Workspace, steps: DataFrame, convs: DataFrame, shard_nodes: int) -> DataFrame:
    light, heavy, ends = _light_nodes(ws, steps, convs, shard_nodes)
    rolled = ws.save(light.repartition("shard").sortWithinPartitions("shard").mapInArrow(tk.releasing(_roll_shards), ROLLED), "rolled")
    tops = rolled.where("top")
    nil = F.lit(0).cast("long")
    kids = tops.select("p1", "p2", "n_leaves", "saved_tokens").unionByName(heavy.where("depth > 0").select("p1", "p2", nil.alias("n_leaves"), nil.alias("saved_tokens")))
    kids = kids.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    # A root without turns below it is itself childless.
    heavy = heavy.join(kids, ["k1", "k2"], "left").select(
        heavy["*"], F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("leaves", F.lit(1)).alias("leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    heavy = ws.save(heavy, "heavy_own")
    up = heavy.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up_id"))
    sums = ws.save(_roll_heavy(ws, heavy), "heavy_sums")
    high = heavy.drop("leaves", "saved").join(sums, ["k1", "k2"]).select("k1", "k2", "p1", "p2", "depth", "conv_id", "n_convs", "label", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    # Parents of heavy nodes and of shard tops are heavy.
    high = high.unionByName(tops.drop("parent_conv_id", "top")).join(near(up), ["p1", "p2"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("up_id"))).drop("up_id")
    nodes = high.unionByName(rolled.where("not top").drop("top"))
    done = ws.save(_ends_sha(ends), "ends_sha")
    return nodes.join(done, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))


def prefix_trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(conv_id, turn, role, text) -> one row for each distinct prefix: label (16 bytes of its last turn) and the columns of op11.

    Turns are ordered by `turn` (null first), ties by label; null roles and texts are empty ones.
    Rows without a conv_id are in no conversation.  Repeated rows are turns of their own.  Texts
    of any length are known by their digests.  An empty table has no node, not even the root.
    Extra columns are ignored, whatever their names.
    """
    with Workspace(conversations.sparkSession, "trie") as ws:
        turns = ws.save(numbered_turns(ws, conversations).withColumnRenamed("pos", "depth"), "numbered")
        return _finish(ws, turns, turns.where("depth = 1"), shard_nodes)


def _finish(ws: Workspace, turns: DataFrame, convs: DataFrame, shard_nodes: int) -> DataFrame:
    steps = ws.save(prefix_keys(ws, turns), "steps")
    nodes = _build(ws, steps, convs, shard_nodes)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "label").checkpoint()


def shards(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The prefix shards themselves: shard, n_nodes, LOUDS bits, labels and smallest members in level order (`load_shard`)."""
    with Workspace(conversations.sparkSession, "trie") as ws:
        turns = ws.save(numbered_turns(ws, conversations).withColumnRenamed("pos", "depth"), "numbered")
        steps = ws.save(prefix_keys(ws, turns), "steps")
        light, _, _ = _light_nodes(ws, steps, turns.where("depth = 1"), shard_nodes)
        return light.repartition("shard").sortWithinPartitions("shard").mapInArrow(tk.releasing(_store_shards), "shard long, n_nodes long, louds binary, labels binary, conv_ids array<long>").checkpoint()


# ------------------------------------------------------------------ the query


def rebuilt_turns(ws: Workspace, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's rebuilt conversations: (conv, depth, label, size), and all of them (conv), turnless ones too."""
    turns = ws.save(numbered_turns(ws, conversations), "numbered")
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).alias("h")
    convs = turns.where("pos = 1").select("conv", (F.col("conv") - F.col("conv") % 100).alias("base"), head)
    lent = ws.save(turns.where("pos <= 5 and conv % 100 = 0").select(F.col("conv").alias("base"), "pos", "label", "size"), "lent")
    borrowed = convs.join(lent, "base").where("pos <= h").select("conv", F.col("pos").alias("depth"), "label", "size")
    has = near(lent.groupBy("base").agg(F.max("pos").alias("m")))
    own = turns.select("*", head, (F.col("conv") - F.col("conv") % 100).alias("base")).where("pos > h").join(has, "base", "left")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("m", F.lit(0)))).alias("depth"), "label", "size")
    return borrowed.unionByName(own), convs


def op11_prefix_trie(spark: SparkSession, sf_dir: str, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Nodes of the trie of the rebuilt `conversations`.  See `prefix_trie` for nulls, ties, repeated rows and empty tables."""
    with Workspace(spark, "trie") as ws:
        turns, convs = rebuilt_turns(ws, table(spark, sf_dir, "conversations"))
        return _finish(ws, turns, convs, shard_nodes).drop("label")


#: crc32 bit by bit over the decimal id; prefixes are lists of turns.
OP11_SQL = f"""
WITH bits AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
seqs AS (SELECT conv_id, list((role, text) ORDER BY pos) AS s FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, s, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 6 AS h FROM seqs, bits),
rebuilt AS (
  SELECT a.conv_id, coalesce(b.s[1:a.h], []) || a.s[a.h + 1:] AS s FROM heads a LEFT JOIN seqs b ON b.conv_id = a.conv_id - a.conv_id % 100),
steps AS (SELECT conv_id, len(s) AS n, unnest(range(0, len(s) + 1)) AS depth, s FROM rebuilt),
nodes AS (
  SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM steps GROUP BY ALL),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.p[n.depth][2]) END AS saved
  FROM nodes n LEFT JOIN kids k ON n.p = k.p),
up AS (SELECT unnest(range(0, depth + 1)) AS a, p, saved, n_children FROM own),
sums AS (SELECT p[1:a] AS p, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY ALL)
SELECT o.conv_id, o.depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM own o JOIN sums s ON o.p = s.p LEFT JOIN nodes u ON u.depth = o.depth - 1 AND u.p = o.p[1:o.depth - 1] AND o.depth > 0
"""
