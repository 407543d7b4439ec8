"""The prefix trie of conversations by truncation peeling."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaweave.llm.texts import LAST_ID, mixed
from qaweave.session import stored

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROOT = np.array([1, 2], np.uint64)
_RUN_BITS = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

#: What a range reports of a node. `k*` and `p*` name the node and its parent; nodes on the
#: border of a range are open: their sums leave out their open children.
_NODE = pa.schema([
    ("open", pa.bool_()), ("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()),
    ("size", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())])
_DDL = ("open boolean, depth long, k1 long, k2 long, p1 long, p2 long, size long, n_convs long, conv_id long, parent_conv_id long, "
        "n_children long, n_leaves long, saved long, ends string")


def turn_lists(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """conv_id, path, sizes: the turns of each conversation in order, a turn as 128 bits of
    its SHA-256 and the code points of its text, so that no text is moved.

    A missing turn number comes first; equal ones are ordered by their hash. A missing role
    or text is empty. Rows without a conv_id belong to no conversation. Repeated rows are
    repeated turns. A conversation's hashes (40 bytes a turn) must fit in a task.
    """
    role, text = F.coalesce(conversations[role_col], F.lit("")), F.coalesce(conversations[text_col], F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = conversations.filter(conversations[conv_col].isNotNull()).select(
        conversations[conv_col].cast("long").alias("conv_id"),
        F.struct(conversations[turn_col].alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.col("t.digest").alias("path"), F.col("t.size").alias("sizes"))


def rebuilt(lists: DataFrame, head_of: Column, head_turns: Column, most: int) -> DataFrame:
    """`lists` with each conversation's first `head_turns` turns (at most `most`) taken from
    the conversation with the id `head_of` (none if there is none), its own behind them."""
    all_ = stored(lists, "turn-lists")
    heads = all_.join(all_.select(head_of.alias("h_id")).distinct(), F.col("conv_id") == F.col("h_id"), "left_semi").select(
        F.col("conv_id").alias("h_id"), F.slice("path", 1, most).alias("h_path"), F.slice("sizes", 1, most).alias("h_sizes"))
    joined = all_.withColumns({"of": head_of, "h": head_turns.cast("int")}).join(heads, F.col("of") == F.col("h_id"), "left")

    def spliced(own: str, head: str, kind: str) -> Column:
        first = F.slice(F.coalesce(F.col(head), F.array().cast(f"array<{kind}>")), F.lit(1), F.col("h"))
        return F.concat(first, F.slice(F.col(own), F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))).alias(own)

    return joined.select("conv_id", spliced("path", "h_path", "string"), spliced("sizes", "h_sizes", "bigint"))


def distinct_paths(lists: DataFrame) -> DataFrame:
    """path, sizes, n_convs, conv_id (the smallest) and ends (SHA-256 of the ids) of each
    distinct conversation. Ids are written in runs of 65,536 numbers each, so that a
    conversation that a third of all ids share is gathered by many tasks; the last one only
    hashes the runs in their order, one at a time."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    runs = lists.groupBy(F.sha2(F.array_join("path", ""), 256).alias("key"), F.shiftright("conv_id", _RUN_BITS).alias("run")).agg(
        F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("lo"), ids.alias("ids"))

    def fold(batches):
        open_ = None

        def closed(o):
            return [o["path"], o["sizes"], o["n"], o["lo"], o["sha"].hexdigest()]

        for batch in batches:
            out = []
            keys, ids_, n, lo = (batch.column(c).to_pylist() for c in ("key", "ids", "n", "lo"))
            path, sizes = batch.column("path"), batch.column("sizes")
            for i, key in enumerate(keys):
                if open_ and open_["key"] == key:
                    open_["sha"].update(b"," + ids_[i].encode())
                    open_["n"] += n[i]
                else:
                    if open_:
                        out.append(closed(open_))
                    open_ = {"key": key, "path": path[i].as_py(), "sizes": sizes[i].as_py(), "n": n[i], "lo": lo[i], "sha": hashlib.sha256(ids_[i].encode())}
            if out:
                yield made(out)
        if open_:
            yield made([closed(open_)])

    def made(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()))],
            ["path", "sizes", "n_convs", "conv_id", "ends"])

    dealt = runs.repartition("key").sortWithinPartitions("key", "run")
    return dealt.mapInArrow(fold, "path array<string>, sizes array<long>, n_convs long, conv_id long, ends string")


class Range:
    """Distinct conversations in the order of their paths, a part of all."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        path, sizes = (table.column(c).combine_chunks() for c in ("path", "sizes"))
        self.length = np.diff(path.offsets.to_numpy()).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.turn = np.frombuffer(bytes.fromhex("".join(path.flatten().to_pylist())), ">u8").astype(np.uint64).reshape(-1, 2)
        self.size = sizes.flatten().to_numpy(zero_copy_only=False)
        self.n, self.conv = (table.column(c).to_numpy() for c in ("n_convs", "conv_id"))
        self.ends = table.column("ends").combine_chunks()
        self.deepest = int(self.length.max())
        self.key = np.empty_like(self.turn)
        self._name_prefixes()

    def _name_prefixes(self):
        """128 bits for every prefix: a chain over the hashes of its turns."""
        rows = np.arange(len(self.length))
        for d in range(1, self.deepest + 1):
            rows = rows[self.length[rows] >= d]
            i = self.at[rows] + d - 1
            before = self.key[i - 1] if d > 1 else np.broadcast_to(_ROOT, (len(rows), 2))
            self.key[i] = mixed((before * _ODD + self.turn[i]).ravel()).reshape(-1, 2)

    def keys(self, rows: np.ndarray, depth: int) -> np.ndarray:
        if depth <= 0:
            return np.broadcast_to(_ROOT, (len(rows), 2))
        return self.key[self.at[rows] + depth - 1]

    def peeled(self):
        """From the greatest depth up: conversations that end there join the nodes that
        survive from below, each loses its last turn, and equal prefixes are one node.
        A node that holds the first or the last conversation is open."""
        by_length = np.argsort(self.length, kind="stable")
        edges = np.searchsorted(self.length[by_length], np.arange(self.deepest + 2))
        last = len(self.length) - 1
        below = None
        for d in range(self.deepest, -1, -1):
            ended = np.sort(by_length[edges[d]:edges[d + 1]])
            zero = np.zeros(len(ended), np.int64)
            level = {"row": ended, "n": self.n[ended], "conv": self.conv[ended], "children": zero, "leaves": zero, "saved": zero}
            if below is not None:
                # What an open child holds is not all known yet: it keeps that to itself.
                shut = ~below["open"]
                up = {"row": below["row"], "n": below["n"] * shut, "conv": np.where(shut, below["conv"], LAST_ID),
                      "children": shut.astype(np.int64), "leaves": below["leaves"] * shut, "saved": below["saved"] * shut}
                level = {c: np.concatenate((level[c], up[c])) for c in level}
            order = np.argsort(level["row"], kind="stable")
            row = level["row"][order]
            key = self.keys(row, d)
            new = np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))
            starts = np.flatnonzero(new)
            node = {c: np.add.reduceat(level[c][order], starts) for c in ("n", "children", "leaves", "saved")}
            node["conv"] = np.minimum.reduceat(level["conv"][order], starts)
            node["row"], node["key"] = row[starts], key[starts]
            # The conversation that is the node's own path comes before its extensions.
            own = order[starts]
            node["end"] = np.where(own < len(ended), node["row"], -1)
            node["size"] = self.size[self.at[node["row"]] + d - 1] if d else np.zeros(len(starts), np.int64)
            node["parent"] = self.keys(node["row"], d - 1)
            ends_of_range = [self.keys(np.array([r]), d) for r in {0, last} if self.length[r] >= d]
            node["open"] = np.zeros(len(starts), bool)
            for k in ends_of_range:
                node["open"] |= (node["key"] == k).all(axis=1)
            shut = ~node["open"]
            node["leaves"] = np.where(shut & (node["children"] == 0), 1, node["leaves"])
            node["saved"] = node["saved"] + np.where(shut, (node["n"] - 1) * node["size"], 0)
            if below is not None:
                of = (np.cumsum(new) - 1)[np.argsort(order)[len(ended):]]
                known = ~node["open"][of]
                yield self._written(below, d + 1, np.where(known, node["conv"][of], 0), known)
            below = node
        yield self._written(below, 0, np.zeros(len(below["n"]), np.int64), np.zeros(len(below["n"]), bool))

    def _written(self, node, depth: int, parent_conv, known) -> pa.RecordBatch:
        n = len(node["n"])
        k, p = node["key"].view(np.int64), node["parent"].view(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(node["open"]), pa.array(np.full(n, depth)), *(pa.array(np.ascontiguousarray(x)) for x in (k[:, 0], k[:, 1], p[:, 0], p[:, 1])),
            *(pa.array(node[c]) for c in ("size", "n", "conv")), pa.array(parent_conv, mask=~known),
            *(pa.array(node[c]) for c in ("children", "leaves", "saved")),
            self.ends.take(pa.array(np.maximum(node["end"], 0), mask=node["end"] < 0))], schema=_NODE)


def peeled_ranges(paths: DataFrame, turns_at_once: int) -> DataFrame:
    """Nodes of each range of at most about `turns_at_once` turns (or one conversation)."""

    def run(batches):
        held, turns = [], 0
        for batch in batches:
            ends = np.cumsum(np.diff(batch.column("path").offsets.to_numpy()))
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + turns_at_once - turns, side="right")))
                held.append(batch.slice(at, to - at))
                turns += int(ends[to - 1] - base)
                at = to
                if turns >= turns_at_once or at < batch.num_rows:
                    yield from Range(held).peeled()
                    held, turns = [], 0
        if held:
            yield from Range(held).peeled()

    return paths.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(run, _DDL)


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """The open nodes of all ranges, peeled once more from the greatest depth up."""
    levels, below = [], None
    key, parent = ["k1", "k2"], ["p1", "p2"]
    for d in range(int(rows.depth.max()), -1, -1):
        level = rows[rows.depth == d].groupby(key, as_index=False).agg(
            p1=("p1", "first"), p2=("p2", "first"), size=("size", "first"), n_convs=("n_convs", "sum"), conv_id=("conv_id", "min"),
            n_children=("n_children", "sum"), n_leaves=("n_leaves", "sum"), saved=("saved", "sum"), ends=("ends", "first"))
        if below is not None:
            at = pd.MultiIndex.from_frame(level[key])
            up = below.groupby(parent).agg(n_convs=("n_convs", "sum"), n_children=("n_convs", "size"), n_leaves=("n_leaves", "sum"), saved=("saved", "sum"))
            up = up.reindex(at, fill_value=0)
            for c in up.columns:
                level[c] += up[c].to_numpy()
            level["conv_id"] = np.minimum(level["conv_id"], below.groupby(parent)["conv_id"].min().reindex(at, fill_value=LAST_ID).to_numpy())
        level["n_leaves"] = level["n_leaves"].where(level["n_children"] > 0, 1)
        level["saved"] += (level["n_convs"] - 1) * level["size"]
        level["depth"] = d
        if below is not None:
            of = dict(zip(zip(level.k1, level.k2), level.conv_id))
            below["parent_conv_id"] = [of[x] for x in zip(below.p1, below.p2)]
        levels.append(level)
        below = level
    below["parent_conv_id"] = None
    out = pd.concat([x.astype({"parent_conv_id": "Int64"}) for x in levels])
    return out.assign(open=True)[_NODE.names]


def prefix_trie(lists: DataFrame, turns_at_once: int = 1_000_000) -> DataFrame:
    """One row per node of the trie of the conversations in `lists` (conv_id, path, sizes,
    one row per conversation; see `turn_lists`): conv_id (smallest member), depth,
    parent_conv_id (the root's is null), n_convs, n_children, n_leaves, saved_tokens (over
    the subtree, code points of a node's last text times its members but one), ends_sha256
    (of the ids of the conversations that are the node's whole path), k1 and k2 (a 128-bit
    name of the path).

    Distinct conversations in the order of their paths are dealt in ranges, each peeled by
    itself. Only nodes that hold the first or last conversation of a range can go on in
    another: they stay open and are peeled together afterwards, at most two for each depth
    and range, in one task. So a beginning that a third of all conversations share is
    worked on by many tasks, and the number of jobs does not grow with the depth.

    A conversation without turns is a member of the root alone. An empty table has no
    nodes. Other columns are not read.
    """
    paths = stored(distinct_paths(lists.select("conv_id", "path", "sizes")), "paths")
    nodes = stored(peeled_ranges(paths, turns_at_once), "peeled")
    top = stored(nodes.filter("open").groupBy("open").applyInPandas(_merged, _DDL), "open-nodes")
    parents = top.select((F.col("depth") + 1).alias("t_depth"), F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("conv_id").alias("t_conv"))
    same = (F.col("depth") == F.col("t_depth")) & (F.col("p1") == F.col("t1")) & (F.col("p2") == F.col("t2")) & F.col("parent_conv_id").isNull()
    rest = nodes.filter("not open").join(parents, same, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "t_conv"))
    return rest.select(*_NODE.names).unionByName(top).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), "k1", "k2")
