"""Prefix trie of conversations by fixed-length block hashing.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. Conversations are
grouped by digests of their first `BLOCK`, 2 `BLOCK`, ... turns. Where all that go on from such a place share the whole
next block, that block is one edge of the trie and nobody looks inside it. Only where siblings diverge (another block, or an
end inside it) are the block's turns split into nodes of their own.

A digest of first turns is four sums of 32-bit pieces of a SHA-256 over a secret of the run, the turn's place and the turn's own
SHA-256, so it is found by running totals and nobody needs a conversation whole. Orders inside a conversation come from
range partitions too (`running_within`): one conversation may hold a third of all rows. Node counts are sums and minima.

Sums over subtrees take no walk through levels. Every node belongs to its smallest member, which then owns a stretch of its own
path down to its end. A node's subtree is what its members own, less what its own owner has above it.

Rows without conv_id belong to no conversation. Turns follow each other by turn (null first), equal ones by their digest; null role
or text counts as empty; repeated rows are repeated turns. Without any conversation there are no nodes. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.blocks.ranks import global_cumulate
from precinct.blocks.shared import hinted, materialize

#: Turns in a block.
BLOCK = 4
_NODE, _UP = ["a", "b"], ["ua", "ub"]
_SUMS = range(4)


def running_within(df: DataFrame, key: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with `number` (from 0, in the order inside its key), `of` (rows of the key) and running totals inside the key, {new
    column: column of numbers from 0 up}. A key's rows need not meet in one task."""
    ranked = global_cumulate(df, [F.col(key), *order], sums, "_rank")
    before = ranked.groupBy(key).agg(F.min("_rank").alias("_first"), F.count("*").alias("of"), *[F.min(F.col(k) - F.col(c)).alias(f"_before_{k}") for k, c in sums.items()])
    totals = {k: F.col(k) - F.col(f"_before_{k}") for k in sums}
    return ranked.join(before, key).withColumns({"number": F.col("_rank") - F.col("_first"), **totals}).select(*df.columns, "number", "of", *sums)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest of role and text, words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), words.alias("words"))
    numbered = running_within(turns.filter("conv_id is not null"), "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], {})
    return materialize(numbered.select("conv_id", F.col("number").alias("pos"), "digest", "words"), "turns")


def with_shared_starts(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of conversations rebuilt: the first h turns of conversation c - c % every, then c's own after its first h, where h
    is the crc32 of c's decimal digits, modulo `most`. ids has every conv_id, also one that is left without turns."""
    sizes = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    c = F.col("conv_id")
    ids = sizes.select("conv_id", (F.crc32(c.cast("string")) % most).alias("h"), (c - c % every).alias("base"))
    ids = ids.join(sizes.select(F.col("conv_id").alias("base"), "n"), "base", "left").withColumn("lent", F.least("h", F.coalesce("n", F.lit(0)))).drop("n")
    own = turns.join(ids.drop("base"), "conv_id").filter("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("lent"))
    first = turns.filter((c % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    lent = ids.join(first, "base").filter("pos < h")
    columns = ["conv_id", "pos", "digest", "words"]
    return own.select(columns).union(lent.select(columns)), sizes.select("conv_id")


def _key(depth: Column, sums: list[Column]) -> tuple[Column, Column]:
    return tuple(F.xxhash64(F.lit(k), depth.cast("long"), *sums) for k in (1, 2))


def _paths(turns: DataFrame, ids: DataFrame, block: int) -> DataFrame:
    """A row for every conversation and node of the compressed trie on its path: conv_id, depth, the node's key (a, b), its
    parent's (ua, ub), step (turns from the parent), w0.. (words of those turns), ends (whether the conversation ends here)."""
    secret = uuid.uuid4().hex
    piece = F.sha2(F.concat(F.lit(secret), F.col("pos").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("digest")), 256)
    hashed = turns.withColumn("h", piece).select("conv_id", "pos", "words", *[F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in _SUMS])
    one = F.struct("pos", "words", *[f"h{k}" for k in _SUMS])
    blocks = hashed.groupBy("conv_id", F.floor(F.col("pos") / block).alias("block")).agg(
        F.count("*").alias("n"), *[F.sum(f"h{k}").alias(f"p{k}") for k in _SUMS], F.sort_array(F.collect_list(one)).alias("turns")  # at most `block` turns
    )
    blocks = running_within(blocks, "conv_id", [F.col("block")], {f"e{k}": f"p{k}" for k in _SUMS})
    start = [f"s{k}" for k in _SUMS]
    blocks = materialize(blocks.withColumns({f"s{k}": F.col(f"e{k}") - F.col(f"p{k}") for k in _SUMS}), "blocks")
    # a place from which all go on by one whole block needs no look inside it
    alike = [F.min(f"p{k}") == F.max(f"p{k}") for k in _SUMS]
    places = materialize(blocks.groupBy("block", *start).agg(F.min("n").alias("least"), *[x.alias(f"same{k}") for k, x in enumerate(alike)]), "places")
    whole = places.filter((F.col("least") == block) & F.col("same0") & F.col("same1") & F.col("same2") & F.col("same3")).select("block", *start, F.lit(True).alias("whole"))
    marked = blocks.join(hinted(whole), ["block", *start], "left")
    depth0 = F.col("block") * block
    words = lambda a, n: [(F.col("turns")[a + i]["words"] if i < n else F.lit(None).cast("long")).alias(f"w{i}") for i in range(block)]
    reach = [[F.col(s) for s in start]]
    for j in range(block):
        reach.append([x + F.col("turns")[j][f"h{k}"] for k, x in zip(_SUMS, reach[-1], strict=True)])

    def node(j: int, step: int) -> Column:
        """The node after the block's first j turns, `step` turns below its parent."""
        a, b = _key(depth0 + j, reach[j])
        ua, ub = _key(depth0 + j - step, reach[j - step])
        ends = (F.col("number") == F.col("of") - 1) & (F.col("n") == j)
        return F.struct((depth0 + j).cast("long").alias("depth"), a.alias("a"), b.alias("b"), ua.alias("ua"), ub.alias("ub"), F.lit(step).alias("step"), *words(j - step, step), ends.alias("ends"))

    split = F.filter(F.array(*[F.when(F.col("n") >= j, node(j, 1)) for j in range(1, block + 1)]), lambda x: x.isNotNull())
    nodes = F.when(F.col("whole"), F.array(node(block, block))).otherwise(split)
    inner = marked.select("conv_id", F.explode(nodes).alias("node")).select("conv_id", "node.*")
    a, b = _key(F.lit(0), [F.lit(0).cast("long")] * len(start))
    going = blocks.filter("number = 0").select("conv_id", F.lit(True).alias("goes"))
    none = F.lit(None).cast("long")
    root = ids.join(going, "conv_id", "left").select("conv_id", F.lit(0).cast("long").alias("depth"), a.alias("a"), b.alias("b"), none.alias("ua"), none.alias("ub"), F.lit(0).alias("step"), *[none.alias(f"w{i}") for i in range(block)], F.col("goes").isNull().alias("ends"))
    return materialize(root.unionByName(inner), "paths")


def _ends(paths: DataFrame) -> DataFrame:
    """a, b, sha of the ascending conv_ids that end at the node. The ids are joined in pieces wherever they lie in the global order; a
    node's pieces then pass through one hash, a piece at a time, since SHA-256 can't be split."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = (batch[k].to_numpy() for k in ("a", "b", "conv_id"))
            if not len(a):
                continue
            cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            begin, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]])
            joined = [",".join(map(str, c[i:j].tolist())).encode() for i, j in zip(begin.tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[begin]), pa.array(b[begin]), pa.array(c[begin]), pa.array(joined, pa.binary())], names=["a", "b", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch[k].to_pylist() for k in ("a", "b", "ids")), strict=True):
                if (a, b) != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            yield _hashed(done)
        if now:
            yield _hashed([(*now, state.hexdigest())])

    ending = paths.filter("ends").select("a", "b", "conv_id")
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["a", "b", "conv_id"]
    joined = ending.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pieces, "a long, b long, first long, ids binary")
    joined = materialize(joined, "ends")
    return joined.repartition(n, *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(hashes, "a long, b long, sha string")


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["a", "b", "sha"])


def prefix_trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for every node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of its
    subtree), saved_tokens (over its subtree, (members - 1) times the words of each node's last turn), ends_sha256.

    turns: conv_id, pos, digest, words, as numbered_turns gives them; ids: every conv_id, also those without turns."""
    paths = _paths(turns, ids, block)
    words = [f"w{i}" for i in range(block)]
    first = [F.max(c).alias(c) for c in ("depth", *_UP, "step", *words)]  # equal in all rows of a node
    nodes = materialize(paths.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *first), "nodes")
    children = nodes.filter("ua is not null").groupBy(F.col("ua").alias("a"), F.col("ub").alias("b")).agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * sum((F.coalesce(w, F.lit(0)) for w in words), F.lit(0))
    nodes = nodes.join(children, _NODE, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": saved})
    owned = materialize(running_within(nodes, "conv_id", [F.col("depth")], {"down": "saved"}), "owned")
    totals = owned.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    within = paths.select(*_NODE, "conv_id").join(totals, "conv_id").groupBy(*_NODE).agg(F.sum("saved").alias("of_members"), F.sum("leaf").alias("n_leaves"))
    parents = owned.select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("conv_id").alias("above"))
    whole = owned.join(within, _NODE).join(_ends(paths), _NODE, "left").join(parents, _UP, "left")
    # an edge of several turns becomes its nodes again: the last is the node itself, those above have one child each
    passed = [F.lit(0).cast("long")]
    for w in words:
        passed.append(passed[-1] + F.coalesce(w, F.lit(0)))
    last = lambda j: F.col("step") <= j
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    one = [
        F.struct(
            "conv_id",
            (F.col("depth") - F.col("step") + j).alias("depth"),
            (F.col("above") if j <= 1 else F.col("conv_id")).alias("parent_conv_id"),
            "n_convs",
            F.when(last(j), F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
            "n_leaves",
            (F.col("of_members") - F.col("down") + F.col("saved") - (F.col("n_convs") - 1) * passed[max(j - 1, 0)]).alias("saved_tokens"),
            F.when(last(j), F.coalesce("sha", empty)).otherwise(empty).alias("ends_sha256"),
        )
        for j in range(block + 1)
    ]
    root = F.col("step") == 0
    made = F.when(root, F.array(one[0])).otherwise(F.filter(F.array(*[F.when(F.col("step") >= j, one[j]) for j in range(1, block + 1)]), lambda x: x.isNotNull()))
    return whole.select(F.explode(made).alias("node")).select("node.*")


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """prefix_trie of conversations as they stand: rows of conv_id, turn, role, text."""
    turns = numbered_turns(conversations)
    return prefix_trie(turns, turns.select("conv_id").distinct(), block)
