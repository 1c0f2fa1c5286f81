"""Trie of conversation prefixes, aggregated at every depth from sorted shards.

A turn is a fixed-width id (digest of role and text, and the text's length), a
conversation the ids of its turns one after the other. Conversations are sorted
into range shards; in a shard, padded matrices of turn ids are sorted column by
column, accumulated changes between neighbours mark where a node starts, and
segments between starts are aggregated. Nodes that reach over a shard's edge are
partial there and are put together afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import map_arrow, sorted_stage, text_of
from scanloom.plans.ship import ship_package
from scanloom.plans.stage import stage

WIDTH = 20  # bytes of a turn id: 16 of the digest, 4 of the length
HEAD = 9  # heads have fewer turns than this
SPAN = 5  # conversations that share the head of the first of them
_SHARD_BYTES = 2 << 20
_CELLS = 1 << 20
_CHUNK = 1 << 16

_NODES = (
    "kind int, key binary, parent_key binary, pid int, part int, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
)
_ARROW = pa.schema(
    [
        ("kind", pa.int32()),
        ("key", pa.binary()),
        ("parent_key", pa.binary()),
        ("pid", pa.int32()),
        ("part", pa.int32()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends", pa.binary()),
    ]
)
WHOLE, HANGING, PARTIAL, ENDS = range(4)  # done; done but for the parent; a share of a node; a share of its ends


def turn_ids(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turns: the ids of all turns in order, as one binary."""
    role, text = text_of(role_col), text_of(text_col)
    size = F.octet_length(text)
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.unhex(F.concat(digest, F.lpad(F.hex(size), 8, "0"))).alias("id"),
    )
    listed = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id")))
    ids = F.transform(listed, lambda t: F.hex(t["id"]))
    return turns.groupBy("conv_id").agg(F.unhex(F.concat_ws("", ids)).alias("turns"))


def rebuild(turns: DataFrame, head: int = HEAD, span: int = SPAN) -> DataFrame:
    """conv_id, path: the first h turns of conversation c - c % ``span``, then c's own after its first h; h = crc32(c) % ``head``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    own = turns.withColumn("__h", h).withColumn("__base", F.col("conv_id") - F.col("conv_id") % span)
    heads = turns.filter(F.col("conv_id") % span == 0).select(
        F.col("conv_id").alias("__base"), F.substring("turns", 1, (head - 1) * WIDTH).alias("__head")
    )
    first = F.substring(F.coalesce("__head", F.lit(b"")), F.lit(1), F.col("__h") * WIDTH)
    rest = F.substring(F.col("turns"), F.col("__h") * WIDTH + 1, F.octet_length("turns"))
    return own.join(heads, "__base", "left").select("conv_id", F.concat(first, rest).alias("path"))


def _shared(a: bytes | None, b: bytes | None) -> int:
    """How many leading turns two paths share; -1 if one is absent."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // WIDTH * WIDTH
    x, y = (np.frombuffer(p[:n], np.uint8).reshape(-1, WIDTH) for p in (a, b))
    unlike = np.flatnonzero((x != y).any(axis=1))
    return int(unlike[0]) if len(unlike) else n // WIDTH


def _matrix(rows, first, width, ids, starts, lengths) -> np.ndarray:
    """Turn ids of ``rows``, padded with 0."""
    column = first + np.arange(width)
    inside = column[None, :] < lengths[rows][:, None]
    place = np.where(inside, starts[rows][:, None] + column[None, :], 0)
    return np.where(inside, ids[place], 0)


def _spans(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Blocks of columns, so wide that a padded matrix stays below a bound of cells."""
    out, at, longest = [], 0, int(lengths.max(initial=0))
    ordered = np.sort(lengths)
    while at < longest:
        reach = len(ordered) - int(np.searchsorted(ordered, at, side="right"))
        width = min(longest - at, max(1, min(64 if reach > 1024 else 1024, _CELLS // reach)))
        out.append((at, width))
        at += width
    return out


def aggregate(paths: list[bytes], convs: np.ndarray, before: int, after: int):
    """Nodes of one sorted shard, depth by depth.

    ``before`` is the number of leading turns that the first path shares with
    the last one of the shard before (-1: none is before), ``after`` the same
    for the last path and the shard after. Yields for every depth block a dict
    of arrays; nodes of the first and last path to these depths are partial.
    """
    lengths = np.array([len(p) // WIDTH for p in paths], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    raw = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, WIDTH)
    words = [np.ascontiguousarray(raw[:, a : a + 8]).view(">u8").ravel() for a in (0, 8)]
    sizes = np.ascontiguousarray(raw[:, 16:]).view(">u4").ravel().astype(np.int64)
    by_id = np.lexsort((words[1], words[0]))
    new = np.ones(len(by_id), bool)
    new[1:] = (np.diff(words[0][by_id].astype(np.uint64)) != 0) | (np.diff(words[1][by_id].astype(np.uint64)) != 0)
    ids = np.empty(len(by_id), np.int64)
    ids[by_id] = np.cumsum(new)  # from 1, in the order of the digests; 0 pads

    order = np.argsort(convs, kind="stable")
    spans = _spans(lengths)
    for first, width in reversed(spans):  # the last columns first, every sort stable
        deep = lengths[order] > first
        rows = order[deep]
        m = _matrix(rows, first, width, ids, starts, lengths)
        order = np.concatenate([order[~deep], rows[np.lexsort(m.T[::-1])]])

    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)

    # Where nodes start: a change in a column or any before it. ``group`` numbers the nodes at the end of a block.
    blocks, group = [], np.zeros(n, np.int64)
    for first, width in spans:
        rows = order[lengths[order] > first]
        m = _matrix(rows, first, width, ids, starts, lengths)
        change = np.ones(m.shape, bool)
        change[1:] = m[1:] != m[:-1]
        change[1:, 0] |= group[rows[1:]] != group[rows[:-1]]
        change = np.logical_or.accumulate(change, axis=1)
        blocks.append((first, rows, change))
        group = np.full(n, -1, np.int64)
        group[rows] = np.cumsum(change[:, -1])

    # A conversation whose successor does not begin with it ends at a leaf.
    sorted_lengths = lengths[order]
    follows = np.zeros(n, np.int64)
    for first, rows, change in blocks:  # turns shared with the predecessor
        equal = np.where(change[1:], 0, 1).sum(axis=1)
        held = np.minimum(equal, np.minimum(lengths[rows[1:]], lengths[rows[:-1]]) - first)
        at, prior = place[rows[1:]], place[rows[:-1]]
        near = at == prior + 1
        follows[at[near]] += np.maximum(held[near], 0)
    begins = np.append(follows[1:], after)
    leaf = (begins < sorted_lengths).astype(np.int64)
    leaf_of = np.empty(n, np.int64)
    leaf_of[order] = leaf

    deeper = np.zeros(n, np.int64)  # tokens saved below the block, by conversation
    next_starts = np.zeros(n, np.int64)  # whether a node starts in the column after, by conversation
    for first, rows, change in reversed(blocks):
        width = change.shape[1]
        valid = (first + np.arange(width))[None, :] < lengths[rows][:, None]
        opens = change & valid
        new_node = opens.copy()  # a node that is not carried on from the shard before
        if rows[0] == order[0]:
            new_node[0] &= first + np.arange(width) + 1 > before
        column, row = np.nonzero(valid.T)
        at = np.flatnonzero(opens.T[column, row])
        count = np.diff(np.append(at, len(row)))
        depth = first + column[at] + 1
        top = rows[row[at]]
        size = sizes[starts[top] + first + column[at]]
        own = count * size - np.where(new_node[row[at], column[at]], size, 0)

        saved = np.zeros((len(rows), width), np.int64)
        saved[row[at], column[at]] = own
        saved = saved[:, ::-1].cumsum(axis=1)[:, ::-1] + deeper[rows][:, None]
        child = np.zeros((len(rows), width), np.int64)
        child[:, :-1] = new_node[:, 1:]
        child[:, -1] = next_starts[rows]
        deeper[rows], next_starts[rows] = saved[:, 0], new_node[:, 0]

        member = rows[row]
        path_end = lengths[member] == first + column + 1
        yield {
            "depth": depth,
            "top": top,
            "place": place[top],
            "count": count,
            "conv_id": np.minimum.reduceat(convs[member], at),
            "children": np.add.reduceat(child[row, column], at),
            "leaves": np.add.reduceat(leaf_of[member], at),
            "saved": np.add.reduceat(saved[row, column], at),
            "ends": np.add.reduceat(path_end.astype(np.int64), at),
            "of_last": place[member[at + count - 1]] == n - 1,
        }
    yield {
        "depth": np.zeros(1, np.int64),
        "top": order[:1],
        "place": np.zeros(1, np.int64),
        "count": np.array([n]),
        "conv_id": convs.min(keepdims=True),
        "children": next_starts.sum(keepdims=True),
        "leaves": leaf.sum(keepdims=True),
        "saved": deeper.sum(keepdims=True),
        "ends": (lengths == 0).sum(keepdims=True),
        "of_last": np.ones(1, bool),
        "order": order,
    }


def _prefix_keys(path: bytes, depth: int) -> list[bytes]:
    """Digests of the prefixes of ``path`` with 0 to ``depth`` turns."""
    state = hashlib.md5()
    out = [state.digest()]
    for d in range(depth):
        state.update(path[d * WIDTH : (d + 1) * WIDTH])
        out.append(state.copy().digest())
    return out


def _joined(convs: np.ndarray) -> bytes:
    return ",".join(map(str, convs.tolist())).encode()


def shard_nodes(table: pa.Table) -> pa.Table:
    """Nodes of one shard, given as rows of pid, path, conv_id and ghost (-1, 1: last path before, first path after)."""
    pid = table.column("pid")[0].as_py()
    ghost = table.column("ghost").to_numpy()
    paths = table.column("path").to_pylist()
    near = {int(g): paths[i] for i, g in enumerate(ghost) if g}
    real = np.flatnonzero(ghost == 0)
    paths = [paths[i] for i in real]
    convs = table.column("conv_id").take(pa.array(real)).to_numpy().astype(np.int64)
    low, high = min(paths), max(paths)
    before, after = _shared(near.get(-1), low), _shared(high, near.get(1))
    found = list(aggregate(paths, convs, before, after))
    order = found[-1]["order"]
    node = {k: np.concatenate([f[k] for f in found]) for k in found[-1] if k != "order"}
    n = len(order)
    by = np.argsort(node["depth"] * n + node["place"])
    node = {k: v[by] for k, v in node.items()}
    depth, place = node["depth"], node["place"]
    parent = np.searchsorted(depth * n + place, (depth - 1) * n + place, side="right") - 1

    of_first = (place == 0) & (depth <= before)
    of_last = node["of_last"] & (depth <= after)
    partial = of_first | of_last | (depth == 0)
    first_keys, last_keys = _prefix_keys(low, max(before, 0)), _prefix_keys(high, max(after, 0))
    keys = [(first_keys if of_first[i] else last_keys)[depth[i]] if partial[i] else None for i in range(len(by))]

    rows, extra = [], []
    empty = hashlib.sha256(b"").digest()
    for i in range(len(by)):
        ends = None
        if n_ends := int(node["ends"][i]):
            ids = convs[order[place[i] : place[i] + n_ends]]
            if partial[i]:
                for part, at in enumerate(range(0, n_ends, _CHUNK)):
                    extra.append((keys[i], part, _joined(ids[at : at + _CHUNK])))
            else:
                ends = hashlib.sha256(_joined(ids)).digest()
        elif not partial[i]:
            ends = empty
        rows.append(ends)
    hangs = ~partial & partial[parent]
    kind = np.where(partial, PARTIAL, np.where(hangs, HANGING, WHOLE)).astype(np.int32)
    parents = [keys[parent[i]] if (hangs[i] or partial[i]) and depth[i] else None for i in range(len(by))]
    nodes = pa.table(
        [
            pa.array(kind),
            pa.array(keys, pa.binary()),
            pa.array(parents, pa.binary()),
            pa.array(np.full(len(by), pid, np.int32)),
            pa.array(np.zeros(len(by), np.int32)),
            pa.array(node["conv_id"]),
            pa.array(depth),
            pa.array(node["conv_id"][parent], mask=kind != WHOLE),
            pa.array(node["count"].astype(np.int64)),
            pa.array(node["children"]),
            pa.array(node["leaves"]),
            pa.array(node["saved"]),
            pa.array(rows, pa.binary()),
        ],
        schema=_ARROW,
    )
    chunks = [
        {"kind": ENDS, "key": key, "pid": pid, "part": part, "ends": text, **dict.fromkeys(_NUMBERS)} for key, part, text in extra
    ]
    return pa.concat_tables([nodes, pa.Table.from_pylist(chunks, _ARROW)])


_NUMBERS = ("parent_key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined chunks of every key; rows come sorted by key and place."""
    key, state = None, None

    def done():
        return pa.RecordBatch.from_pydict({"key": [key], "ends": [state.digest()]}, pa.schema([("key", pa.binary()), ("ends", pa.binary())]))

    for batch in batches:
        for i in range(batch.num_rows):
            now, text = batch.column("key")[i].as_py(), batch.column("ends")[i].as_py()
            if now == key:
                state.update(b",")
            else:
                if key is not None:
                    yield done()
                key, state = now, hashlib.sha256()
            state.update(text)
    if key is not None:
        yield done()


def prefix_trie(
    conversations: DataFrame,
    head: int = HEAD,
    span: int = SPAN,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the root (no turns) included.

    Turns are ordered by ``turn_col``, null first, equal ones by the digest of
    role and text; a null role or text is empty. Conversation c is rebuilt from
    the first h turns of conversation c - c % ``span`` and its own turns after
    its first h, h = crc32(c) % ``head``. A prefix is told by its roles and texts.

    Returns conv_id (the smallest with the prefix), depth, parent_conv_id (null
    for the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256,
    the digest of the comma-joined ids of conversations that end there.

    Rows with a null conversation id belong to none and are left out; repeated
    rows are turns of their own; an empty table gives no rows, not even a root.
    A conversation is one value of 20 bytes a turn (up to some 50 million
    turns); texts are reduced to that before anything is shuffled.

    Shards are cut by prefix and conversation id, so many equal conversations
    spread over shards. Only nodes at a shard's edge, at most the turns of two
    conversations a shard, are put together afterwards, and the ids that end at
    such a node pass through one task as they must for one digest, in texts of
    65,536 ids.
    """
    turns = turn_ids(conversations, conv_col, turn_col, role_col, text_col)
    paths = stage(rebuild(stage(turns, "trie-turns"), head, span), "trie-paths")
    size = paths.agg(F.sum(F.octet_length("path"))).first()[0]
    dealt = paths.repartitionByRange(1 + (size or 0) // _SHARD_BYTES, "path", "conv_id")
    shards = stage(dealt.withColumn("pid", F.spark_partition_id()), "trie-shards")
    bounds = shards.groupBy("pid").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    near = Window.partitionBy(F.lit(0)).orderBy("pid")  # a row a shard
    bounds = bounds.select("pid", F.lag("high").over(near).alias("high"), F.lead("low").over(near).alias("low"))
    none = F.lit(None).cast("long").alias("conv_id")
    ghosts = [
        bounds.filter(F.col(c).isNotNull()).select("pid", F.col(c).alias("path"), none, F.lit(g).alias("ghost"))
        for c, g in (("high", -1), ("low", 1))
    ]
    rows = shards.select("pid", "path", "conv_id", F.lit(0).alias("ghost")).union(ghosts[0]).union(ghosts[1])
    ship_package(conversations.sparkSession)
    nodes = stage(rows.groupBy("pid").applyInArrow(shard_nodes, _NODES), "trie-nodes")

    shares = nodes.filter(F.col("kind") == PARTIAL)
    totals = shares.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"),
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    totals = stage(totals, "trie-edges")
    chunks = nodes.filter(F.col("kind") == ENDS).select("key", "pid", "part", "ends")
    chunks = chunks.repartition("key").sortWithinPartitions("key", "pid", "part")
    hashed = map_arrow(chunks, _hash_chunks, "key binary, ends binary")
    above = totals.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    edges = totals.join(above, "parent_key", "left").join(hashed, "key", "left")
    edges = edges.withColumn("ends", F.coalesce("ends", F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))))
    # Children of an edge node are joined shard by shard, so a node with most of all children is no single key.
    above = shares.select("pid", "key").join(totals.select("key", F.col("conv_id").alias("__above")), "key")
    above = above.select("pid", F.col("key").alias("parent_key"), "__above")
    hanging = nodes.filter(F.col("kind") == HANGING).join(above, ["pid", "parent_key"]).withColumn("parent_conv_id", F.col("__above"))
    whole = nodes.filter(F.col("kind") == WHOLE)
    out = whole.select(columns).union(hanging.select(columns)).union(edges.select(columns))
    return out.select(*columns[:-1], F.lower(F.hex("ends")).alias("ends_sha256"))
