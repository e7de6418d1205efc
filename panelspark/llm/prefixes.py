"""Prefix trie of conversations by truncation peeling: from the deepest turn upwards, ranges of conversations at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import attach
from .blocks import integers, part_count, utf8
from .storage import written

#: Conversations that share an opening of fewer than OPENING turns, bytes of a turn's digest, of a turn in all, of a partition of turns.
FAMILY, OPENING, DIGEST, TURN_BYTES, PART_BYTES = 20, 4, 16, 40, 16 << 20
WORDS = r"[^\x20\x09-\x0D]+"
NO_END = hashlib.sha256(b"").hexdigest()
BLOCKS = "path binary, first long, ids binary, words binary"
PATHS = "path binary, words binary, n long, low long, ends string"
PARTIAL = "open boolean, key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string"
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digested_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, base, turn): some 40 bytes for each turn instead of its text; a null role or text is empty, rows without conv_id go."""
    col = lambda name: F.col(f"`{name}`")
    said, by = F.coalesce(col(text).cast("string"), F.lit("")), F.coalesce(col(role).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary")))
    conv = col(conv_id).cast("long")
    turns = conversations.filter(conv.isNotNull()).select(
        conv.alias("conv_id"), (conv - conv % FAMILY).alias("base"), F.struct(col(turn).cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(said, F.lit(WORDS)).alias("words")).alias("turn")
    )
    return written(turns)  # ranges of it are found without reading the texts again


def rebuilt(turns: DataFrame, parts: int) -> DataFrame:
    """(conv_id, digests, words): every conversation with the opening of the first one of its family.

    Partitions hold ranges of conv_id, ascending.  Turns go by number, null first, those of one
    number by digest.
    """
    own = turns.repartitionByRange(parts, "base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own"))
    opening = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, OPENING - 1))).over(Window.partitionBy("base"))  # at most 39 conversations
    h = (F.crc32(F.col("conv_id").cast("string")) % OPENING).cast("int")
    path = F.concat(F.slice(F.coalesce("opening", F.slice("own", 1, 0)), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    whole = own.withColumn("opening", opening).select("conv_id", path.alias("path"))
    return whole.sortWithinPartitions("conv_id").select("conv_id", F.transform("path", lambda t: t["digest"]).alias("digests"), F.transform("path", lambda t: t["words"]).alias("words"))


def distinct_paths(convs: DataFrame, parts: int) -> DataFrame:
    """(path, words, n, low, ends): every distinct sequence of turns, its conversations, the smallest, and the digest of all their ids.

    Copies are counted in blocks of ids before they travel; the ids of one path then pass through
    one digest in ascending order, block by block.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = integers(batch, "conv_id")
            lists, counts = batch.column(1), batch.column(2)
            at = np.asarray(lists.offsets, np.int64)
            at = at - at[0]
            data = utf8(lists.flatten())[0].tobytes()
            words = np.asarray(counts.flatten(), "<i4").tobytes()
            held: dict[bytes, list[int]] = {}
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                held.setdefault(data[DIGEST * a : DIGEST * b], []).append(k)
            some = list(held.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array([ids[k[0]] for k in some]), pa.array([ids[k].astype("<i8").tobytes() for k in some], pa.binary()), pa.array([words[4 * at[k[0]] : 4 * at[k[0] + 1]] for k in some], pa.binary())],
                names=["path", "first", "ids", "words"],
            )

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, sha, n, low = None, b"", hashlib.sha256(), 0, 0

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["path", "words", "n", "low", "ends"])

        for batch in batches:
            done = []
            for path, first, ids, counts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if path != now:
                    if now is not None:
                        done.append((now, words, n, low, sha.hexdigest()))
                    now, words, sha, n, low = path, counts, hashlib.sha256(), 0, first
                block = np.frombuffer(ids, "<i8")
                sha.update((("," if n else "") + ",".join(map(str, block.tolist()))).encode())
                n += len(block)
            if done:
                yield table(done)
        if now is not None:
            yield table([(now, words, n, low, sha.hexdigest())])

    return written(convs.mapInArrow(blocks, BLOCKS).repartition(parts, F.xxhash64("path")).sortWithinPartitions("path", "first").mapInArrow(digested, PATHS))


def shared_turns(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Turns that each sorted path shares with the one before it; -1 for the first."""
    size = np.diff(at)
    out = np.zeros(len(size), np.int64)
    out[:1] = -1
    live, depth = np.arange(1, len(size)), 0
    while len(live):
        live = live[(size[live] > depth) & (size[live - 1] > depth)]
        live = live[(flat[at[live] + depth] == flat[at[live - 1] + depth]).all(axis=1)]
        depth += 1
        out[live] = depth
    return out


def prefix_keys(path: bytes) -> list[bytes]:
    """A digest for every prefix of a path, the empty one first."""
    running, out = hashlib.md5(), [hashlib.md5().digest()]
    for k in range(0, len(path), DIGEST):
        running.update(path[k : k + DIGEST])
        out.append(running.copy().digest())
    return out


def peeled(path: list[bytes], words: list[bytes], n: np.ndarray, low: np.ndarray, ends: list[str]) -> Iterator[pa.RecordBatch]:
    """The nodes of sorted distinct paths, a batch per depth from the deepest up (columns of PARTIAL).

    At every depth the paths that end there join the nodes that survived from below, whose last turn
    has been stripped, and neighbours that share all turns left become one node.  Prefixes of the
    first and the last path may go on in other ranges: they are open, and hold what lies below them
    apart from other open nodes.
    """
    size = np.array([len(p) // DIGEST for p in path], np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    flat = np.frombuffer(b"".join(path), "<u8").reshape(-1, DIGEST // 8)
    tokens = np.frombuffer(b"".join(words), "<i4").astype(np.int64)
    shared = shared_turns(flat, at)
    left_keys, right_keys = prefix_keys(path[0]), prefix_keys(path[-1])
    by_size = np.argsort(size, kind="stable")
    bounds = np.searchsorted(size[by_size], np.arange(int(size.max()) + 2))
    none = np.zeros(0, np.int64)
    node = {name: none for name in ("first", "n", "low", "children", "leaves", "saved", "end", "words")} | {"open": np.zeros(0, bool)}
    for depth in range(int(size.max()), -2, -1):
        ended = by_size[bounds[depth] : bounds[depth + 1]] if depth >= 0 else none
        closed = ~node["open"]
        first = np.concatenate((node["first"], ended))
        order = np.argsort(first, kind="stable")
        first = first[order]
        # which node of this depth each node below, and each path that ends here, belongs to
        new = shared[first] < depth
        new[:1] = True
        start, which = np.flatnonzero(new), np.cumsum(new) - 1
        above = np.empty(len(order), np.int64)
        above[order] = which
        above = above[: len(closed)]
        blank = np.zeros(len(ended), np.int64)
        up = {}
        if len(start):
            total = lambda below, own: np.add.reduceat(np.concatenate((below, own))[order], start)
            up["first"], up["n"] = first[start], total(node["n"], n[ended])
            up["low"] = np.minimum.reduceat(np.concatenate((node["low"], low[ended]))[order], start)
            up["children"] = total(closed.astype(np.int64), blank)
            up["leaves"], up["saved"] = total(np.where(closed, node["leaves"], 0), blank), total(np.where(closed, node["saved"], 0), blank)
            up["end"] = np.full(len(start), -1)
            up["end"][which[np.argsort(order)[len(closed) :]]] = ended
            up["words"] = tokens[at[up["first"]] + depth - 1] if depth > 0 else np.zeros(len(start), np.int64)
            up["open"] = up["first"] == 0
            up["open"][-1] |= size[-1] >= depth
            shut = ~up["open"]
            up["leaves"][shut & (up["children"] == 0)] = 1
            up["saved"][shut] += (up["n"] * up["words"] - up["words"])[shut]
        if len(node["first"]):
            yield _nodes(node, depth + 1, up if depth >= 0 else None, above, left_keys, right_keys, ends)
        node = up


def _nodes(node: dict, depth: int, up: dict | None, above: np.ndarray, left_keys: list[bytes], right_keys: list[bytes], ends: list[str]) -> pa.RecordBatch:
    """Nodes of one depth; closed ones below a closed node know its conversation, those below an open one its key."""
    count = len(node["first"])
    open_, first = node["open"], node["first"]
    key = [None] * count
    for k in np.flatnonzero(open_).tolist():
        key[k] = (left_keys if first[k] == 0 else right_keys)[depth]
    parent, parent_conv, known = [None] * count, np.zeros(count, np.int64), np.zeros(count, bool)
    if up is not None:
        parent_conv, known = up["low"][above], ~up["open"][above]
        above_key = {k: (left_keys if up["first"][k] == 0 else right_keys)[depth - 1] for k in np.flatnonzero(up["open"]).tolist()}
        parent = [above_key.get(k) for k in above.tolist()]
    whole = lambda x: pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(open_), pa.array(key, pa.binary()), pa.array(parent, pa.binary()), whole(np.full(count, depth)), whole(node["low"]), pa.array(parent_conv, pa.int64(), mask=~known),
            *(whole(node[c]) for c in ("n", "children", "leaves", "saved", "words")), pa.array([ends[k] if k >= 0 else None for k in node["end"].tolist()], pa.string()),
        ],
        names=[x.split()[0] for x in PARTIAL.split(", ")],
    )


def merged_open(rows: pd.DataFrame) -> pd.DataFrame:
    """Open nodes put together over all ranges, from the deepest up."""
    named = rows.groupby("key", sort=False).agg(
        parent=("parent", "first"), depth=("depth", "first"), conv_id=("conv_id", "min"), n_convs=("n_convs", "sum"), n_children=("n_children", "sum"), n_leaves=("n_leaves", "sum"),
        saved_tokens=("saved_tokens", "sum"), words=("words", "first"), ends_sha256=("ends_sha256", "first"),
    )
    held = {key: list(values) for key, values in zip(named.index, named[["parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words"]].itertuples(index=False, name=None))}
    for key in named.sort_values("depth", ascending=False).index:
        parent, depth, _, n, children, leaves, saved, words = held[key]
        leaves += children == 0
        saved += (n - 1) * words
        held[key][5:7] = leaves, saved
        if depth:
            above = held[parent]
            above[4] += 1
            above[5] += leaves
            above[6] += saved
    out = named.drop(columns=["n_children", "n_leaves", "saved_tokens"]).reset_index()
    out["n_children"], out["n_leaves"], out["saved_tokens"] = ([held[key][k] for key in out["key"]] for k in (4, 5, 6))
    out["parent_conv_id"] = pd.array([held[p][2] if d else None for p, d in zip(out["parent"], out["depth"])], dtype="Int64")
    out["ends_sha256"] = out["ends_sha256"].where(out["ends_sha256"].notna(), NO_END)
    return out[["key", *NODES]]


def conversation_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node of the trie of all rebuilt conversations: the columns of NODES.

    Distinct paths are dealt by ranges, so that a node is a stretch of neighbours and an opening that
    a large share of all conversations have is peeled by many tasks.  Only prefixes of a range's first
    and last path can go on elsewhere; these few, one path's length for each end of a range, are put
    together at the end.  See ``rebuilt`` for ties, ``digested_turns`` for nulls; a repeated row is a turn of its own; further
    columns are left out; an empty table gives no rows.
    """
    turns = digested_turns(conversations, conv_id, turn, role, text)
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns.count() * TURN_BYTES // PART_BYTES)
    paths = distinct_paths(rebuilt(turns, parts), parts)

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            path, words, n, low, ends = (table.column(k) for k in range(5))
            yield from peeled(path.to_pylist(), words.to_pylist(), n.to_numpy(), low.to_numpy(), ends.to_pylist())

    ranged = paths.repartitionByRange(part_count(paths, "path"), "path").sortWithinPartitions("path")
    nodes = written(ranged.mapInArrow(peel, PARTIAL))
    kinds = dict(x.split() for x in PARTIAL.split(", "))
    open_ = written(nodes.filter("open").groupBy("open").applyInPandas(merged_open, "key binary, " + ", ".join(f"{c} {kinds[c]}" for c in NODES)))
    shut = nodes.filter("not open").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_END)))
    inner = shut.filter("parent is null").select(NODES)
    above = open_.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    outer = attach(shut.filter("parent is not null").drop("parent_conv_id"), above, "parent", "conv_id").select(NODES)
    return inner.unionByName(outer).unionByName(open_.select(NODES))


#: The same from all prefixes of all conversations, each node beside all of its ancestors.
ORACLE = rf"""
WITH ids AS (
  SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL
), hashed AS (
  SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)), 4294967295::BIGINT) % {OPENING} AS h FROM ids
), turns AS (
  SELECT conv_id AS c, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(w ORDER BY turn NULLS FIRST, k) AS ws FROM turns GROUP BY c
), built AS (
  SELECT o.c, list_concat(list_slice(coalesce(b.ks, []), 1, h), list_slice(o.ks, h + 1, len(o.ks))) AS ks, list_concat(list_slice(coalesce(b.ws, []), 1, h), list_slice(o.ws, h + 1, len(o.ws))) AS ws
  FROM own o JOIN hashed USING (c) LEFT JOIN own b ON b.c = o.c - o.c % {FAMILY}
), places AS (
  SELECT c, unnest(range(len(ks) + 1)) AS depth, ks, ws FROM built
), prefixes AS (
  SELECT c, depth, md5(array_to_string(list_slice(ks, 1, depth), ',')) AS node, CASE WHEN depth > 0 THEN md5(array_to_string(list_slice(ks, 1, depth - 1), ',')) END AS above,
    CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS words, depth = len(ks) AS ends FROM places
), nodes AS (
  SELECT node, any_value(above) AS above, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY node
), fan AS (
  SELECT above, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above
), sums AS (
  SELECT p.node, sum(CASE WHEN f.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved
  FROM nodes u JOIN prefixes p ON p.c = u.conv_id AND p.depth <= u.depth LEFT JOIN fan f ON f.above = u.node GROUP BY p.node
)
SELECT v.conv_id, v.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, v.n_convs, coalesce(f.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v JOIN sums s USING (node) LEFT JOIN nodes a ON a.node = v.above LEFT JOIN fan f ON f.above = v.node
"""
