"""Exact Jaccard self-join of shingle sets by universe partition, and the groups that its links form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import U64, integers, mix, part_count, runs, steps, texts, tidied, utf8, word_hashes
from .components import components
from .exchange import DEALT, UNIT_KEYS, by_bucket, dealt_batch, pack_keys, unpack_keys
from .storage import written

#: Words of a shingle; a link needs NUM / DEN of the union shared.
WORDS, NUM, DEN = 5, 3, 4
#: Size bands up to this size index one-deletion neighbourhoods too.
SMALL = 64
#: Bytes of sets in one block of a crowd: of the documents left outside its main group, and of all its documents.
OUTSIDE_BYTES, CROWD_BYTES = 8 << 20, 16 << 20
INDEX, PROBE = 1, 2
KEYS, INFO, FOLLOW = 0, 1, 2
INFO_TYPE = np.dtype([("set", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("own", "<i4"), ("low", "<i4"), ("all", "<i4")])
FOLLOW_TYPE = np.dtype([("doc", "<i8"), ("n", "<i4"), ("leader", "<i8")])


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document index and 64-bit hash of every distinct shingle, ascending by both.

    Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words than a shingle is one
    shingle; one without words has none.
    """
    word, doc = word_hashes(data, at)
    count = np.bincount(doc, minlength=len(at) - 1)
    place = np.arange(len(word)) - (np.cumsum(count) - count)[doc] if len(word) else np.zeros(0, np.int64)
    span = np.minimum(count[doc], WORDS) if len(word) else place
    start = np.flatnonzero(place + span <= count[doc]) if len(word) else place
    start = start[(count[doc[start]] >= WORDS) | (place[start] == 0)]
    total = np.zeros(len(start), U64)
    padded = np.concatenate((word, np.zeros(WORDS, U64)))
    factor = 1
    for k in range(WORDS):
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
        total += np.where(k < span[start], padded[start + k] * U64(factor), U64(0))
    value, doc = mix(total + span[start].astype(U64)), doc[start]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], value[new]


def bands(largest: int) -> np.ndarray:
    """Smallest size of each band; two sizes that can link lie in one band or in neighbouring ones."""
    low = [1]
    while low[-1] <= largest:
        low.append(low[-1] * DEN // NUM + 1)
    return np.array(low + [low[-1] * DEN // NUM + 1], np.int64)


def far(total: np.ndarray) -> np.ndarray:
    """Most tokens in which two linked sets differ, by the sum of their sizes."""
    return total * (DEN - NUM) // (DEN + NUM)


def segments(top: np.ndarray) -> np.ndarray:
    """Segments of the universe for a band with this largest size: enough for the largest difference and the empty ones."""
    return top * 42 // 100 + 3


class Signatures:
    """Keys of many sets.

    The hash universe is cut into equal segments, more of them than linked sets can differ in, so
    linked sets agree on whole segments.  Each set indexes its subset of every segment of its own
    size band and probes with the same; it also probes the next lower band, cut as that band is.
    Where a set has too few non-empty segments, its segments count for two by one-deletion
    neighbourhoods (small bands), and if that isn't enough, it is paired with all sets of the sizes
    it could link with.
    """

    def __init__(self, doc: np.ndarray, value: np.ndarray, n_docs: int):
        self.doc, self.value, self.n_docs = doc, value, n_docs
        self.size = np.bincount(doc, minlength=n_docs)
        self.floor = bands(int(self.size.max(initial=1)))
        self.band = np.searchsorted(self.floor, self.size, "right") - 1  # -1: empty
        self.token = mix(value ^ U64(0x5BF03635F0A31E99))
        self.slot: list[np.ndarray] = []
        self.key: list[np.ndarray] = []
        self.flag: list[np.ndarray] = []
        self.total_ok = np.zeros(n_docs, bool)
        self.own = self._scheme(0)
        self.low = self._scheme(1)
        some = np.flatnonzero(self.size > 0)
        self._add(some, self._size_keys(self.band[some], self.size[some]), INDEX)
        self.slots, self.keys, self.flags = (np.concatenate(x) for x in (self.slot, self.key, self.flag))

    def _add(self, slot: np.ndarray, key: np.ndarray, flag: int) -> None:
        self.slot.append(slot)
        self.key.append(key)
        self.flag.append(np.full(len(slot), flag, np.int8))

    @staticmethod
    def _size_keys(band: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(mix(band.astype(U64) + U64(0x51AB5)) ^ (size.astype(U64) * U64(0xC2B2AE3D27D4EB4F)))

    def _scheme(self, down: int) -> np.ndarray:
        """Adds the keys of a set's own band (0) or the band below (1); returns the segments that each set has to spare."""
        band = self.band - down
        top = np.where(band >= 0, self.floor[np.maximum(band, 0) + 1] - 1, 0)
        low = self.floor[np.maximum(band, 0)]
        least = -(-self.size * NUM // DEN)
        active = (self.size > 0) & (band >= 0) & (least <= top)
        need = far(self.size + np.minimum(self.size, top)) + 1
        m = segments(top)
        pick = active[self.doc]
        doc, value, token = self.doc[pick], self.value[pick], self.token[pick]
        if not len(doc):
            return np.zeros(self.n_docs, np.int64)
        segment = ((value >> U64(32)) * m[doc].astype(U64) >> U64(32)).astype(np.int64)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (segment[1:] != segment[:-1])
        first = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        size = np.diff([*first, len(doc)])
        subset = np.add.reduceat(token, first)
        owner = doc[first]
        salt = mix((band[owner].astype(U64) << U64(32)) + segment[first].astype(U64) + U64(1))
        self._add(owner, mix(subset ^ salt), PROBE if down else INDEX | PROBE)
        filled = np.bincount(owner, minlength=self.n_docs)
        small = top <= SMALL
        without = subset[which] - token
        if not down:
            third = small[doc] & (size[which] >= 3)
            self._add(doc[third], mix(without[third] ^ salt[which[third]]), INDEX)
        short = active & (filled < need)
        if short.any():
            self.total_ok |= short
            pair = short[doc] & small[doc] & (size[which] >= 2)
            self._add(doc[pair], mix(without[pair] ^ salt[which[pair]]), PROBE)
            reach = filled + np.where(small, np.bincount(owner[size >= 2], minlength=self.n_docs), 0)
            for slot in np.flatnonzero(short & (reach < need)):
                sizes = np.arange(max(low[slot], least[slot]), min(top[slot], self.size[slot]) + 1)
                self._add(np.full(len(sizes), slot), self._size_keys(np.full(len(sizes), band[slot]), sizes), PROBE)
        return np.where(active, filled - need, 0)


def _deal(plain: DataFrame, buckets: int) -> DataFrame:
    """Rows of keys, facts and copies of every document, by bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[tuple[int, int], int] = {}
        ids: list[int] = []
        facts: list[tuple] = []
        follow: list[tuple[int, int, int]] = []
        keys: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            docs = np.array(ids, np.int64)
            rows = []
            if keys:
                slot, key, flag = (np.concatenate(x) for x in zip(*keys))
                rows += pack_keys(docs, slot, key, flag, buckets, KEYS)
            for kind, table, place in (
                (INFO, np.array([(s, ids[k], *rest) for k, (s, *rest) in enumerate(facts)], INFO_TYPE), "set"),
                (FOLLOW, np.array([(d, n, d if k < 0 else ids[k]) for d, n, k in follow], FOLLOW_TYPE), "doc"),
            ):
                target = (mix(table[place].astype(np.int64).view(U64)) % U64(buckets)).astype(np.int64)
                order = np.argsort(target, kind="stable")
                cuts = np.flatnonzero(np.diff(target[order])) + 1
                rows += [(int(target[part[0]]), kind, table[part].tobytes()) for part in np.split(order, cuts) if len(part)]
            return dealt_batch(rows)

        for batch in steps(batches):
            doc_ids = integers(batch, "doc_id")
            data, at = utf8(batch.column(1))
            doc, value = shingle_sets(data, at)
            n = np.bincount(doc, minlength=len(doc_ids))
            sums = np.zeros(len(doc_ids), U64)
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
            sums[doc[first]] = np.add.reduceat(mix(value ^ U64(0x2545F4914F6CDD1D)), first) if len(doc) else U64(0)
            fresh, slot_of = np.zeros(len(doc_ids), bool), np.zeros(len(doc_ids), np.int64)
            for k, (d, size, total) in enumerate(zip(doc_ids.tolist(), n.tolist(), sums.tolist())):
                if not size:
                    follow.append((d, 0, -1))
                    continue
                slot = slots.setdefault((total, size), len(ids))
                if slot == len(ids):
                    ids.append(d)
                    fresh[k], slot_of[k] = True, slot
                else:  # a copy in this unit: it goes with the smallest of them
                    if d < ids[slot]:
                        ids[slot], d = d, ids[slot]
                    follow.append((d, size, slot))
            if fresh.any():
                new = np.cumsum(fresh) - 1
                pick = fresh[doc]
                signed = Signatures(new[doc[pick]], value[pick], int(fresh.sum()))
                base = slot_of[fresh]
                keys.append((base[signed.slots], signed.keys, signed.flags))
                held += len(signed.keys)
                facts += list(zip(sums[fresh].tolist(), n[fresh].tolist(), signed.own.tolist(), signed.low.tolist(), signed.total_ok.tolist()))
            if held >= UNIT_KEYS or len(follow) >= UNIT_KEYS:
                yield flush()
                slots, ids, facts, follow, keys, held = {}, [], [], [], [], 0
        if ids or follow:
            yield flush()

    return by_bucket(plain.mapInArrow(tidied(deal), DEALT), buckets)


FOUND = "kind int, doc long, n int, ref long, own int, low int, every int, list long, role int, members int, weight int"


def _lists(dealt: DataFrame) -> DataFrame:
    """Facts of documents (with the smallest copy as ref), copies, and members of every list of at least two documents.

    A list is what shares a key, with a prober and an indexed set among them.  Lists of a bucket with
    the same members in the same roles count as one, with a weight.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: dict[int, list[bytes]] = {KEYS: [], INFO: [], FOLLOW: []}
        bucket = 0
        for batch in batches:
            for b, kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                bodies[kind].append(body)
                bucket = b
        info = np.frombuffer(b"".join(bodies[INFO]), INFO_TYPE)
        if len(info):
            order = np.lexsort((info["doc"], info["n"], info["set"]))
            info = info[order]
            new = np.ones(len(info), bool)
            new[1:] = (info["set"][1:] != info["set"][:-1]) | (info["n"][1:] != info["n"][:-1])
            ref = info["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
            yield _found(len(info), kind=INFO, doc=info["doc"], n=info["n"], ref=ref, own=info["own"], low=info["low"], every=info["all"])
        follow = np.frombuffer(b"".join(bodies[FOLLOW]), FOLLOW_TYPE)
        if len(follow):
            yield _found(len(follow), kind=FOLLOW, doc=follow["doc"], n=follow["n"], ref=follow["leader"])
        doc, key, role = unpack_keys(bodies.pop(KEYS))
        if not len(key):
            return
        order = np.lexsort((doc, key))
        doc, key, role = doc[order], key[order], role[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        role = np.bitwise_or.reduceat(role, first)
        doc, key = doc[first], key[first]
        start, which = runs(key)
        size = np.diff([*start, len(key)])
        good = (size >= 2) & (np.bitwise_or.reduceat(role, start) == (INDEX | PROBE))
        # lists with the same members in the same roles
        sign = np.add.reduceat(mix(doc.astype(U64) * U64(4) + role.astype(U64)), start)
        _, pick, same = np.unique(sign[good], return_index=True, return_inverse=True)
        weight = np.bincount(same)
        chosen = np.flatnonzero(good)[pick]
        of_list = np.full(len(start), -1, np.int64)
        of_list[chosen] = np.arange(len(chosen))
        member = of_list[which]
        keep = np.flatnonzero(member >= 0)
        at = member[keep]
        name = (np.int64(bucket) << 46 | key[start[chosen]].astype(np.int64)) if len(chosen) else np.zeros(0, np.int64)
        for low in range(0, len(keep), 500_000):
            part, group = keep[low : low + 500_000], at[low : low + 500_000]
            yield _found(len(part), kind=KEYS, doc=doc[part], list=name[group], role=role[part], members=size[chosen][group], weight=weight[group])

    return dealt.mapInArrow(tidied(gather), FOUND)


def _found(rows: int, **columns) -> pa.RecordBatch:
    fields = [f.split() for f in FOUND.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64()}
    arrays = []
    for name, kind in fields:
        value = columns.get(name)
        if value is None:
            arrays.append(pa.nulls(rows, kinds[kind]))
        else:
            arrays.append(pa.array(np.broadcast_to(np.asarray(value), rows).astype(np.int32 if kind == "int" else np.int64)))
    return pa.RecordBatch.from_arrays(arrays, names=[f[0] for f in fields])


def _sets(plain: DataFrame, members: DataFrame) -> DataFrame:
    """(doc, tokens): the sorted shingle hashes of the documents named in ``members``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, at = utf8(batch.column(1))
            doc, value = shingle_sets(data, at)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            tokens = [value[a:b].astype("<u8").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], names=["doc", "tokens"])

    named = members.select(F.col("doc").alias("doc_id")).distinct()
    return written(plain.join(named, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tidied(build), "doc long, tokens binary"), "none")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by their exact intersection."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                good.append(links(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")))
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), "a")
    right = left.join(sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y")), "b")
    return written(right.select("a", "b", "x", "y").mapInArrow(tidied(check), "a long, b long").distinct())


def _allocated(found: DataFrame) -> DataFrame:
    """(list, doc, probe, index): members of the lists that somebody probes.

    A probing set needs one more segment than it may differ in.  Segments that nobody shares cost
    nothing and come first; the rest are taken from the shortest lists on.
    """
    facts = found.filter(F.col("kind") == INFO)
    entries = found.filter(F.col("kind") == KEYS).select("list", "doc", "role", "members", "weight")
    # several rows of one doc_id: the one with the least to spare decides
    spare = facts.filter("doc = ref").groupBy("doc").agg(F.min("own").alias("own"), F.min("low").alias("low"), F.max("every").alias("every"))
    probing = entries.filter(F.col("role") >= PROBE).join(spare, "doc").withColumn("up", F.col("role") == (INDEX | PROBE))
    scheme = Window.partitionBy("doc", "up")
    needed = F.sum("weight").over(scheme) - F.when(F.col("up"), F.col("own")).otherwise(F.col("low"))
    before = F.sum("weight").over(scheme.orderBy("members", "list").rowsBetween(Window.unboundedPreceding, -1))
    probing = probing.withColumn("needed", needed).withColumn("before", F.coalesce(before, F.lit(0)))
    chosen = written(probing.filter((F.col("every") == 1) | (F.col("before") < F.col("needed"))).select("list", "doc", F.lit(True).alias("probe")))
    lists = written(chosen.select("list").distinct())
    every = entries.join(lists, "list", "left_semi").join(spare.select("doc"), "doc", "left_semi").select("list", "doc", (F.col("role") % 2 == 1).alias("index"))
    joined = every.join(chosen, ["list", "doc"], "left").select("list", "doc", F.coalesce("probe", F.lit(False)).alias("probe"), "index")
    return written(joined.filter(F.col("probe") | F.col("index")))


def _across(crowds: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join groups of one crowd: documents outside its largest group are held against all its documents.

    Both sides are dealt in blocks of bounded bytes; each pair of blocks is a task of its own that
    returns as many links as join its groups, whatever the number of linked pairs.
    """
    state = crowds.select(F.col("node").alias("doc"), F.col("component").alias("crowd")).join(groups.select(F.col("node").alias("doc"), "component"), "doc", "left")
    state = written(state.select("doc", "crowd", F.coalesce("component", "doc").alias("component")))
    sizes = written(state.groupBy("crowd", "component").agg(F.count("*").alias("docs")))
    main = sizes.groupBy("crowd").agg(F.count("*").alias("groups"), F.max_by("component", F.struct("docs", -F.col("component"))).alias("main")).filter("groups > 1")
    mixed = state.join(written(main.select("crowd", "main")), "crowd").join(sets, "doc")
    mixed = written(mixed.select("crowd", "component", "doc", (F.col("component") != F.col("main")).alias("outside"), "tokens"), "none")
    weight = F.length("tokens")
    blocks = mixed.groupBy("crowd").agg(
        F.ceil(F.sum(F.when(F.col("outside"), weight).otherwise(0)) / OUTSIDE_BYTES).cast("int").alias("n_out"), F.ceil(F.sum(weight) / CROWD_BYTES).cast("int").alias("n_all")
    )
    dealt = mixed.join(written(blocks), "crowd")
    every = F.xxhash64("doc")
    mine = dealt.filter("outside").withColumn("o", F.pmod(every, "n_out").cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)))
    all_of = dealt.withColumn("m", F.pmod(every, "n_all").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)))
    columns = ["crowd", "o", "m", "component", "doc", "tokens"]
    both = mine.select(*columns, F.lit(True).alias("left")).unionByName(all_of.select(*columns, F.lit(False).alias("left")))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["left"]], rows[~rows["left"]]
        found = joining_links(_unpacked(a), a["component"].tolist(), _unpacked(b), b["component"].tolist())
        return pd.DataFrame({"a": a["doc"].to_numpy()[[x for x, _ in found]], "b": b["doc"].to_numpy()[[y for _, y in found]]})

    return both.groupBy("crowd", "o", "m").applyInPandas(join, "a long, b long")


def _unpacked(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(t, "<u8") for t in rows["tokens"]]


def links(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets share NUM / DEN of their union."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or len(x) * DEN < len(y) * NUM:
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both * DEN >= NUM * (len(x) + len(y) - both)


def joining_links(left: list[np.ndarray], left_group: list[int], right: list[np.ndarray], right_group: list[int], rows: int = 16) -> list[tuple[int, int]]:
    """Linked (left, right) places that join groups, until no linked pair lies in two of them.

    Pairs are sifted by parity sketches: the bits in which two sketches differ are never more than
    the tokens in which the sets differ.  What is left is compared token by token.
    """
    sizes = [len(s) for s in left + right]
    bits = 1 << min(16, max(8, (4 * max(sizes, default=1) - 1).bit_length()))
    shift = U64(64 - (bits.bit_length() - 1))
    sketch = lambda s: np.packbits((np.bincount((s >> shift).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(U64)
    a, b = np.stack([sketch(s) for s in left]), np.stack([sketch(s) for s in right])
    n_a, n_b = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    parent: dict[int, int] = {}

    def find(g: int) -> int:
        while parent.get(g, g) != g:
            g = parent[g]
        return g

    found = []
    of_b = np.array(right_group)
    for low in range(0, len(a), rows):
        apart = np.bitwise_count(a[low : low + rows, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
        near = (apart * (DEN + NUM) <= (n_a[low : low + rows, None] + n_b[None, :]) * (DEN - NUM)) & (np.array(left_group[low : low + rows])[:, None] != of_b[None, :])
        for x, y in zip(*np.nonzero(near)):
            g, h = find(left_group[low + x]), find(right_group[y])
            if g != h and links(left[low + x], right[y]):
                parent[max(g, h)] = min(g, h)
                found.append((low + int(x), int(y)))
    return found


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Two documents link when they share at least 3/4 of the union of their distinct 5-word shingles.
    Null texts and texts without words have no shingles and link with nothing.  Rows of one doc_id
    are one node that has the links of all of them; rows without doc_id keep a null component_id;
    an empty table gives no rows.

    Links are verified on whole sets.  Every document is first compared with the smallest one of its
    lists.  Documents that share lists, directly or through others, are a crowd; in a crowd that
    isn't one group by then, the documents outside its largest group are compared with all of it.
    So groups lose no link, and no list is expanded into all its pairs.
    """
    plain = texts(docs, doc_id, text)
    known = plain.filter("doc_id is not null")
    found = written(_lists(_deal(known, part_count(known))))
    members = _allocated(found)
    sets = _sets(known, members)

    facts = found.filter(F.col("kind") == INFO).select("doc", "n", "ref")
    copies = found.filter(F.col("kind") == FOLLOW).select("doc", "n", F.col("ref").alias("leader"))
    refs = written(facts.groupBy(F.col("doc").alias("leader")).agg(F.min("ref").alias("ref")))
    rows = written(facts.unionByName(copies.join(refs, "leader", "left").select("doc", "n", F.coalesce("ref", "leader").alias("ref"))))
    # several rows of one doc_id hold its texts together
    repeated = rows.filter("n > 0").groupBy("doc").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc")
    pooled = rows.filter("n > 0 and doc <> ref").join(repeated, "doc").select(F.least("doc", "ref").alias("a"), F.greatest("doc", "ref").alias("b"))

    leader = written(members.groupBy("list").agg(F.min("doc").alias("a")))
    first = members.join(leader, "list").groupBy(F.col("doc").alias("b")).agg(F.min("a").alias("a")).filter("a <> b")
    linked = written(_verified(first.select("a", "b"), sets).unionByName(pooled.distinct()))
    crowds = components(members.join(leader, "list").select(F.col("doc").alias("b"), "a").filter("a <> b").distinct())
    more = _across(crowds, components(linked), sets)
    groups = components(linked.unionByName(more))

    placed = rows.join(groups.select(F.col("node").alias("ref"), "component"), "ref", "left")
    out = placed.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "ref").alias("component_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            doc, _ = shingle_sets(*utf8(batch.column(1)))
            n = np.bincount(doc, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.nulls(len(n), pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    nameless = plain.filter("doc_id is null").mapInArrow(tidied(count), "doc_id long, n_shingles long, component_id long")
    return out.unionByName(nameless)
