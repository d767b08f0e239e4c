"""Near-duplicate documents by an inverted join over MinHash coordinates, confirmed on full shingle sets.

1. Texts with equal shingle sets are one node.  Every node has COORDS MinHash values; (coordinate, value) pairs are
   the inverted index.  An exchange tells which pairs are posted by one node alone; a node with fewer than
   `matches` shared pairs can have no partner and drops out (most texts do).
2. Prefix: two nodes that agree in `matches` coordinates share one of the first r - matches + 1 of their r shared
   pairs in a common order, so only these are posted.
3. Bound: a second exchange counts how many of a node's shingles any other remaining node has.  A partner shares no
   more than these, so `s` shared of `n` shingles allow partners of at most s * (1 + 1/similarity) - n shingles.
   This is exact, and in a large group of copies it closes most that are too far from the original.
4. Skip merging: a posting list is never expanded into all its pairs.  First its nodes are compared with one hub, the
   node with the largest shared part; then with one such node of every other larger component in the list.
   Agreements are counted, and those of `matches` or more confirmed on the full sets.  Confirmed links merge
   components, and a list whose nodes are all in one is skipped from then on.
5. What is left are pairs between components.  Two nodes that were compared with the same hub either share a shingle that
   the hub lacks, and meet under it, or share no more than each shares with the hub, which bounds their sizes as in 3.
   The other pairs meet in their lists, by size class.  All of these are compared, so no link between components is lost.

With COORDS = 128, a pair of similarity 0.85 agrees in 109 coordinates on average (deviation 4.0); at 88 it is
missed with a chance under one in a million.  At 0.8, `matches` is 80.

Cases: null and empty texts have empty sets and link with nothing; a text with fewer words than a shingle has its
whole sequence as one; a null id takes no part (its component is null and it is kept); rows that share
an id are one document with several texts, and repeated rows one row each; where ids tie for a component the least one names it; an
empty table gives an empty result; extra columns are ignored.  A text of any length is compared whole; one longer than a block is
a block of its own.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.components import components
from loomspark.llm.exchange import BLOB, SMALL_BLOCK, Keys, answer, bucketed, discard, each_block, kept, text_blocks, with_replies
from loomspark.llm.text import Words, mix, span_hashes, tidy

COORDS = 128
#: Cells over which a hub's pairs are dealt.
SALTS = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 32, COORDS, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, COORDS, np.uint32)
_COORD, _NODE, _INFO = 0, 1, 9


def matches_for(percent: int) -> int:
    """Agreements that a pair of this similarity reaches but for about one in a million."""
    p = percent / 100
    return max(1, int(COORDS * p - 5.1 * (COORDS * p * (1 - p)) ** 0.5))


class _Block:
    """Shingle sets and signatures of a block's distinct sets."""

    def __init__(self, row: dict, shingle: int):
        lens = np.frombuffer(row["lens"], np.int64)
        words = Words(_LOWER[np.frombuffer(row["data"], np.uint8)], lens)
        h = words.hashes()
        runs = span_hashes(h, shingle)
        ok = words.doc[: len(runs)] == words.doc[shingle - 1 :][: len(runs)] if len(runs) else np.zeros(0, bool)
        runs, doc = runs[ok], words.doc[: len(runs)][ok]
        first = np.searchsorted(doc, np.arange(len(lens) + 1))
        self.n = np.zeros(len(lens), np.int64)
        self.keys: list[bytes] = [b""] * len(lens)
        self.sets: dict[bytes, np.ndarray] = {}
        for d in range(len(lens)):
            if first[d] < first[d + 1]:
                own = np.unique(runs[first[d] : first[d + 1]])
            elif words.count[d]:
                few = h[words.first[d] : words.first[d + 1]]
                own = few[:1]
                for x in few[1:]:
                    own = mix(own, x)
                own = mix(own, np.uint64(len(few)))
            else:
                continue
            self.n[d] = len(own)
            self.keys[d] = key = xxhash.xxh3_128_digest(own.tobytes())
            self.sets.setdefault(key, own)
        self.nodes = list(self.sets)

    def signatures(self) -> np.ndarray:
        """nodes x COORDS."""
        out = np.empty((len(self.nodes), COORDS), np.uint32)
        if self.nodes:
            sets = [self.sets[k] for k in self.nodes]
            starts = np.cumsum([0, *map(len, sets[:-1])])
            x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
            t = np.empty_like(x)
            for c in range(COORDS):
                np.multiply(x, _A[c], out=t)
                np.add(t, _B[c], out=t)
                out[:, c] = np.minimum.reduceat(t, starts)
        return out

    def node_keys(self, bits: int) -> Keys:
        pairs = np.frombuffer(b"".join(self.nodes), np.uint64).reshape(-1, 2)
        return Keys(pairs[:, 0].copy(), pairs[:, 1].copy(), bits, False)


def hub_side(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """pairs (u, v) with what `about` tells of v.

    A hub may be in a third of all pairs.  Its pairs are dealt by a hash of u over SALTS cells, and its row goes once to each cell that
    has any, so no task gets a hub's pairs whole, and no row goes to more cells than it has pairs.
    """
    dealt = pairs.withColumn("cell", F.pmod(F.xxhash64("u"), F.lit(SALTS)))
    cells = dealt.select("v", "cell").distinct()
    return dealt.join(about.join(cells, "v").repartition("v", "cell"), ["v", "cell"]).drop("cell")


def tokens(sig: np.ndarray) -> np.ndarray:
    """A 64-bit number of every (coordinate, value) pair."""
    return mix(sig.astype(np.uint64), np.arange(sig.shape[1], dtype=np.uint64)[None, :])


PACKED = "shard long, block long, nodes binary, sizes binary, sig binary, shingles binary, posts array<array<long>>"
NODES = "node binary, n long, s long, shingles binary, shared binary, posts array<long>, brief binary"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (least id of the documents linked directly or through others) and kept for every row."""
    need = matches_for(percent)
    blocks = text_blocks(docs, id_col, text_col, SMALL_BLOCK)
    bits = blocks.bits_for(blocks.total / 4)
    cols = ["shard", "block", "ids", "lens", "data"]
    info = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary())])

    def emit(row: dict) -> Iterator[pa.RecordBatch]:
        b = _Block(row, shingle)
        told = (row["shard"], row["block"], 0, _INFO, len(b.keys), b"".join(k.ljust(16, b"\0") for k in b.keys), b.n.tobytes())
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip(told, info, strict=True)], schema=info)
        if b.nodes:
            t = tokens(b.signatures()).ravel()
            yield from Keys(t, mix(t, np.uint64(1)), bits, True).blobs(row["shard"], row["block"], _COORD)
            yield from b.node_keys(bits).blobs(row["shard"], row["block"], _NODE)

    blobs = kept(each_block(blocks.table.select(cols), emit, BLOB), "posts")
    replies = answer(blobs.where(F.col("kind") != _INFO), {_COORD}, bits)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = [r["keys"][i : i + 16] if n else None for i, n in zip(range(0, len(r["keys"]), 16), np.frombuffer(r["owners"], np.int64), strict=True)]
                yield pa.record_batch([pa.array(r["ids"], pa.int64()), pa.array(np.frombuffer(r["owners"], np.int64)), pa.array(keys, pa.binary())], names=["doc_id", "n_shingles", "node"])

    of_block = blobs.where(F.col("kind") == _INFO).select("block", "keys", "owners").join(blocks.table.select("block", "ids"), "block")
    rows = kept(of_block.select("ids", "keys", "owners").mapInArrow(tidy(unpack), "doc_id long, n_shingles long, node binary"), "rows")

    def survive(row: dict) -> Iterator[pa.RecordBatch]:
        b = _Block(row, shingle)
        if not b.nodes:
            return
        heard = row["replies"] or []
        sig = b.signatures()
        t = tokens(sig)
        keys = Keys(t.ravel(), mix(t.ravel(), np.uint64(1)), bits, True)
        shared = (keys.reply(heard, _COORD) | keys.twice)[keys.place].reshape(t.shape)
        own = b.node_keys(bits)
        later = own.reply(heard, _NODE, "later")[own.place]
        alive = np.flatnonzero((shared.sum(1) >= need) & ~later)
        if not len(alive):
            return
        posts = []
        for i in alive:
            mine = np.sort(t[i][shared[i]])
            posts.append(mine[: len(mine) - need + 1].view(np.int64).tolist())
        sets = [b.sets[b.nodes[i]] for i in alive]
        yield pa.record_batch([pa.array([row["shard"]], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([b"".join(b.nodes[i] for i in alive)], pa.binary()), pa.array([np.array([len(x) for x in sets], np.int64).tobytes()], pa.binary()), pa.array([sig[alive].tobytes()], pa.binary()), pa.array([np.concatenate(sets).tobytes()], pa.binary()), pa.array([posts], pa.list_(pa.list_(pa.int64())))], names=["shard", "block", "nodes", "sizes", "sig", "shingles", "posts"])

    packed = bucketed(each_block(with_replies(blocks.table.select(cols), replies), survive, PACKED), "packed", "shard", blocks.shards)
    discard(blocks.table, blobs)

    def shingle_keys(row: dict) -> Keys:
        h = np.frombuffer(row["shingles"], np.uint64)
        return Keys(mix(h, np.uint64(9)), h, bits, True)

    def emit_shingles(row: dict) -> Iterator[pa.RecordBatch]:
        yield from shingle_keys(row).blobs(row["shard"], row["block"], _COORD)

    met = answer(each_block(packed.select("shard", "block", "shingles"), emit_shingles, BLOB), {_COORD}, bits)

    def unpack_nodes(row: dict) -> Iterator[pa.RecordBatch]:
        keys, sizes = shingle_keys(row), np.frombuffer(row["sizes"], np.int64)
        shared = (keys.reply(row["replies"] or [], _COORD) | keys.twice)[keys.place]
        ends = np.cumsum(sizes)
        s = np.add.reduceat(shared.astype(np.int64), ends - sizes)
        cut = lambda x, width: [x[a * width : e * width] for a, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        each = lambda x, width: [x[i * width : (i + 1) * width] for i in range(len(sizes))]
        yield pa.record_batch([pa.array(each(row["nodes"], 16), pa.binary()), pa.array(sizes), pa.array(s), pa.array(cut(row["shingles"], 8), pa.binary()), pa.array([np.packbits(shared[a:e]).tobytes() for a, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], pa.binary()), pa.array(row["posts"], pa.list_(pa.int64())), pa.array(each(row["sig"][::4], COORDS), pa.binary())], names=["node", "n", "s", "shingles", "shared", "posts", "brief"])

    nodes = bucketed(each_block(with_replies(packed, met), unpack_nodes, NODES).repartition(blocks.shards, "node"), "nodes", "node", blocks.shards)
    discard(packed)
    share = percent / 100
    # What a partner may have at most; a little more than the exact bound, for rounding.
    most = F.floor(F.col("s") * (1 + 1 / share) - F.col("n") + 1e-6)
    nodes_open = nodes.where(most >= F.ceil(F.col("n") * share - 1e-6))
    posted = nodes_open.select(F.explode("posts").alias("token"), "node", "n", most.alias("most"), (F.col("s") / F.col("n")).alias("part"))
    lists = posted.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    posted = kept(posted.join(lists.select("token"), "token"), "postings")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, shared, rest = [], [], []
            for n, m, xa, xb, met_a in zip(*(batch.column(c) for c in ("n_u", "n_v", "set_u", "set_v", "shared_u")), strict=True):
                n, m = n.as_py(), m.as_py()
                x, y = np.frombuffer(xa.as_buffer(), np.uint64), np.frombuffer(xb.as_buffer(), np.uint64)
                inside = np.zeros(n, bool)
                at = np.searchsorted(y, x)
                inside[at < m] = y[at[at < m]] == x[at < m]
                both = int(inside.sum())
                linked.append(100 * both >= percent * (n + m - both))
                shared.append(both)
                met = np.unpackbits(np.frombuffer(met_a.as_buffer(), np.uint8), count=n).astype(bool)
                rest.append(x[~inside & met].view(np.int64))
            yield pa.record_batch([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_()), pa.array(shared, pa.int64()), batch.column("part_v"), pa.array(rest, pa.list_(pa.int64()))], names=["u", "v", "linked", "shared", "part", "rest"])

    def compare(pairs: DataFrame) -> DataFrame:
        """linked, shared shingles, v's shared part, and u's shingles that v lacks but some other node has, for pairs (u, v).

        The nodes are bucketed, so only pairs move: first the v that are needed are looked up and joined, then the pairs with
        v's set go to u.
        """
        side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("shingles").alias(f"set_{s}"), *((F.col("shared").alias("shared_u"),) if s == "u" else ((F.col("s") / F.col("n")).alias("part_v"),)))
        return kept(hub_side(pairs, side("v")).join(side("u"), "u").mapInArrow(tidy(confirm), "u binary, v binary, linked boolean, shared long, part double, rest array<long>"), "links")

    possible = (F.col("n") <= F.col("hub_most")) & (F.col("hub_n") <= F.col("most"))
    best = F.max_by(F.struct(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("most").alias("hub_most")), F.struct("part", "node")).alias("h")

    # Each list's nodes with its hub.
    tried = posted.join(posted.groupBy("token").agg(best).select("token", "h.*"), "token").where((F.col("node") != F.col("hub")) & possible)
    pairs = kept(tried.select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct(), "pairs")
    results = compare(pairs)
    links = results.where("linked").select("u", "v")
    def regroup(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of these postings, the lists that still have nodes of more than one component; and every node's hub.

        Of several hubs a node keeps the one that is most shared itself, so that a group of copies agrees on it.
        """
        hub_of = results.groupBy("u").agg(F.max_by(F.struct("v", "shared", "rest"), F.struct("part", "v")).alias("h"))
        hub_of = kept(hub_of.select(F.col("u").alias("node"), F.col("h.v").alias("via"), F.col("h.shared").alias("o"), F.col("h.rest").alias("rest")), "hubs")
        about = kept(components(links), "labels").join(hub_of.select("node", "via", "o"), "node", "full_outer")
        here = lists.drop("label", "via", "via_most", "o").join(about, "node", "left").withColumn("label", F.coalesce("label", "node"))
        here = here.withColumn("via_most", F.coalesce(F.floor(F.col("o") * (1 + 1 / share) - F.col("n") + 1e-6), F.lit(-1)))
        mixed = here.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
        return kept(here.join(mixed, "token"), "mixed"), hub_of

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDS) for c in ("brief_u", "brief_v"))
            keep = batch.filter(pa.array((a == b).sum(1) >= need))
            yield pa.record_batch([keep.column("u"), keep.column("v")], names=["u", "v"])

    def settle(found: DataFrame) -> None:
        """Compares what hasn't been.  Only pairs whose signatures agree in the low byte of `matches` values, which all do that agree in the values, have their sets looked up."""
        nonlocal links, pairs, results
        low, high = F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")
        new = found.select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct().select("u", "v", low, high)
        new = kept(new.join(pairs.select(low, high).distinct(), ["low", "high"], "left_anti").select("u", "v"), "pairs")
        pairs = pairs.unionByName(new)
        brief = lambda x: nodes.select(F.col("node").alias(x), F.col("brief").alias(f"brief_{x}"))
        near = hub_side(new, brief("v")).join(brief("u"), "u").mapInArrow(tidy(agree), "u binary, v binary")
        got = compare(kept(near, "near"))
        results = results.unionByName(got)
        links = links.unionByName(got.where("linked").select("u", "v"))

    # Two nodes of one hub are left to the shingles they share beyond it, unless their sizes allow more.
    apart = F.coalesce(F.col("via") != F.col("hub_via"), F.lit(True)) | ((F.col("hub_n") <= F.col("via_most")) & (F.col("n") <= F.col("hub_via_most")))
    told = [F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("most").alias("hub_most"), F.col("via").alias("hub_via"), F.col("via_most").alias("hub_via_most")]

    # Its nodes with the best node of every other component that has several there.
    here, _ = regroup(posted)
    hubs = here.groupBy("token", F.col("label").alias("other")).agg(F.max_by(F.struct(*told), F.struct("part", "node")).alias("h"), F.count(F.lit(1)).alias("members")).where("members > 1").select("token", "other", "h.*")
    settle(here.join(hubs, "token").where((F.col("label") != F.col("other")) & possible & apart))

    # All pairs left.  The larger set looks for smaller ones in the few size classes that its bound leaves.
    here, hub_of = regroup(here)
    size = lambda x: F.floor(F.log(x.cast("double")) / np.log(1.02)).cast("int")
    low, high = size(F.ceil(F.col("n") * share - 1e-6)), size(F.least("n", "most"))
    asks = here.where(high >= low).withColumn("class", F.explode(F.sequence(low, high)))
    others = here.select("token", F.col("label").alias("other"), *told, size(F.col("n")).alias("class"))
    by_size = asks.join(others, ["token", "class"]).where((F.col("label") != F.col("other")) & possible & (F.col("hub_n") <= F.col("n")) & apart)
    once = here.select("node", "label", "n", "most").distinct()
    beyond = once.join(hub_of.select("node", "via", "rest"), "node").select(*once.columns, "via", F.explode("rest").alias("shingle"))
    meet = beyond.groupBy("via", "shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("via", "shingle")
    beyond = kept(beyond.join(meet, ["via", "shingle"]), "beyond")
    other = beyond.select("via", "shingle", F.col("label").alias("other"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("most").alias("hub_most"))
    by_shingle = beyond.join(other, ["via", "shingle"]).where((F.col("label") < F.col("other")) & possible)
    settle(by_size.select("node", "hub").unionByName(by_shingle.select("node", "hub")))

    known = rows.where("doc_id is not null and node is not null")
    several = known.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("high")).where("v <> high").select("doc_id", "v")
    of_id = known.join(several, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v")
    labels = kept(components(links.unionByName(of_id)), "labels")
    discard(nodes)
    # Ids, not rows, are linked: an id's texts belong together.
    least = known.groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    top = least.groupBy("label").agg(F.min("least").alias("component"))
    of_node = least.join(top, "label").select("node", "component")
    out = rows.join(of_node, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
