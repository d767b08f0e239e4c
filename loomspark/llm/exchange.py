"""Blocks of documents and an exchange of hashed keys between them.

The two exact duplicate finders (and the collision counts of the near-duplicate join) ask one
question again and again: which of my keys occurs elsewhere?  A row for each key would shuffle
tens of bytes per position of the corpus.  Here each block instead sends one binary value per bucket of
the key space, the distinct keys that fall there, and gets back one bit per key, in that order.
So a round costs the bare key bytes plus an eighth of a byte.

What grows with the corpus: the number of blocks, and up to MOST_BITS the number of buckets.  Both bounds of a
blob's size hold it between them: a bucket is only split while a block still sends LEAST_BLOB bytes to each, and blocks
themselves grow up to BLOCK_GROWTH times with the number of scan tasks, so a block sends at most 2**MOST_BITS blobs and the rows of a
round grow in proportion to the corpus.  A bucket that is larger than a task should sort at once is sorted
range by range inside its task.

Blocks are written once to a bucketed table in the shared folder, so that the replies join them without
shuffling the texts again, and a lost executor only costs a reread.  All blocks of a scan task are one bucket (a
shard): one file, read by one task, whatever the session's number of shuffle partitions is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.text import BLOCK_BYTES, bounded, slices, text_bytes, tidy

#: Key bytes that one bucket holds about, and those that a block sends to a bucket at least where there are more than LEAST_BITS.
BUCKET_BYTES, LEAST_BLOB = 8 << 20, 512
LEAST_BITS, MOST_BITS = 4, 14
#: Keys that a task sorts at once.
SORT_AT_ONCE = 8 << 20
#: Scan tasks at which blocks begin to grow, and how far.
GROW_FROM, BLOCK_GROWTH = 512, 8
MOST_SHARDS = 20_000
#: Bytes of a block in op8 and op9, which hold many numbers for each word: a worker of theirs and the JVM's copies of its rows take the less memory.
SMALL_BLOCK = 1 << 20
BLOB = "shard long, block long, bucket int, kind int, n long, keys binary, owners binary"
#: The kind of a blob that only says that its block takes part; see has_any().
ALIVE = -1
REPLY = "shard long, block long, bucket int, kind int, bits binary, later binary"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/loomspark"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.loomspark_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As kept(), bucketed by a key, so that joins on it don't shuffle this side; it is a table of the catalog until discard()."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out.loomspark_table, out.loomspark_path = table, path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what kept() or bucketed() wrote, once all that reads it has itself been written."""
    for df in tables:
        spark = df.sparkSession
        if hasattr(df, "loomspark_table"):
            spark.sql(f"DROP TABLE IF EXISTS {df.loomspark_table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df.loomspark_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shard_labels(spark: SparkSession, buckets: int) -> np.ndarray:
    """For every bucket of a table a number that is written to it: the least of those that hash there."""
    tried = spark.range(32 * buckets).select("id", F.pmod(F.hash("id"), F.lit(buckets)).alias("bucket"))
    found = {r.bucket: r.id for r in tried.groupBy("bucket").agg(F.min("id").alias("id")).collect()}  # a row for each bucket
    return np.array([found.get(b, b) for b in range(buckets)])


@dataclass
class Blocks:
    """A bucketed table of (shard, block, size, ids, lens, data) and what is known of it."""

    table: DataFrame
    total: int
    count: int
    shards: int

    def bits_for(self, key_bytes: float) -> int:
        """log2 of the number of buckets for so many key bytes in all."""
        wanted = np.log2(max(1.0, key_bytes / BUCKET_BYTES))
        sent = np.log2(max(1.0, key_bytes / max(1, self.count) / LEAST_BLOB))
        return int(np.clip(np.ceil(min(wanted, sent)), LEAST_BITS, MOST_BITS))


def text_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Packs documents into blocks of block_bytes (up to BLOCK_GROWTH times as much in a large corpus); a document that is longer than a block is one of its own."""
    spark = docs.sparkSession
    plain = bounded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    tasks = plain.rdd.getNumPartitions()
    shards = max(1, min(tasks, MOST_SHARDS), int(spark.conf.get("spark.sql.shuffle.partitions")))  # fewer, and a join would shuffle the texts
    labels = shard_labels(spark, shards)
    most = block_bytes * max(1, min(BLOCK_GROWTH, tasks // GROW_FROM))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            data, lens = np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting])
            ids = pa.concat_arrays([w[0] for w in waiting])
            out = pa.record_batch({"shard": pa.array([labels[part % shards]], pa.int64()), "block": pa.array([part << 32 | seq], pa.int64()), "size": pa.array([len(data)], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "lens": pa.array([lens.astype(np.int64).tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})
            seq, size = seq + 1, 0
            waiting.clear()
            return out

        for batch in batches:
            for piece in slices(batch, "text", most):
                data, lens = text_bytes(piece.column("text"))
                if waiting and size + len(data) > most:
                    yield flush()
                waiting.append((piece.column("id"), data, lens))
                size += len(data)
        if waiting:
            yield flush()

    packed = plain.mapInArrow(tidy(pack), "shard long, block long, size long, ids array<long>, lens binary, data binary")
    table = bucketed(packed, "blocks", "shard", shards)
    total, count = table.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    return Blocks(table, total, count, shards)


class Keys:
    """A block's distinct keys of one kind, in the order in which replies come back.

    `where` (64 bits) picks the bucket and the order; `what` is compared inside the bucket.  A narrow exchange keeps the top 32
    bits of `what`, which may take different keys for equal and so suits filters only; a wide one keeps
    all.  Where the two are independent hashes, keys are told apart by 64 bits and the bucket's between blocks, and by 128 inside a block.
    owners: with each key, a document id.
    """

    def __init__(self, where: np.ndarray, what: np.ndarray, bits: int, narrow: bool, owners: np.ndarray | None = None):
        what = (what >> np.uint64(32)).astype(np.uint32) if narrow else what
        order = np.argsort(where) if owners is None else np.lexsort((owners, where))
        where, what = where[order], what[order]
        new = np.ones(len(order), bool)
        new[1:] = where[1:] != where[:-1]
        other = what[1:] != what[:-1]
        if (other & ~new[1:]).any():  # keys that only `what` tells apart: they go into an order of their own
            again = np.lexsort((what, where)) if owners is None else np.lexsort((owners[order], what, where))
            order, where, what = order[again], where[again], what[again]
            new[1:], other = where[1:] != where[:-1], what[1:] != what[:-1]
        new[1:] |= other
        self.owners = None
        if owners is not None:
            own = owners[order]
            new[1:] |= own[1:] != own[:-1]
            self.owners = own[new]
        self.place = np.empty(len(order), np.int64)  # of each given key among the distinct ones
        self.place[order] = np.cumsum(new) - 1
        self.where, self.what = where[new], what[new]
        self.twice = np.bincount(self.place, minlength=len(self.what)) > 1
        self.cuts = np.searchsorted(self.where, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        self.cuts = np.concatenate([[0], self.cuts, [len(self.where)]])

    def blobs(self, shard: int, block: int, kind: int) -> Iterator[pa.RecordBatch]:
        """One batch of blobs, a row for each bucket that has keys; none without keys."""
        some = np.flatnonzero(np.diff(self.cuts))
        if len(some):
            n = np.diff(self.cuts)[some]
            ends = np.append(0, self.cuts[some + 1])

            def binary(values: np.ndarray) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

            same = lambda x, t: pa.array(np.full(len(some), x), t)
            owners = pa.nulls(len(some), pa.binary()) if self.owners is None else binary(self.owners)
            yield pa.record_batch([same(shard, pa.int64()), same(block, pa.int64()), pa.array(some, pa.int32()), same(kind, pa.int32()), pa.array(n, pa.int64()), binary(self.what), owners], names=["shard", "block", "bucket", "kind", "n", "keys", "owners"])

    def reply(self, replies: list[dict], kind: int, field: str = "bits") -> np.ndarray:
        """The answer for each distinct key; False where none came."""
        out = np.zeros(len(self.what), bool)
        for r in replies:
            if r["kind"] == kind:
                s, e = self.cuts[r["bucket"]], self.cuts[r["bucket"] + 1]
                out[s:e] = np.unpackbits(np.frombuffer(r[field], np.uint8), count=e - s).astype(bool)
        return out


def alive(shard: int, block: int) -> pa.RecordBatch:
    """A blob that says that a block has keys."""
    row = {"shard": (shard, pa.int64()), "block": (block, pa.int64()), "bucket": (0, pa.int32()), "kind": (ALIVE, pa.int32()), "n": (0, pa.int64()), "keys": (b"", pa.binary()), "owners": (None, pa.binary())}
    return pa.record_batch([pa.array([v], t) for v, t in row.values()], names=list(row))


def has_any(replies: DataFrame) -> bool:
    """Whether any block sent alive() in this round."""
    return bool(replies.where(F.exists("replies", lambda r: r["kind"] == ALIVE)).head(1))


def shared_keys(what: np.ndarray, owners: np.ndarray | None, ranges: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of the keys of one bucket, laid end to end in the order of their blocks: which to report, and which aren't their key's first.

    To report are keys that are there twice, or with owners those of which a lower owner has the same.  More than
    SORT_AT_ONCE keys are sorted in ranges of their top bits, one after the other.
    """
    hit, late = np.zeros(len(what), bool), np.zeros(len(what), bool)
    width = what.dtype.itemsize * 8
    split = ranges or int(np.ceil(np.log2(max(1.0, len(what) / SORT_AT_ONCE))))
    top = (what >> what.dtype.type(width - split)).astype(np.int32) if split else None
    for r in range(1 << split):
        part = np.flatnonzero(top == r) if split else np.arange(len(what))
        if not len(part):
            continue
        order = part[np.argsort(what[part])]
        w = what[order]
        new = np.ones(len(w), bool)
        new[1:] = w[1:] != w[:-1]
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        late[order] = order != np.minimum.reduceat(order, starts)[group]
        if owners is None:
            hit[order] = (np.diff(np.append(starts, len(w))) > 1)[group]
        else:
            hit[order] = owners[order] > np.minimum.reduceat(owners[order], starts)[group]
    return hit, late


def answer(blobs: DataFrame, narrow: set[int], bits: int) -> DataFrame:
    """One row per shard with the replies to its blocks' keys.

    bits: for plain keys, whether the key came from another block too; with owners, whether an owner
    below this one sent the same key.  later: the key came from another block and this is not the first of them.
    Each task takes its buckets one by one: they come sorted.
    """

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        shards, blocks, bucket, kind = [r[0] for r in rows], [r[1] for r in rows], rows[0][2], rows[0][3]
        if kind == ALIVE:
            yield pa.record_batch([pa.array(v, t) for v, t in ((shards[:1], pa.int64()), (blocks[:1], pa.int64()), ([bucket], pa.int32()), ([kind], pa.int32()), ([None], pa.binary()), ([None], pa.binary()))], names=["shard", "block", "bucket", "kind", "bits", "later"])
            rows.clear()
            return
        what = np.concatenate([np.frombuffer(r[4], np.uint32 if kind in narrow else np.uint64) for r in rows])
        cuts = np.cumsum([0, *(len(r[4]) // what.itemsize for r in rows)])
        owners = np.concatenate([np.frombuffer(r[5], np.int64) for r in rows]) if rows[0][5] is not None else None
        rows.clear()
        hit, late = shared_keys(what, owners)
        some = np.add.reduceat(hit, cuts[:-1]) > 0
        told = np.flatnonzero(some).tolist()
        if told:
            full = owners is None and kind not in narrow
            bits_ = [np.packbits(hit[cuts[i] : cuts[i + 1]]).tobytes() for i in told]
            later = [np.packbits(late[cuts[i] : cuts[i + 1]]).tobytes() if full else None for i in told]
            yield pa.record_batch([pa.array([shards[i] for i in told], pa.int64()), pa.array([blocks[i] for i in told], pa.int64()), pa.array([bucket] * len(told), pa.int32()), pa.array([kind] * len(told), pa.int32()), pa.array(bits_, pa.binary()), pa.array(later, pa.binary())], names=["shard", "block", "bucket", "kind", "bits", "later"])

    def solve_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "bucket", "kind", "keys", "owners")), strict=True):
                if rows and rows[-1][2:4] != r[2:4]:
                    yield from solve(rows)
                rows.append(r)
        if rows:
            yield from solve(rows)

    dealt = blobs.select("shard", "block", "bucket", "kind", "keys", "owners").repartition(1 << bits, "bucket").sortWithinPartitions("bucket", "kind", "block")
    out = dealt.mapInArrow(tidy(solve_part), REPLY)
    return out.groupBy("shard").agg(F.collect_list(F.struct("block", "bucket", "kind", "bits", "later")).alias("replies"))


def with_replies(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Blocks with the replies to them (null if their shard has none)."""
    return blocks.join(replies, "shard", "left").withColumn("replies", F.filter("replies", lambda r: r["block"] == F.col("block")))


def merged(*replies: DataFrame) -> DataFrame:
    """The replies of several rounds, one row per shard."""
    every = replies[0]
    for r in replies[1:]:
        every = every.unionByName(r)
    return every.groupBy("shard").agg(F.flatten(F.collect_list("replies")).alias("replies"))


def each_block(blocks: DataFrame, work: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies a function to the rows of blocks one at a time."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from work(batch.slice(i, 1).to_pylist()[0])

    return blocks.mapInArrow(tidy(go), schema)
