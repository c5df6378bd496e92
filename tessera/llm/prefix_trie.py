"""The trie of conversations: a node for each distinct sequence of first turns.

1. **Dictionary.**  A turn is its role and text.  Distinct turns, told apart by the SHA-256 of both, get an integer id; conversations become arrays of ids.
2. **Distinct sequences.**  Conversations are sorted by sequence and id over all tasks and packed into blocks of ids, so a sequence that many have travels as few
   rows; one row a sequence remains, with its number of conversations, the smallest of them and the digest of all.
3. **Radix partitioning, most significant turn first.**  A bucket holds the sequences with a common prefix.  Buckets of more than ``LOCAL`` sequences go another round: their longest
   common prefix is a chain of nodes, and the turn behind it deals their sequences to new buckets.  Rounds only count and join, so no large bucket
   meets in one task.
4. **Multikey quicksort** finishes each small bucket where it lies, and emits the nodes below its prefix, with the sums over their subtrees.
5. Sums of small buckets and chains are added to all buckets above them by their paths.

Turns are ordered by number, nulls first, then by digest; null roles and texts are empty; turns without a conversation id belong to none.  Repeated rows are
repeated turns.  An empty table has no node.  Only the four named columns are read.  A conversation is one row of 12 bytes a turn, so the memory of a task is bounded by
``LOCAL`` conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import partitions, release, staged

#: Sequences that a bucket holds at most when one task finishes it.
LOCAL = 128
#: Conversation ids in one block.
BLOCK = 4096
#: Large buckets that are broadcast at most.
BROADCAST_BUCKETS = 10_000

_NONE = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NAMES = [f.split()[0] for f in _NODE.split(", ")]


def encoded_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, chars): each conversation's turns in order as ids of the dictionary, and the code points of their texts."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    key = F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256)
    slim = staged(turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), key.alias("key"), F.length(said).alias("chars")), "trie-turns")
    words = staged(slim.groupBy("key").agg(F.first("chars").alias("chars")).select("key", "chars", F.monotonically_increasing_id().alias("id")), "trie-dictionary")
    rows = slim.drop("chars").join(words, "key")
    # Nulls sort first; a digest decides between turns of one number.
    own = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), "key", "id", "chars")))
    return rows.groupBy("conv_id").agg(own.alias("own")).select("conv_id", F.col("own.id").alias("ids"), F.col("own.chars").alias("chars"))


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation ``c - c % every``, h from the CRC-32 of c."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = conversations.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head"), F.slice("ids", 1, most - 1).alias("head_ids"), F.slice("chars", 1, most - 1).alias("head_chars"))
    joined = conversations.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("head"), "left").withColumn("h", h)

    def mend(own: str, head: str):
        first = F.when(F.col("h") == 0, F.slice(own, 1, 0)).otherwise(F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.slice(own, 1, 0)))
        return F.concat(first, F.slice(own, F.col("h") + 1, F.greatest(F.size(own), F.lit(1)))).alias(own)

    return joined.select("conv_id", mend("ids", "head_ids"), mend("chars", "head_chars"))


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """(seq, n, conv_id, sha): each sequence of (id, chars) once, its conversations' number, the smallest, and the SHA-256 of all, comma-joined in order."""
    spark = conversations.sparkSession
    rows = conversations.select(F.arrays_zip("ids", "chars").alias("seq"), "conv_id")
    n = partitions(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([held[0]], pa.int64()), pa.array([held], pa.list_(pa.int64()))], ["seq", "first", "members"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for seq, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (len(held) >= BLOCK or seq != now):
                    yield block()
                    held = []
                now = seq
                held.append(conv)
        if held:
            yield block()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, n, first, kind = None, None, 0, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([n], pa.int64()), pa.array([first], pa.int64()), pa.array([running.hexdigest()])], ["seq", "n", "conv_id", "sha"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for seq, start, members in zip(*(c.to_pylist() for c in batch.columns)):
                if running is None or seq != now:
                    if running is not None:
                        yield done()
                    now, running, n, first = seq, hashlib.sha256(), 0, start
                elif n:
                    running.update(b",")
                running.update(",".join(map(str, members)).encode())
                n += len(members)
        if running is not None:
            yield done()

    kind = rows.schema["seq"].dataType.simpleString()
    # Ranges of (sequence, id) split a sequence that many conversations have, and blocks make few rows of it.
    ranged = staged(rows, "trie-rows").repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    blocks = ranged.mapInArrow(pack, f"seq {kind}, first long, members array<long>")
    return staged(blocks.repartition(n, "seq").sortWithinPartitions("seq", "first").mapInArrow(digest, f"seq {kind}, n long, conv_id long, sha string"), "trie-sequences")


def multikey_quicksort(rows: list[list[int]], depth: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The order of distinct sequences that share their first ``depth`` ids, and the nodes (first, end, depth) below them as ranges of that order.

    Three-way partitions by the id at one depth: what equals the pivot is a node and goes on one id deeper.  A stack takes the place of recursion.
    """
    order, nodes, todo = list(range(len(rows))), [], [(0, len(rows), depth)]
    while todo:
        a, b, d = todo.pop()
        if b - a == 1:
            nodes += [(a, b, k) for k in range(d + 1, len(rows[order[a]]) + 1)]
            continue
        at = [(rows[i][d] if d < len(rows[i]) else -1) for i in order[a:b]]
        pivot = sorted((at[0], at[len(at) // 2], at[-1]))[1]
        less, same, more = ([i for i, x in zip(order[a:b], at) if keep(x)] for keep in (lambda x: x < pivot, lambda x: x == pivot, lambda x: x > pivot))
        order[a:b] = less + same + more
        lo, hi = a + len(less), b - len(more)
        if lo > a:
            todo.append((a, lo, d))
        if b > hi:
            todo.append((hi, b, d))
        if pivot >= 0:
            nodes.append((lo, hi, d + 1))
            todo.append((lo, hi, d + 1))
    return order, nodes


def bucket_nodes(rows: list[tuple], depth: int, parent: int | None) -> list[tuple]:
    """All nodes of a bucket: its own prefix of ``depth`` turns and everything below.  Rows are (ids, chars, n, smallest conversation, digest)."""
    order, nodes = multikey_quicksort([r[0] for r in rows], depth)
    rows = [rows[i] for i in order]
    nodes.append((0, len(rows), depth))
    nodes.sort(key=lambda x: (x[0], x[2]))  # the first conversation's nodes from the top, so a subtree is a run
    members = [0, *accumulate(r[2] for r in rows)]
    # Nothing goes on behind a leaf's last turn: the next sequence in order doesn't start with it.
    leaf = [i + 1 == len(rows) or rows[i + 1][0][: len(r[0])] != r[0] for i, r in enumerate(rows)]
    leaves = [0, *accumulate(leaf)]
    smallest = []
    for a, b, _ in nodes:
        smallest.append(min(r[3] for r in rows[a:b]) if b - a > 1 else rows[a][3])
    worth = [0, *accumulate((members[b] - members[a] - 1) * (rows[a][1][d - 1] if d else 0) for a, b, d in nodes)]
    starts = np.array([a for a, _, _ in nodes])
    after = np.searchsorted(starts, [b for _, b, _ in nodes]).tolist()
    children, above, path = [0] * len(nodes), [None] * len(nodes), {}
    for k, (_, _, d) in enumerate(nodes):
        path[d] = k
        if d > depth:
            children[path[d - 1]] += 1
            above[k] = smallest[path[d - 1]]
        else:
            above[k] = parent
    # A node's subtree ends where the first node of a later range starts.
    return [(smallest[k], d, above[k], members[b] - members[a], children[k], leaves[b] - leaves[a], worth[after[k]] - worth[k], rows[a][4] if len(rows[a][0]) == d else _NONE)
            for k, (a, b, d) in enumerate(nodes)]


def trie_nodes(sequences: DataFrame, local: int = LOCAL) -> DataFrame:
    """All nodes of the trie of `distinct_sequences`."""
    spark = sequences.sparkSession
    n = partitions(spark)
    # up: the large bucket above, by the depth of its top node and its smallest conversation; path: all above; turn: what was dealt by.
    up = "struct<depth:int,conv_id:long>"
    live = sequences.withColumns({"up": F.lit(None).cast(up), "turn": F.lit(None).cast("long"), "top": F.lit(0), "parent": F.lit(None).cast("long"), "path": F.array().cast(f"array<{up}>")})
    small, chains, sums = [], [], []
    while True:
        stats = live.groupBy("up", "turn").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("first"), F.min(F.struct("seq", "sha")).alias("lowest"), F.max("seq").alias("highest"),
                                               F.first("top").alias("top"), F.first("parent").alias("parent"), F.first("path").alias("path"))
        same = F.zip_with("lowest.seq", "highest", lambda a, b: a["ids"].eqNullSafe(b["ids"]))
        shared = (F.array_position(same, False) - 1).cast("int")
        large = staged(stats.where(F.col("rows") > local).withColumn("shared", shared).withColumn("chars", F.slice("lowest.seq.chars", F.lit(1), F.col("shared"))).withColumn(
            "sha", F.when(F.size("lowest.seq") == F.col("shared"), F.col("lowest.sha")).otherwise(F.lit(_NONE))).drop("lowest", "highest"), "trie-buckets")
        count = large.count()
        if not count:
            small.append(live)
            break
        marks = large.select(F.col("up").alias("up_"), F.col("turn").alias("turn_"), F.struct("top", F.col("first").alias("conv_id")).cast(up).alias("bucket"), "shared")
        marks = F.broadcast(marks) if count <= BROADCAST_BUCKETS else marks
        met = live.join(marks, live["up"].eqNullSafe(F.col("up_")) & live["turn"].eqNullSafe(F.col("turn_")), "left").drop("up_", "turn_")
        small.append(met.where("bucket IS NULL").drop("bucket", "shared"))
        inside = met.where("bucket IS NOT NULL AND size(seq) > shared")
        live = staged(inside.select("seq", "n", "conv_id", "sha", F.col("bucket").alias("up"), F.expr("seq[shared].ids").alias("turn"), (F.col("shared") + 1).alias("top"), F.col("bucket.conv_id").alias("parent"), F.concat("path", F.array("bucket")).alias("path")), "trie-round")
        fan = live.groupBy("up", "turn").agg(F.lit(1).alias("one")).groupBy("up").agg(F.count(F.lit(1)).alias("fan"))
        bucket = F.struct("top", F.col("first").alias("conv_id")).cast(up)
        chains.append(staged(large.withColumn("bucket", bucket).join(fan.withColumnRenamed("up", "bucket"), "bucket"), "trie-chains"))
        release(spark)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, held, kinds = None, [], [], None

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*(x[0] for x in held)), schema)] + [pa.array([x[1] for x in held], kinds)], [*_NAMES, "path"])
            held.clear()
            return out

        schema = [pa.field(x, pa.string() if x == "ends_sha256" else pa.int32() if x == "depth" else pa.int64()) for x in _NAMES]

        def bucket():
            top, parent, path = now[2], now[3], now[4]
            held.extend((node, path if node[1] == top else None) for node in bucket_nodes(rows, top, parent))

        for batch in batches:
            kinds = batch.schema.field("path").type
            for seq, size, conv, sha, above, turn, top, parent, path in zip(*(c.to_pylist() for c in batch.columns)):
                key = (above and (above["depth"], above["conv_id"]), turn)
                if now is not None and key != now[:2]:
                    bucket()
                    rows = []
                    if len(held) >= 8192:
                        yield flush()
                now = (*key, top, parent, path)
                rows.append(([x["ids"] for x in seq], [x["chars"] for x in seq], size, conv, sha))
        if rows:
            bucket()
        if held:
            yield flush()

    every = small[0]
    for more in small[1:]:
        every = every.unionByName(more)
    every = every.select("seq", "n", "conv_id", "sha", "up", "turn", "top", "parent", "path")
    done = every.repartition(n, "up", "turn").sortWithinPartitions("up", "turn").mapInArrow(finish, f"{_NODE}, path array<{up}>")
    if not chains:
        return done.drop("path")
    done = staged(done, "trie-nodes")
    chain = chains[0]
    for more in chains[1:]:
        chain = chain.unionByName(more)

    def gain(first):
        """What the chain's nodes from a depth on save: all have the same conversations."""
        return (F.col("n_convs") - 1) * F.aggregate(F.slice("chars", F.greatest(first, F.lit(1)), F.greatest(F.size("chars"), F.lit(1))), F.lit(0).cast("long"), lambda a, x: a + x)

    above = done.where("path IS NOT NULL").select(F.explode("path").alias("bucket"), "n_leaves", "saved_tokens").unionByName(
        chain.select(F.explode("path").alias("bucket"), F.lit(0).cast("long").alias("n_leaves"), gain(F.col("top")).alias("saved_tokens")))
    below = above.groupBy("bucket").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    links = chain.join(below, "bucket").select("*", F.explode(F.sequence("top", "shared")).alias("depth"))
    last = F.col("depth") == F.col("shared")
    links = links.select(
        F.col("first").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("top"), F.col("first")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", F.when(last, F.col("fan")).otherwise(1).alias("n_children"),
        "n_leaves", (F.col("below") + gain(F.col("depth"))).alias("saved_tokens"), F.when(last, F.col("sha")).otherwise(F.lit(_NONE)).alias("ends_sha256"))
    return done.drop("path").unionByName(links)


def conversation_trie(turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the rebuilt conversations."""
    return trie_nodes(distinct_sequences(rebuilt(encoded_turns(turns))), local)


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, (s & 1) * 3988292384))) AS steps
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, key) AS said FROM turns GROUP BY conv_id
), heads AS (
  SELECT o.conv_id, o.said, b.said AS head,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(o.conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: xor(s >> 8, steps[(xor(s, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM crc, own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), rebuilt AS (
  SELECT conv_id, list_concat(coalesce(head[1:h], []), said[h + 1:]) AS said FROM heads
), steps AS (
  SELECT conv_id, d.depth, said[1:d.depth] AS prefix, len(said) AS turns, CASE WHEN d.depth > 0 THEN length(said[d.depth].text) ELSE 0 END AS chars
  FROM rebuilt, LATERAL (SELECT unnest(range(0, len(said) + 1)) AS depth) d
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(turns) > depth AS inner_node, (count(*) - 1) * any_value(chars) AS worth,
         sha256(coalesce(string_agg(CASE WHEN turns = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM steps GROUP BY depth, prefix
), below AS (
  SELECT s.depth, s.prefix, sum(n.worth) AS saved_tokens, count(*) FILTER (WHERE NOT n.inner_node) AS n_leaves, count(*) FILTER (WHERE n.depth = s.depth + 1) AS n_children
  FROM steps s JOIN nodes n ON n.conv_id = s.conv_id AND n.depth >= s.depth GROUP BY s.depth, s.prefix
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.prefix = n.prefix LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""
