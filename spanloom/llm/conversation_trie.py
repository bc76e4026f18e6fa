"""Prefix trie of conversations: what they share from their first turn on.

Conversations of the same turns are one sequence, counted first, so copies reach the trie once. Sequences are dealt by
the hash of the digest of their first turn; sequences below a first turn that holds too many turns for one task are
dealt by their next turn instead (the next after all that they share), again and again, until each part fits or is a single
sequence. Each part is built in one applyInPandas call as a trie of dictionaries of pointers and summed up by an
iterative postorder. Above the parts stand the root and, for each prefix that was dealt anew, the chain of the turns that all below it share;
these are few, and get the sums of the parts' tops and of each other by joins, one for each time that parts were dealt anew.

Turns travel as digests of 128 bits with their lengths, never as texts; a conversation is one row of such turns, and the ids
that end at a node are hashed as a sorted stream, so neither a first turn nor a group of copies is ever held whole by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Turns that one part of the trie holds, and as many parts at least as hold so many; conversation ids in a piece of a stream.
PART_TURNS, IDS_SHIFT = 200_000, 12
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as array<struct<d, n>>, d a digest of role and text, n the code points of the text.

    By turn, null first; equal turn numbers by digest, so that results do not depend on the order of rows. Null roles and texts count as
    empty. Rows without a conversation id belong to none and are left out.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256), 1, 32)
    number = F.col(turn)
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(number.isNotNull().alias("known"), number.alias("turn"), digest.alias("d"), F.length(t).cast("long").alias("n")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("turns"))


def prefix(n: Column | str) -> Column:
    """A digest of the first n turns of the row's sequence."""
    return F.substring(F.sha2(F.array_join(F.transform(F.slice("turns", 1, n), lambda t: t["d"]), ""), 256), 1, 32)


def ends(sequences: DataFrame) -> DataFrame:
    """(seq, copies, conv_id, ends_sha256) of the conversations (conv_id, seq): how many have each sequence, the smallest, and the digest of their ids in order, joined by commas.

    Ids are joined in pieces of up to 4,096 neighbouring ones, natively; then each sequence's pieces pass through one hash as a stream.
    """
    piece = F.shiftright("conv_id", IDS_SHIFT)
    ids = F.array_sort(F.collect_list("conv_id"))
    pieces = sequences.groupBy("seq", piece.alias("piece")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, digest = None, [], None
        for b in batches:
            for seq, n, least, text in zip(*(b.column(c).to_pylist() for c in ("seq", "n", "least", "ids")), strict=True):
                if now and now[0] == seq:
                    digest.update(b"," + text.encode())
                    now[1] += n
                else:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = [seq, n, least], hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)), schema)
                out = []
        if now:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip((*now, digest.hexdigest()), strict=True), strict=True)), schema)

    names = ["seq", "copies", "conv_id", "ends_sha256"]
    schema = pa.schema([("seq", pa.string()), ("copies", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(parts, "seq").sortWithinPartitions("seq", "piece").mapInArrow(run, "seq string, copies long, conv_id long, ends_sha256 string")


def dealt(seqs: DataFrame, part_turns: int = PART_TURNS) -> tuple[DataFrame, list[DataFrame]]:
    """The sequences in parts (seqs with top, the depth of the node that a part starts from, key, the digest of so many turns, and up), and the nodes above the parts, a DataFrame for each round.

    A node above stands for the chain of depths top to `last` that the same sequences go through: key, up (the key of the node
    above it), top, last, conv_id, n_convs, chars (of the chain's turns) and ends_sha256 of what ends at its last depth.
    """
    text = lambda x: F.lit(x).cast("string")
    whole = F.transform("turns", lambda t: t["d"])

    def nodes(rows: DataFrame) -> DataFrame:
        """Of rows with key, up and top: the chain of each key."""
        first, last = F.min(whole).alias("lo"), F.max(whole).alias("hi")
        found = rows.groupBy("key").agg(F.first("up").alias("up"), F.first("top").alias("top"), first, last, F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.min_by("turns", "conv_id").alias("turns"))
        apart = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), False).cast("int")
        found = found.withColumn("last", F.when(apart > 0, apart - 1).otherwise(F.size("lo")))
        return found.select("key", "up", "top", "last", "conv_id", "n_convs", F.transform(F.slice("turns", F.col("top"), F.col("last") - F.col("top") + 1), lambda t: t["n"]).alias("chars"))

    root = seqs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.max(F.when(F.size("turns") == 0, F.col("ends_sha256"))).alias("ends_sha256")).where("conv_id is not null")
    above = [written(root.select(F.lit("").alias("key"), text(None).alias("up"), F.lit(0).alias("top"), F.lit(0).alias("last"), "conv_id", "n_convs", F.array(F.lit(0).cast("long")).alias("chars"), "ends_sha256"), "trie-above")]
    left, parts = seqs.where(F.size("turns") > 0).withColumns({"top": F.lit(1), "up": F.lit("")}), None
    while True:
        keyed = written(left.withColumn("key", prefix(F.col("top"))), "trie-dealt")
        sizes = keyed.groupBy("key").agg(F.sum(F.size("turns") - F.col("top") + 1).alias("held"), F.count("*").alias("several"))
        large = written(sizes.where((F.col("held") > part_turns) & (F.col("several") > 1)).select("key"), "trie-large")
        n = large.count()
        small = (lambda df: F.broadcast(df)) if n <= 1_000 else (lambda df: df)
        out = keyed.join(small(large), "key", "left_anti") if n else keyed
        parts = out if parts is None else parts.unionByName(out)
        if not n:
            return parts, above
        rows = keyed.join(small(large), "key", "left_semi")
        chains = written(nodes(rows), "trie-chains")
        rows = rows.drop("up", "top").join(small(chains.select("key", "last")), "key")
        ended = rows.where(F.size("turns") == F.col("last")).select("key", "ends_sha256")
        above.append(written(chains.join(ended, "key", "left"), "trie-above"))
        left = rows.where(F.size("turns") > F.col("last")).withColumns({"up": F.col("key"), "top": F.col("last") + 1}).select(*seqs.columns, "top", "up")


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one part: tries of dictionaries of pointers, one for each key, with the sums below each node.

    Nodes are numbered as they are made, each after its parent, so going through them backwards is a postorder.
    """
    tops: dict[str, int] = {}
    below: list[dict] = []
    up, depth, least, members, own, end, key_of = [], [], [], [], [], [], []

    def new(parent: int, at: int, chars: int) -> int:
        below.append({})
        for column, value in ((up, parent), (depth, at), (least, None), (members, 0), (own, chars), (end, EMPTY_SHA), (key_of, None)):
            column.append(value)
        return len(below) - 1

    for key, top, turns_, conv, copies, ends_ in zip(*(rows[c] for c in ("key", "top", "turns", "conv_id", "copies", "ends_sha256")), strict=True):
        if (node := tops.get(key)) is None:
            node = tops[key] = new(-1, top, turns_[top - 1]["n"])
            key_of[node] = key
        for at in range(top, len(turns_) + 1):
            if at > top:
                turn = turns_[at - 1]
                child = below[node].get(turn["d"])
                if child is None:
                    child = below[node][turn["d"]] = new(node, at, turn["n"])
                node = child
            members[node] += copies
            if least[node] is None or conv < least[node]:
                least[node] = conv
        end[node] = ends_
    children = list(map(len, below))
    leaves, saved = [int(not c) for c in children], [(m - 1) * chars for m, chars in zip(members, own, strict=True)]
    for node in range(len(below) - 1, -1, -1):
        if (p := up[node]) >= 0:
            leaves[p] += leaves[node]
            saved[p] += saved[node]
    parent = [None if p < 0 else least[p] for p in up]
    columns = {"conv_id": least, "depth": depth, "parent_conv_id": parent, "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}
    return pd.DataFrame({c: pd.array(v, "Int64") for c, v in columns.items()} | {"ends_sha256": end, "key": pd.Series(key_of, dtype="object")})


def trie(sequences: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Nodes of the prefix trie of conversations (conv_id, turns as from `turns`): conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The root has depth 0 and no parent; conversations without turns end there. Copies, and ids in any order, give the same nodes. Without any
    conversation there is no node.
    """
    spark = sequences.sparkSession
    rows = written(sequences.select("conv_id", "turns", prefix(F.size("turns")).alias("seq")), "trie-convs")
    ended = ends(rows.select("conv_id", "seq"))
    # Of each sequence the turns of its smallest conversation.
    seqs = written(ended.join(rows.select("conv_id", "turns"), "conv_id"), "trie-seqs")
    parts, above = dealt(seqs, part_turns)
    parts = written(parts, "trie-parts")
    total = parts.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * total // part_turns)
    below = parts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    made = below.select("bucket", "key", "top", "turns", "conv_id", "copies", "ends_sha256").groupBy("bucket").applyInPandas(lambda part: build(part), f"{NODE}, key string")
    made = written(made, "trie-nodes")
    tops = made.where("key is not null").select("key", "n_leaves", "saved_tokens").join(parts.select("key", "up").distinct(), "key")
    # From the last dealing upwards: what the parts and the chains below give to each chain.
    gives, done = tops.select("up", "n_leaves", "saved_tokens"), []
    for chains in reversed(above):
        sums = gives.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        own = (F.col("n_convs") - 1) * F.aggregate("chars", F.lit(0).cast("long"), lambda a, n: a + n)
        chains = chains.join(sums, "key", "left").select(*chains.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("below", F.lit(0)).alias("below"), (F.coalesce("below", F.lit(0)) + own).alias("saved_tokens"))
        done.append(written(chains, "trie-above"))
        gives = tops.select("up", "n_leaves", "saved_tokens").unionByName(done[-1].select("up", "n_leaves", "saved_tokens"))
    chains = done[0]
    for more in done[1:]:
        chains = chains.unionByName(more)
    parents = chains.select(F.col("key").alias("up"), F.col("conv_id").alias("of_up"))
    # The nodes of a chain have the same members; each saves what its own text and all below save.
    each = chains.join(parents, "up", "left").select("*", F.posexplode("chars").alias("k", "n")).withColumn("depth", F.col("top") + F.col("k"))
    from_here = F.sum("n").over(Window.partitionBy("key").orderBy(F.desc("k")))
    ends_here = F.when(F.col("depth") == F.col("last"), F.col("ends_sha256"))
    upper = each.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("k") > 0, F.col("conv_id")).otherwise(F.col("of_up")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") < F.col("last"), 1).otherwise(F.col("n_children")).cast("long").alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * from_here).alias("saved_tokens"), F.coalesce(ends_here, F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    of_tops = tops.select("key", "up").join(parents, "up").select("key", "of_up")
    lower = made.where("key is null").drop("key").unionByName(made.where("key is not null").join(of_tops, "key").withColumn("parent_conv_id", F.col("of_up")).drop("key", "of_up"))
    return upper.unionByName(lower)


def rebuilt(rows: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The contract's conversations: each begins with the first h turns of the conversation whose id is the last multiple of `group`, h its id's crc32 modulo `most`, and goes on with its own after its first h."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    base = rows.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("shared"))
    own = rows.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    first = F.coalesce(F.slice("shared", 1, F.col("h")), F.array().cast(rows.schema["turns"].dataType))
    return own.join(base, "base", "left").select("conv_id", F.concat(first, F.when(F.size("turns") > F.col("h"), rest).otherwise(F.array().cast(rows.schema["turns"].dataType))).alias("turns"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(written(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")))
