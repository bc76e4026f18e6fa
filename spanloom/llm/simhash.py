"""SimHash near-duplicates by a Gray-order hierarchical index.

Of two fingerprints that differ in at most d bits, one of d + 1 disjoint blocks of bits is equal. Each
block's value is an upper node of the index: a masked bit pattern that all codes below share, and the key
by which codes are dealt to tasks. Below such a node the codes are sorted by Gray rank (neighbours share most
bits), runs of them are factored into nodes (mask of the bits that all share, and their values), and the
search for close codes walks down pairs of nodes: differences in shared bits add up, and once they exceed d
the whole pair of groups is dropped. Tasks pass on spanning edges of what they link, never all pairs.
Nodes that hold far more codes than others are cut into chunks and searched by pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, written
from .exact_dedup import BROADCAST_DIGESTS, located_rows, normalised
from .memo import sliced

WORDS, DISTANCE, HASH_SEED = 3, 3, 42
#: Codes of one upper node that one task takes, at least; it also takes four times the mean node.
CHUNK = 20_000
#: Children of an index node; pairs of nodes looked at in one step; rows that a task holds at once.
FANOUT, STEP, HELD = 8, 1 << 16, 1 << 20


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits, each 1 if set in over half of the hashes of the text's word shingles, repeats included; 0 without words."""
    parts = normalised(text).split()  # bytes.split() knows ASCII white space only
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    count = np.zeros(64, np.int64)
    for at in range(0, n, HELD // 16):
        spans = zip(starts[at : min(n, at + HELD // 16)].tolist(), ends[min(words, len(parts)) - 1 :][at : at + HELD // 16].tolist(), strict=False)
        h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], HASH_SEED) for s, e in spans), np.uint64)
        count += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """df with the text column replaced by fp, the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("fp", T.LongType()) if f.name == text else f for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            at = b.schema.get_field_index(text)
            made = pa.array(np.array([fingerprint(t, words) for t in b.column(at).to_pylist()], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([made if i == at else b.column(i) for i in range(b.num_columns)], ["fp" if i == at else b.schema.names[i] for i in range(b.num_columns)])

    return df.mapInArrow(run, schema)


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence: the exclusive or of all its right shifts."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> np.uint64(s))
    return code


class GrayIndex:
    """Codes below several upper nodes (group), each with its own tree."""

    def __init__(self, group: np.ndarray, code: np.ndarray):
        order = np.lexsort((gray_rank(code), group))
        self.order, group, code = order, group[order], code[order]
        #: Per level from the leaves up: value and mask of the shared bits, first child of each node.
        self.levels = [(code, np.full(len(code), ~np.uint64(0)), None)]
        while len(group) > 1 and (group[1:] == group[:-1]).any():
            value, mask, _ = self.levels[-1]
            new = np.r_[True, group[1:] != group[:-1]]
            begin = np.flatnonzero(new)
            place = np.arange(len(group)) - np.repeat(begin, np.diff(np.r_[begin, len(group)]))
            first = np.flatnonzero(place % FANOUT == 0)
            of = np.repeat(first, np.diff(np.r_[first, len(group)]))
            shared = np.bitwise_and.reduceat(mask & ~(value ^ value[of]), first)
            self.levels.append((value[first] & shared, shared, np.r_[first, len(group)]))
            group = group[first]

    def pairs(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in the sorted order) of all pairs of codes of a group that differ in at most `distance` bits, in pieces."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots, np.zeros(len(roots), np.uint8))] if top else []
        while stack:
            level, a, b, acc = stack.pop()
            if len(a) > STEP:
                stack += [(level, a[STEP:], b[STEP:], acc[STEP:])]
                a, b, acc = a[:STEP], b[:STEP], acc[:STEP]
            value, mask, first = self.levels[level]
            below, own, _ = self.levels[level - 1]
            na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
            n = na * nb
            pair = np.repeat(np.arange(len(a)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = first[a][pair] + at // nb[pair], first[b][pair] + at % nb[pair]
            keep = (i < j) if level == 1 else (i <= j)
            i, j, pair = i[keep], j[keep], pair[keep]
            seen = (mask[a] & mask[b])[pair]
            acc = acc[pair] + np.bitwise_count((below[i] ^ below[j]) & own[i] & own[j] & ~seen)
            close = acc <= distance
            i, j = i[close], j[close]
            if not len(i):
                continue
            if level == 1:
                yield i, j
            else:
                stack.append((level - 1, i, j, acc[close]))


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label after linking i with j; label holds for each place the smallest place of its component."""
    a, b = label[i], label[j]
    while (apart := a != b).any():
        a, b = a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
    return label


def links(codes: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect, directly or over others, all codes (column fp, distinct) that differ in at most `distance` bits."""
    blocks, width = distance + 1, 64 // (distance + 1)
    spark = codes.sparkSession
    block = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1).alias("v")) for k in range(blocks)])).alias("b")
    rows = codes.select("fp", block).select("fp", "b.k", "b.v")
    sizes = written(rows.groupBy("k", "v").count(), "simhash-nodes")  # at most blocks * 2**width rows
    total, nodes = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    limit = max(chunk, 4 * total // max(1, nodes))
    hot = sizes.where(F.col("count") > limit).select("k", "v", F.ceil(F.col("count") / limit).cast("int").alias("m"))
    rows = rows.join(F.broadcast(hot) if width <= 16 else hot, ["k", "v"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    others = F.when(F.col("m") == 1, F.array(F.lit(-1))).otherwise(F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda o: o != own))
    rows = rows.select("fp", "k", "v", own.alias("own"), F.explode(others).alias("o")).select("fp", "k", "v", F.least("own", "o").alias("c1"), F.greatest("own", "o").alias("c2"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // HELD + 1)
    rows = rows.repartition(parts, "k", "v", "c1", "c2").sortWithinPartitions("k", "v", "c1", "c2")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.r_[False, (keys[1:] != keys[:-1]).any(axis=1)])
            turn = (64 - width - width * keys[:, 0]).astype(np.uint64)
            code = fp.view(np.uint64)
            code = np.where(turn > 0, (code << turn) | (code >> ((np.uint64(64) - turn) % np.uint64(64))), code)  # the shared block leads
            index, label = GrayIndex(group, code), np.arange(len(fp))
            for i, j in index.pairs(distance):
                label = merge(label, i, j)
            fp = fp[index.order]
            moved = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["a", "b"])

        keys, fps = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "v", "c1", "c2")], axis=1)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if len(fps) >= HELD and len(ends):
                yield linked(keys[: ends[-1] + 1], fps[: ends[-1] + 1])
                keys, fps = keys[ends[-1] + 1 :], fps[ends[-1] + 1 :]
        if len(fps):
            yield linked(keys, fps)

    return rows.mapInArrow(search, "a long, b long")


def grouped(rows: DataFrame, *, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """rows (doc_id, text and any others) with fp, root and component_id in place of text.

    Fingerprints link at `distance` or fewer differing bits; root is one fingerprint of the linked group,
    component_id the smallest doc_id in it (null if all are). Null and empty texts have fingerprint zero and link
    like any other; repeated rows fall into one group; an empty table gives an empty result.
    """
    prints = written(with_fingerprint(rows, words=words), "simhash")
    codes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-codes")
    roots = components(links(codes.select("fp"), distance))
    codes = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    codes = written(codes, "simhash-codes")
    smallest = codes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(codes.select("fp", "root").join(smallest, "root"), "fp")


def near_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each linked group: that with the smallest doc_id (nulls last), then the first locator. All columns stay."""
    located, rows, file, row = located_rows(docs, doc_id, text)
    marked = written(grouped(rows, words=words, distance=distance), "simhash-groups")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "file", "row")
    keepers = marked.groupBy("root").agg(F.min(place).alias("keeper"))
    dropped = marked.join(keepers, "root").where("file <> keeper.file or row <> keeper.row")
    dropped = written(dropped.select(F.col("file").alias(file), F.col("row").alias(row)), "simhash-dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_DIGESTS else dropped
    return located.join(dropped, [file, row], "left_anti").select(*docs.columns)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
