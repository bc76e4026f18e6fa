"""Embedding near-duplicates by PCA-ordered tiled comparison.

Distinct vectors are made unit vectors and turned so that the leading coordinates carry most (PCA of a bounded
sample; it affects speed only). Stripes of the first coordinate, those of many vectors dealt into chunks by a hash,
are paired where they can hold close vectors, and each pair of chunks is one unit of work of bounded size,
compared tile by tile: leading coordinates first, with the product of suffix norms as the bound of what the rest can add. Pairs whose bound misses the threshold stop
there; the others go on with more coordinates, and what is left is confirmed by the full cosine in double precision.
Each unit passes on numbers of links and spanning edges, never pairs. The comparison is quadratic where the first
coordinate does not tell vectors apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, written
from .simhash import merge

THRESHOLD = 0.95
#: Vectors that the PCA is fitted on, vectors of a stripe (a chunk has twice as many at most, about) and of a tile, and coordinates at which the bound is looked at.
SAMPLE, STRIPE, TILE, STEPS = 4096, 4096, 512, (8, 16, 32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows made unit length; scaled by their largest component first, so that no square leaves the range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def close_pairs(x: np.ndarray, y: np.ndarray, basis: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of rows of x and y with cosine >= threshold, tile by tile; each unordered pair once if x is y."""
    ux, uy = unit(x), unit(y)
    px, py = ux @ basis, uy @ basis
    ox, oy = np.argsort(px[:, 0], kind="stable"), np.argsort(py[:, 0], kind="stable")
    reach, slack = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9, threshold - 1e-9
    steps = [k for k in STEPS if k < x.shape[1]] or [x.shape[1]]
    suffix = lambda p, k: np.sqrt(np.maximum(0.0, (p[:, k:] ** 2).sum(axis=1)))
    sx, sy = ({k: suffix(p, k) for k in steps} for p in (px, py))
    lead_x, lead_y = np.c_[px[:, : steps[0]], sx[steps[0]]], np.c_[py[:, : steps[0]], sy[steps[0]]]
    for a in range(0, len(ox), TILE):
        i = ox[a : a + TILE]
        for b in range(a if same else 0, len(oy), TILE):
            j = oy[b : b + TILE]
            if px[i[0], 0] - py[j[-1], 0] > reach or py[j[0], 0] - px[i[-1], 0] > reach:
                continue
            at, bt = np.nonzero(lead_x[i] @ lead_y[j].T >= slack)
            if same and a == b:
                at, bt = at[at < bt], bt[at < bt]
            for k, more in zip(steps, [*steps[1:], None], strict=True):
                if more is None or not len(at):
                    break
                bound = np.einsum("ij,ij->i", px[i[at], :more], py[j[bt], :more]) + sx[more][i[at]] * sy[more][j[bt]]
                at, bt = at[bound >= slack], bt[bound >= slack]
            if len(at):
                sure = np.einsum("ij,ij->i", ux[i[at]], uy[j[bt]]) >= threshold
                yield i[at[sure]], j[bt[sure]]


def plan(sample: list, threshold: float, stripes: int) -> tuple[dict, list]:
    """For each length of vectors in the sample its basis and stripe borders, and (dim, stripe, lo, hi): the stripes that may hold close vectors."""
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    bases, reach = {}, []
    for dim, vectors in by.items():
        u = unit(np.array(vectors, float))
        basis = np.linalg.eigh(u.T @ u)[1][:, ::-1]
        first = np.sort(u @ basis[:, 0])
        borders = np.unique(first[np.linspace(0, len(first), stripes + 1).astype(int)[1:-1]])
        bases[dim] = basis, borders
        low, high, gap = np.r_[-np.inf, borders], np.r_[borders, np.inf], np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
        reach += [(dim, s, int(np.searchsorted(high, low[s] - gap)), int(np.searchsorted(low, high[s] + gap, "right")) - 1) for s in range(len(low))]
    return bases, reach


def chunk_ranges(reach: list, counted: list) -> list:
    """(dim, stripe, chunks, base, lo, hi) from the stripes within reach and (dim, stripe, chunks): a stripe's chunks (one if none were counted), its first one, and the first and last chunk that may hold close vectors. Chunks of a length are numbered through."""
    chunks = {(r["dim"], r["stripe"]): r["chunks"] for r in counted}
    out = []
    for dim in {r[0] for r in reach}:
        own = [r for r in reach if r[0] == dim]
        many = [chunks.get((dim, s), 1) for _, s, _, _ in own]
        starts = [0, *np.cumsum(many).tolist()]
        out += [(dim, s, many[s], starts[s], starts[lo], starts[hi + 1] - 1) for _, s, lo, hi in own]
    return out


def linked(vectors: DataFrame, threshold: float = THRESHOLD, stripe: int = STRIPE) -> DataFrame:
    """(key, links, root) from distinct usable vectors (key, embedding, n): for keys linked in a unit of work, the rows linked to in it and the smallest key it hangs together with."""
    spark = vectors.sparkSession
    sample = [r[0] for r in vectors.select("embedding").orderBy(F.xxhash64("key")).limit(SAMPLE).collect()]  # at most SAMPLE vectors
    bases, reach = plan(sample, threshold, max(1, -(-vectors.count() // stripe)))
    bases = spark.sparkContext.broadcast(bases)  # bases of the lengths in the sample
    of = lambda dim: bases.value.get(dim) or (np.eye(dim), np.zeros(0))  # noqa: E731  a length too rare for the sample is one stripe

    def to_stripe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, out = np.array([len(v) for v in b.column("embedding")], np.int32), np.zeros(b.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = unit(np.array(b.column("embedding").take(pa.array(at)).to_pylist(), float))
                out[at] = np.searchsorted(of(dim)[1], x @ of(dim)[0][:, 0], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array(out)], [*b.schema.names, "dim", "stripe"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select("key", "embedding", "n").mapInArrow(to_stripe, f"key long, embedding {kind}, n long, dim int, stripe int")
    counts = written(rows.groupBy("dim", "stripe").agg(F.ceil(F.count("*") / (2 * stripe)).cast("int").alias("chunks")), "vector-stripes")
    sampled = F.col("dim").isin(list(bases.value))
    known = chunk_ranges(reach, counts.where(sampled).collect())  # at most two a vector of the sample
    # A length too rare for the sample has chunks, too, all in stripe 0.
    rare = counts.where(~sampled).select("dim", "stripe", "chunks", F.lit(0).alias("base"), F.lit(0).alias("lo"), (F.col("chunks") - 1).alias("hi"))
    near = spark.createDataFrame(known, "dim int, stripe int, chunks int, base int, lo int, hi int").unionByName(rare)
    own = F.col("base") + F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    rows = rows.join(written(near, "vector-stripes"), ["dim", "stripe"]).withColumn("own", own)
    met = rows.select("key", "embedding", "n", "dim", "own", F.explode(F.sequence("lo", "hi")).alias("other"))
    pairs = met.select("key", "embedding", "n", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("other") < F.col("own")).cast("int").alias("side"))
    pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dim", "i", "j").sortWithinPartitions("dim", "i", "j", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit_of_work(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            t = pa.Table.from_batches(parts)
            key, n, side = (t.column(c).to_numpy() for c in ("key", "n", "side"))
            dim, same = t.column("dim")[0].as_py(), t.column("i")[0].as_py() == t.column("j")[0].as_py()
            x = np.array(t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)
            cut = len(key) if same else int(np.searchsorted(side, 1))
            label, links = np.arange(len(key)), np.zeros(len(key), np.int64)
            if cut and (same or cut < len(key)):
                for i, j in close_pairs(x[:cut], x if same else x[cut:], of(dim)[0], threshold, same):
                    j = j if same else j + cut
                    np.add.at(links, i, n[j])
                    np.add.at(links, j, n[i])
                    label = merge(label, i, j)
            got = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(key[got]), pa.array(links[got]), pa.array(key[label[got]])], ["key", "links", "root"])

        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            code = np.stack([b.column(c).to_numpy() for c in ("dim", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1).tolist(), len(code)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s < e:
                    if last is not None and last != code[s].tolist():
                        yield unit_of_work(held)
                        held = []
                    last = code[s].tolist()
                    held.append(b.slice(s, e - s))
        if held:
            yield unit_of_work(held)

    return pairs.mapInArrow(compare, "key long, links long, root long")


def near_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD, stripe: int = STRIPE) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do
    vectors of different lengths. Repeated vectors link with each other (cosine 1) and are compared with others once.
    component_id is the smallest vec_id of the component (null ids count last); an empty table gives an empty result.
    """
    sound = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", sound.alias("sound"))
    usable = rows.where("sound")
    distinct = usable.groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("key", F.monotonically_increasing_id())
    distinct = written(distinct, "vectors")  # keys are fixed from here on
    links = written(linked(distinct, threshold, stripe), "vector-links")
    sums = links.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(links.where("root <> key"), "key", "root").withColumnRenamed("node", "key")
    known = distinct.select("embedding", "key", "n", "least").join(sums, "key", "left").join(roots, "key", "left")
    known = written(known.select("embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least", F.coalesce("root", "key").alias("root")), "vectors")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    found = usable.join(known.join(smallest, "root").select("embedding", "n_links", "component_id"), "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
