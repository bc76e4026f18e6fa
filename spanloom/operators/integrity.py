"""Did a project change while a run was at work? Digests of its folders before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 4


def tree(files: DataFrame) -> DataFrame:
    """(folder, n, d0..d3) for each folder of the files (path, text), the whole project as '': how many files lie below it, and a digest of them.

    A file's SHA-256 of path and text counts for each folder above it; a folder's digest is the exclusive or of these, so it
    does not depend on an order and is put together before and after the shuffle. Null texts count as empty.
    """
    sha = F.sha2(F.concat(F.col("path"), F.lit("\0"), F.coalesce("text", F.lit(""))), 256)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    words = [F.conv(F.substring("sha", 16 * k + 1, 16), 16, -10).cast("long").alias(f"w{k}") for k in range(WORDS)]
    rows = files.select(sha.alias("sha"), above.alias("above")).select(*words, F.explode("above").alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("n"), *[F.bit_xor(f"w{k}").alias(f"d{k}") for k in range(WORDS)])


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(folder, n_before, n_after) of the folders that two trees do not agree on."""
    digest = F.struct("n", *[f"d{k}" for k in range(WORDS)])
    a, b = (t.select("folder", digest.alias(c)) for t, c in ((before, "a"), (after, "b")))
    zero = F.lit(0).cast("long")
    return a.join(b, "folder", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("folder", F.coalesce("a.n", zero).alias("n_before"), F.coalesce("b.n", zero).alias("n_after"))
