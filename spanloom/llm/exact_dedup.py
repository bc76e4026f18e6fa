"""Exact deduplication as a stateful stream.

Documents become a narrow log (digest, identifier, content locator); a streaming aggregation keyed by
digest keeps, on disk (RocksDB state store) and without expiry, how often a digest came and the
identifier and locator of the document that stays. Equal digests are only candidates: on hits the
full texts are compared, and a digest that stands for several texts is decided by text. The state folder
may be given and used again: later documents then meet the earlier ones, whose kept texts are read through
their locators.

A digest with a third of all rows is reduced map-side before each shuffle; joins are on narrow rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, fold_ascii, new_path, with_locator, written
from .memo import sliced

#: Bytes of log that one micro-batch takes.
BATCH_BYTES = 4 << 30
#: Digests up to this number are broadcast (32 bytes each); beyond it the join shuffles.
BROADCAST_DIGESTS = 200_000
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased; null counts as empty. Bytes of other characters are above 0x7F and stay."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def with_digest(df: DataFrame, text: str, name: str, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """df with the text column replaced by the binary digest of its normalised text."""
    schema = T.StructType([T.StructField(name, T.BinaryType()) if f.name == text else f for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            at = b.schema.get_field_index(text)
            made = pa.array([digest(normalised(t)) for t in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([made if i == at else b.column(i) for i in range(b.num_columns)], [name if i == at else b.schema.names[i] for i in range(b.num_columns)])

    return df.mapInArrow(run, schema)


def stream_state(spark: SparkSession, log_path: str, schema: T.StructType, state_dir: str | None = None) -> DataFrame:
    """(digest, n, keeper) over all of the log: the last value that the state had for each digest."""
    state_dir = state_dir or new_path(spark, "dedup-state")
    out = f"{state_dir}/updates"
    # Without allowFAllocate off, each state partition sets 4 MB of disk aside, however small it is.
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        log = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(log_path)
        state = log.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keeper"))

        def keep(batch: DataFrame, number: int) -> None:  # a batch that is run again replaces itself
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return last_state(spark, state_dir, schema["doc_id"].dataType)


def last_state(spark: SparkSession, state_dir: str, id_type: T.DataType) -> DataFrame:
    """(digest, n, keeper) as the state left them; empty before its first batch."""
    kept = T.StructType().add("digest", T.BinaryType()).add("n", T.LongType()).add("keeper", T.StructType().add("doc_id", id_type).add("file", T.StringType()).add("row", T.LongType()))
    try:
        updates = spark.read.schema(kept.add("batch", T.LongType())).parquet(f"{state_dir}/updates")
    except AnalysisException as e:  # an empty log has no batch
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kept).drop("batch")
    return updates.groupBy("digest").agg(F.max(F.struct("n", "keeper")).alias("s")).select("digest", "s.n", "s.keeper")


def decide(rows: DataFrame, *, digest: Callable[[bytes], bytes] = sha256, state_dir: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """One row per row of rows (doc_id, text, file, row): doc_id, keep_id, group_size, kept, digest (binary), file, row.

    file and row are the content locator, one pair per row. Texts are equal when their normalised bytes
    are. Of equal texts the row with the largest doc_id is kept; a null doc_id is below all others; of repeated
    rows with the same doc_id the one whose locator is last is kept, so each group keeps exactly one row. Null
    and empty texts form one group. keep_id is null where all ids of a group are. An empty table gives an
    empty result.

    With state_dir, counts and kept rows go on from the calls that used it before; decisions that those returned stay as
    they were. earlier holds the rows of those calls: where a digest comes again, the row that the state kept is looked up
    there by its locator and its text compared. Without earlier, an equal digest of an earlier call is trusted.
    """
    spark = rows.sparkSession
    before = None
    if state_dir:
        # The stream reads one folder of logs, to which each call adds.
        path = f"{state_dir}/log"
        before = written(last_state(spark, state_dir, rows.schema["doc_id"].dataType), "dedup-before") if earlier is not None else None
    else:
        path = new_path(spark, "dedup-log")
    log = with_digest(rows.select("doc_id", "text", "file", "row"), "text", "digest", digest)
    schema = log.schema
    log = written(log, "dedup-log") if state_dir else log
    log.write.mode("append" if state_dir else "errorifexists").parquet(path)
    log = log if state_dir else spark.read.schema(schema).parquet(path)
    verdicts = written(stream_state(spark, path, schema, state_dir), "dedup-verdicts")

    # Hits: the same digest came more than once. All their bytes are compared by grouping on the text itself.
    def full_texts(source: DataFrame, digests: DataFrame) -> DataFrame:
        digests = F.broadcast(digests) if digests.count() <= BROADCAST_DIGESTS else digests
        seen = with_digest(source.select("doc_id", "text", "file", "row", F.col("text").alias("t")), "text", "digest", digest)
        return seen.join(digests, "digest", "left_semi").withColumn("t", fold_ascii(F.col("t")))

    def texts(found: DataFrame) -> DataFrame:
        return found.groupBy("digest", "t").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keeper"))

    hits = verdicts.where("n > 1").select("digest")
    compared = full_texts(rows, hits)
    if before is not None:
        stood = earlier.join(before.select("keeper.file", "keeper.row"), ["file", "row"], "left_semi")
        compared = compared.unionByName(full_texts(stood, hits.join(log.select("digest"), "digest", "left_semi")))
    mixed = written(texts(compared).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "dedup-mixed")
    if state_dir:  # a digest that stood for several texts is never trusted again
        mixed.write.mode("append").parquet(f"{state_dir}/mixed")
        mixed = written(spark.read.schema(mixed.schema).parquet(f"{state_dir}/mixed").distinct(), "dedup-mixed")
    kept = (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))
    columns = ["doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest", "file", "row"]
    out = log.join(verdicts, "digest")
    if mixed.isEmpty():
        return out.select(*columns)
    # Several texts under one digest: those rows are decided by text, among all rows.
    every = rows if earlier is None else rows.select("doc_id", "text", "file", "row").unionByName(earlier.select("doc_id", "text", "file", "row"))
    again = full_texts(rows, mixed).join(texts(full_texts(every, mixed)), ["digest", "t"])
    return out.join(mixed, "digest", "left_anti").select(*columns).unionByName(again.select(*columns))


def located_rows(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, str, str]:
    """docs with its locator columns, their names, and the four columns that decide() takes."""
    located, file, row = with_locator(docs)
    return located, located.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(file).alias("file"), F.col(row).alias("row")), file, row


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that decide() drops; all columns stay."""
    located, rows, file, row = located_rows(docs, doc_id, text)
    dropped = written(decide(rows).where("not kept").select(F.col("file").alias(file), F.col("row").alias(row)), "dedup-dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_DIGESTS else dropped
    return located.join(dropped, [file, row], "left_anti").select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decide(located_rows(docs, "doc_id", "text")[1]).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""
