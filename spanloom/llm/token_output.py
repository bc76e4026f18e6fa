"""Token ids in binary files: blocks of ids as byte or bit planes, each compressed with zstandard, and a chunk index.

A dataset is a folder with two tables, written by Spark so that any of its file systems will do and
lost tasks are written again: `chunks` (one row per chunk: whole documents in ascending order and their ids, as
blocks of BLOCK ids, each turned into planes) and `index` (one row per chunk, without the ids: where it starts
among all ids, its documents and its compressed size). Each chunk can be read alone.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path
from .memo import Memo, held, sliced, uncollected

END_ID = 1
#: Ids of a block; ids after which a chunk ends at its document's end; bytes of text encoded at a time.
BLOCK, CHUNK, AT_ONCE = 1 << 15, 1 << 18, 1 << 22
#: Stems that the tokenizer is asked for in one text.
TOGETHER = 512
#: Stems that a worker remembers, at most twice, and characters of the longest that it does.
STEMS, LONGEST = 600_000, 64
MARKS = ".,!?;:"
#: What the tokenizer cuts lower-case ASCII text into before anything is merged (white space is what its Unicode tables say, not Python's), and white space before it.
PIECES = r"[ \t\n\x0b\x0c\r]*('s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+)"
CHUNK_SCHEMA = "shard int, chunk int, start long, n_ids long, doc_ids array<long>, lengths array<long>, planes array<binary>"


def encoder(path: str, added: bool) -> Memo:
    return held(("encoder", path, added), lambda: _encoder(path, added))


def _encoder(path: str, added: bool) -> Memo:
    """Remembers the ids (little-endian unsigned 32 bits) of stems. The tokenizer drops white space and joins nothing across it, and its added tokens have none inside, so a text's ids are its words' ids in order."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if not all(t.startswith("<|") and not re.search(r"[ \n]", t) for t in special):
        raise ValueError("an added token that does not start with '<|', or holds white space")

    last = np.zeros(1 + max(tokenizer.get_vocab(with_added_tokens=True).values()), bool)
    last[[i for t, i in tokenizer.get_vocab(with_added_tokens=True).items() if t.endswith("</w>")]] = True
    steps = tokenizer.normalizer, tokenizer.pre_tokenizer

    def ask(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(stems: list[str]) -> dict[str, bytes]:
        """Stems of letters are asked for in one text: each ends with the one token of a word's end. Stems of texts that do not give as many ends are left out: one was cut."""
        made = {}
        for at in range(0, len(stems), TOGETHER):
            part = stems[at : at + TOGETHER]
            raw = ask([" ".join(part)])[0]
            ends = (4 * (np.flatnonzero(last[np.frombuffer(raw, "<u4")]) + 1)).tolist()
            if len(ends) == len(part) and ends[-1] == len(raw):
                made.update(zip(part, [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)], strict=True))
        return made

    def learn(stems: list[str]) -> list[bytes]:
        letters = [s for s in stems if s.isalpha()]
        made = together([s for s in letters if not s.isascii()])
        # Lower-case ASCII letters stay as they are in all that comes before merging, and are cut at spaces only.
        tokenizer.normalizer, tokenizer.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        try:
            made |= together([s for s in letters if s.isascii() and s.islower()])
        finally:
            tokenizer.normalizer, tokenizer.pre_tokenizer = steps
        rest = [s for s in stems if s not in made]
        made.update(zip(rest, ask(rest), strict=True))
        return [made[s] for s in stems]

    return Memo(learn, STEMS, LONGEST)


def cut(words: pa.Array) -> pa.Array:
    """The stems of each word, in order; empty ones have no ids."""
    # Added tokens are found in the text as it is written: words with '<|' are left to the library, which finds '<|endoftext|>' but not '<|ENDOFTEXT|>'.
    own = pc.invert(pc.match_substring(words, "<|"))
    plain = pc.and_(own, pc.string_is_ascii(words))
    # Case is folded.
    out = pc.if_else(plain, pc.ascii_lower(words), words)
    mixed = pc.and_(plain, pc.invert(pc.ascii_is_alpha(words)))
    out = pc.replace_with_mask(out, mixed, pc.replace_substring_regex(out.filter(mixed), PIECES, r"\1 "))
    # Letters are cut from a mark after them before anything is merged, if they are still letters by then ('İ' becomes two characters).
    marked = pc.and_(pc.and_not(own, plain), pc.match_substring_regex(words, f"[{MARKS}]$"))
    ends = [f"{w[:-1]} {w[-1]}" if normalize("NFC", w[:-1]).lower().isalpha() else w for w in out.filter(marked).to_pylist()]
    return pc.split_pattern(pc.replace_with_mask(out, marked, pa.array(ends, out.type)), " ")


def taken(raw: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """raw holds stretches of these lengths, one after the other: those named by `which`, in its order, and where each begins, and the last ends."""
    first, n = np.cumsum(length) - length, length[which]
    bounds = np.concatenate([[0], np.cumsum(n)])
    return raw[np.repeat(first[which] - bounds[:-1], n) + np.arange(bounds[-1])], bounds


def encode(texts: list[str | None] | pa.Array, path: str, *, added: bool = False) -> Iterator[bytes]:
    """Ids of each text, packed. Null is encoded as empty. added: strings of added tokens in a text are these tokens, as by the library's default; else they are ordinary text."""
    memo, at = encoder(path, added), 0
    texts = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy())
    while at < len(texts):
        stop = 1 + int(np.searchsorted(sizes, AT_ONCE + (sizes[at - 1] if at else 0)))
        words = pc.split_pattern(pc.replace_substring(texts[at:stop], "\n", " "), " ")
        at = stop
        # Each distinct word is cut once, each distinct stem looked up once; ids are then gathered by the places of stems in words, and of words in texts.
        word = words.values.dictionary_encode()
        stems = cut(word.dictionary)
        stem = stems.values.dictionary_encode()
        names = stem.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = memo.learn(names)
        made = [known[s] for s in names]
        ids, bounds = taken(np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made)) // 4, stem.indices.to_numpy())
        ids, bounds = taken(ids, np.diff(bounds[stems.offsets.to_numpy()]), word.indices.to_numpy())
        raw, stops = ids.tobytes(), (4 * bounds[words.offsets.to_numpy()]).tolist()
        yield from (raw[s:e] for s, e in zip(stops, stops[1:], strict=False))


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of up to BLOCK ids: 4 byte planes, or 32 bit planes."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(rows.T)
    pack = zstandard.ZstdCompressor(level=3).compress
    return [pack(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The n ids of a block; the number of planes tells their kind."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes])
    if len(planes) == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
        return np.ascontiguousarray(rows).view("<u4").ravel()
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def write_ids(docs: DataFrame, path: str, *, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, kind: str = "byte") -> None:
    """Writes the ids of all documents, in ascending order of doc_id, to the folder `path`.

    Null and empty texts have only the end id. Null ids come first; equal ids go by their text. Texts
    are dealt by ranges of ids before they are encoded, as they are smaller than their ids; a text of any
    length stays whole. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").select("doc_id", "text", F.spark_partition_id().alias("shard"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = chunk = start = 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def packed() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(ids), "<u4")
            planes = [p for at in range(0, len(whole), BLOCK) for p in to_planes(whole[at : at + BLOCK], kind)]
            columns = [[shard], [chunk], [start], [len(whole)], [names], [[len(x) // 4 for x in ids]], [planes]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "chunk", "start", "n_ids", "doc_ids", "lengths", "planes"])

        held = 0
        for b in sliced(batches, 1024, key=("encoder", tokenizer, True)):
            shard = b.column("shard")[0].as_py() if b.num_rows else shard
            # Ids are taken as they are made: those of a few MB of text are held at a time, and what the next chunk has.
            with uncollected():
                for name, made in zip(b.column("doc_id").to_pylist(), encode(b.column("text"), tokenizer, added=True), strict=True):
                    names.append(name)
                    ids.append(made + end)
                    held += len(made) // 4 + 1
                    if held >= CHUNK:
                        yield packed()
                        chunk, start, held, ids, names = chunk + 1, start + held, 0, [], []
        if ids:
            yield packed()

    rows.mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    small = chunks.select("shard", "chunk", "start", "n_ids", F.size("doc_ids").alias("n_docs"), F.array_min("doc_ids").alias("first_doc"), F.array_max("doc_ids").alias("last_doc"), F.aggregate("planes", F.lit(0), lambda s, p: s + F.octet_length(p)).alias("bytes"))
    # One row per shard: where it starts among all ids.
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).drop("n")
    small.join(shards, "shard").withColumn("start", F.col("before") + F.col("start")).drop("before").write.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the documents of a dataset, ids as little-endian unsigned 32 bits, start the number of ids before the document."""
    index = spark.read.parquet(f"{path}/index").select("shard", "chunk", F.col("start").alias("at"))
    chunks = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "n_ids", "doc_ids", "lengths", "planes")
    count = index.count()
    rows = chunks.join(F.broadcast(index) if count <= 200_000 else index, ["shard", "chunk"]).select("at", "n_ids", "doc_ids", "lengths", "planes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, names, lengths, planes in zip(*(b.column(c).to_pylist() for c in ("at", "n_ids", "doc_ids", "lengths", "planes")), strict=True):
                blocks = -(-n // BLOCK)
                kind = len(planes) // blocks
                ids = b"".join(from_planes(planes[i * kind : (i + 1) * kind], min(BLOCK, n - i * BLOCK)).tobytes() for i in range(blocks))
                ends = np.cumsum(lengths)
                starts = ends - np.array(lengths)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(at + starts), pa.array([ids[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())], ["doc_id", "start", "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, ids binary")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
