"""Periodic runs of words in texts, by the runs theorem, and texts without their repetitions.

Every run (a stretch with period q, at least 2q long, that neither neighbour extends) contains a Lyndon root that is the longest
Lyndon word at its start, under the order of the words or under the reverse order. Both kinds of Lyndon words are read off the
inverse suffix array: the one at i ends before the next smaller, or the next greater, value. Each is extended to both
sides as far as its period holds: common extensions are range minima over the LCP arrays of the words and of their
reversal, answered from sparse tables.

Only where it can matter: a run of at least m words repeats ceil(m/2) or more of them at the distance of its period, and the repeated
grams of that size cover it whole. So suffixes are sorted within the stretches that repeated grams cover; words elsewhere are in
no run. Stretches of many texts share one suffix array; each is fenced by signs of its own, smaller than all words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memo import sliced

#: Words of the shortest run; words that are handled at once (or one text, if it is longer).
LEAST, AT_ONCE = 12, 1 << 18


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # bytes.split() knows ASCII white space only


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Place of each suffix among all (inverse suffix array). Prefix doubling, each round over those only that are not told apart yet; the last symbol occurs once."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    size = np.diff(np.r_[first, n])
    rank[order] = np.repeat(first, size)
    open_ = order[np.repeat(size > 1, size)]
    step = 1
    while len(open_):
        # Those left share `step` symbols with another, so a fence is not among these and the suffix goes on.
        key = rank[open_] * (n + 1) + rank[open_ + step]
        order = np.argsort(key, kind="stable")
        at, key = open_[order], key[order]
        old = rank[at]
        new = np.r_[True, key[1:] != key[:-1]]
        begun = np.r_[True, old[1:] != old[:-1]]
        first, group = np.flatnonzero(new), np.flatnonzero(begun)
        size = np.diff(np.r_[first, len(at)])
        start = np.repeat(first, size) - np.repeat(group, np.diff(np.r_[group, len(at)]))
        rank[at] = old + start
        open_ = at[np.repeat(size > 1, size)]
        step *= 2
    return rank


def common_prefixes(symbols: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[r]: symbols that the suffixes of places r - 1 and r share; position by position, each at most one shorter than that before."""
    n = len(symbols)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    before = np.empty(n, np.int64)
    before[suffix[1:]], before[suffix[0]] = suffix[:-1], -1
    text, lcp, h = symbols.tolist(), [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        lcp[i] = h
        if h:
            h -= 1
    out = np.empty(n, np.int64)
    out[rank] = lcp
    return out


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low..high]) for each pair, both ends included. Each level of the sparse table is made from the one before and answers the ranges of its length."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << k) + 1])
    return out


def common_extensions(rank: np.ndarray, lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at a and b, a < b, share."""
    ra, rb = rank[a], rank[b]
    return range_minima(lcp, np.minimum(ra, rb) + 1, np.maximum(ra, rb))


def lyndon_ends(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest Lyndon word at each position ends, under the order of the symbols and under its reverse: the next smaller and the next greater rank."""
    n = len(rank)
    smaller, greater = [n] * n, [n] * n
    low, high, r = [], [], rank.tolist()
    for i, x in enumerate(r):
        while low and r[low[-1]] > x:
            smaller[low.pop()] = i
        low.append(i)
        while high and r[high[-1]] < x:
            greater[high.pop()] = i
        high.append(i)
    return np.array(smaller), np.array(greater)


def runs_between(symbols: np.ndarray, fence: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least `least` symbols between fences. fence: whether a symbol is one; the first and the last are, each occurs once, and fences are smaller than all else."""
    n = len(symbols)
    rank = suffix_ranks(symbols)
    backward = suffix_ranks(symbols[::-1])
    lcp, back_lcp = common_prefixes(symbols, rank), common_prefixes(symbols[::-1], backward)
    inside = np.flatnonzero(~fence)
    stop = np.flatnonzero(fence)
    stop = stop[np.searchsorted(stop, inside)]  # the fence after each
    found = []
    for ends in lyndon_ends(rank):
        end = ends[inside]
        whole = end <= stop
        i, j = inside[whole], end[whole]
        right = common_extensions(rank, lcp, i, j)
        left = common_extensions(backward, back_lcp, n - j, n - i)  # the words before i and j, read backwards
        period = j - i
        length = left + period + right
        long = length >= np.maximum(least, 2 * period)
        found.append(np.stack([i - left, length, period], axis=1)[long])
    return np.unique(np.concatenate(found), axis=0)


def covered(ids: np.ndarray, text: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which words the repeated grams of half the shortest run's size cover. ids and text: each word's number and the number of its text. Grams are compared by 64-bit hashes; equal hashes of others only cover more."""
    gram, n = max(1, (least + 1) // 2), len(ids)
    out = np.zeros(n + 1, np.int64)
    if n < gram:
        return out[:n] > 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    places = n - gram + 1
    h = text[:places].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    for k in range(gram):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + places]
    at = np.flatnonzero(text[:places] == text[gram - 1 :])
    if not len(at):
        return out[:n] > 0
    order = at[np.argsort(h[at])]
    same = h[order][1:] == h[order][:-1]
    again = order[np.r_[False, same] | np.r_[same, False]]
    np.add.at(out, again, 1)
    np.add.at(out, again + gram, -1)
    return np.cumsum(out[:n]) > 0


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """For each list of words rows (start, length, period) of its runs of at least `least` words, by start and period."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    cover = covered(ids, text, least)
    # Stretches of covered words of one text.
    opens = cover & np.r_[True, ~cover[:-1] | (text[1:] != text[:-1])] if len(ids) else cover
    closes = cover & np.r_[~cover[1:] | (text[1:] != text[:-1]), True] if len(ids) else cover
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    a, b = a[b - a >= least], b[b - a >= least]
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not len(a):
        return out
    # Fence, stretch, fence, stretch, ..., fence.
    size = b - a
    start = np.cumsum(size + 1) - size
    fence = np.ones(int(size.sum()) + len(size) + 1, bool)
    place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    fence[place] = False
    symbols = np.cumsum(fence) - 1
    symbols[place] = ids[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())] + len(size) + 1
    found = runs_between(symbols, fence, least)
    of = np.searchsorted(start, found[:, 0], side="right") - 1
    found[:, 0] += a[of] - start[of]
    owner = text[a[of]]
    found[:, 0] -= begin[owner]
    order = np.lexsort((found[:, 2], found[:, 0], owner))
    found, owner = found[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for t in np.unique(owner).tolist():
        out[t] = found[cuts[t] : cuts[t + 1]]
    return out


def kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def in_turns(texts: list[list[bytes]], least: int = LEAST) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, runs) of each text; so many texts at a time as have AT_ONCE words."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
            size += len(texts[end])
            end += 1
        yield from zip(texts[at:end], runs_of(texts[at:end], least), strict=True)
        at = end


def with_runs(docs: DataFrame, name: str = "runs", *, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with `name`, array<struct<start, length, period>> of longs: the runs of at least `least` words, by start and period, in word numbers from 0.

    Words are what stands between ASCII white space. Null, empty and short texts have no runs; texts are read whole;
    repeated rows get the same runs; an empty table gives an empty result. Columns stay, whatever their names; an
    own column named `name` is an error.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {name} already")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` array<struct<start: bigint, length: bigint, period: bigint>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [words_of(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            made = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()] for _, runs in in_turns(texts, least)], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def collapsed(docs: DataFrame, *, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with the text's words that no run contains after its first period, joined by one space, in place of the text (null stays null)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            i = b.schema.get_field_index(text)
            texts = b.column(i).to_pylist()
            made = [b" ".join(kept(words, runs)).decode() for words, runs in in_turns([words_of(t) for t in texts], least)]
            column = pa.array([None if t is None else m for t, m in zip(texts, made, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([column if k == i else c for k, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, schema)


def run_digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, alter: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_runs, the longest run (of equal ones the first, then the one of smaller period) as start, length, period, exponent_milli, and digests of all runs and of the collapsed text.

    alter, if given, makes of (doc_id, words) the words that count. Null and empty texts have no words: no runs, null for the longest, and the
    digest of an empty text twice. Repeated rows and null ids pass through; an empty table gives an empty result;
    other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in numbers)}, runs_sha256 string, collapsed_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [words_of(t) for t in b.column("text").to_pylist()]
            if alter:
                texts = [alter(i, words) for i, words in zip(b.column("doc_id").to_pylist(), texts, strict=True)]
            made = []
            for words, runs in in_turns(texts, least):
                best = [None] * 4
                if len(runs):
                    start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                    best = [start, length, period, 1000 * length // period]
                lines = "".join("%d,%d,%d\n" % tuple(r) for r in runs.tolist())
                made.append((len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept(words, runs))).hexdigest()))
            columns = list(zip(*made, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.string()) for c in columns[5:]]], ["doc_id", *numbers, "runs_sha256", "collapsed_sha256"])

    return rows.mapInArrow(run, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words: every tenth document by hash (null hashes as empty) repeats a part of itself to its end."""
    g, rest = divmod(zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), 10)
    n = len(words)
    if rest or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times, more = divmod(n - a, p)
    part = words[a : a + p]
    return words[:a] + part * times + part[:more]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), alter=planted)
