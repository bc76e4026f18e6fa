"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

The ranks are compiled into a trie over token bytes. A path of the (nondeterministic) transducer is a
token that was completed and the trie node of the one under way after it; a token may be completed only
after one with which the two together encode to just these two (which makes whole sequences right, too). A state of
the deterministic transducer is the set of paths still alive. Just one of them has completed its token: that token is
what the state gives, the last one of all that was read. From the end of a word on, each token tells where the one before it ended.
States and their transitions are made when first met, kept up to a limit, and then forgotten. Whether a token may
follow another is told from the merges that made both, without merging their bytes again.

Each distinct match of the pattern in a batch of texts is encoded once, all of them side by side, byte by byte, in arrays:
states are numbers, what is known of them is tables. Texts are gathered from that by the places of their words.
"""

from __future__ import annotations

import base64
import hashlib
import string
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memo import held, sliced, uncollected

#: Words that go side by side, whose states are kept until all have ended; with fewer than ALONE left each goes by itself.
WORDS_KEPT, ALONE = 1 << 16, 8
#: Transitions kept (what one round of words adds comes on top); bytes and rows encoded at a time; ids decoded at a time.
MOST_TRANSITIONS, AT_ONCE, ROWS_AT_ONCE, IDS_AT_ONCE = 1_000_000, 1 << 21, 1024, 1 << 14

FACTOR = 0x9E3779B97F4A7C15


class Table:
    """Whole numbers from 0 on to whole numbers from 0 on, looked up and added many at a time."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None):
        self.size, self.keys, self.values = 0, np.full(1 << 10, -1, np.int64), np.zeros(1 << 10, np.int32)
        if keys is not None:
            self.add(keys, values)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        # The upper bits of a product with an odd number near 2**64 over the golden ratio.
        return (keys.astype(np.uint64) * np.uint64(FACTOR) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def one(self, key: int) -> int:
        """The value of one key, -1 if there is none."""
        slot, mask, there = (key * FACTOR & (1 << 64) - 1) >> 65 - len(self.keys).bit_length(), len(self.keys) - 1, self.keys.item
        while (found := there(slot)) != key:
            if found < 0:
                return -1
            slot = slot + 1 & mask
        return self.values.item(slot)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, -1 where there is none."""
        slots = self._slots(keys)
        there = self.keys[slots]
        found = np.where(there == keys, self.values[slots], np.int32(-1))
        todo = np.flatnonzero((there != keys) & (there >= 0))
        slots, mask = slots[todo], len(self.keys) - 1
        while len(todo):
            slots = slots + 1 & mask
            there, wanted = self.keys[slots], keys[todo]
            hit = there == wanted
            found[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (there >= 0)
            todo, slots = todo[on], slots[on]
        return found

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are distinct and not there yet. At least half of the slots stay free."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            full = self.keys >= 0
            old = self.keys[full], self.values[full]
            slots = 1 << (4 * (self.size + len(keys))).bit_length()
            self.size, self.keys, self.values = 0, np.full(slots, -1, np.int64), np.zeros(slots, np.int32)
            self.add(*old)
        self.size += len(keys)
        slots, mask = self._slots(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            own = self.keys[slots] == keys  # of keys that came to one free slot the last one has it
            self.values[slots[own]] = values[own]
            keys, values, slots = keys[~own], values[~own], slots[~own] + 1 & mask


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each of so many, one after another."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def view(kept: array | bytearray, kind: type) -> np.ndarray:
    return np.frombuffer(kept, kind)


def data_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes behind large strings without nulls, where each begins, and its length."""
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), bounds[:-1], np.diff(bounds)


def strings(data: np.ndarray, n: np.ndarray) -> pa.Array:
    """Large strings of so many bytes each."""
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.r_[0, np.cumsum(n)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def closed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether words start, and whether they end, with something other than white space. Empty ones do not."""
    data, first, n = data_of(words)
    starts, ends = n > 0, n > 0
    known = np.zeros(256, np.int8)  # 1: no white space begins or ends with this byte, -1: white space
    known[0x21:0x7F], known[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 1, -1
    for flags, at in ((starts, first), (ends, first + n - 1)):
        kind = np.full(len(words), -1, np.int8)
        kind[n > 0] = known[data[at[n > 0]]]
        flags &= kind > 0
        ask = np.flatnonzero(kind == 0)
        if len(ask):
            chars = pc.utf8_slice_codeunits(words.take(pa.array(ask)), *((0, 1) if flags is starts else (-1, None)))
            flags[ask] = np.fromiter((not c.isspace() for c in chars.to_pylist()), bool, len(ask))
    return starts, ends


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        #: Trie edges by node * 256 + byte, each node's token, and whether it has edges.
        edges: dict[int, int] = {}
        token_at, inner = array("i", [-1]), bytearray(1)
        for data, rank in ranks.items():
            self.bytes_of[rank] = data
            node = 0
            for b in data:
                child = edges.setdefault(node << 8 | b, len(token_at))
                if child == len(token_at):
                    token_at.append(-1)
                    inner.append(0)
                    inner[node] = 1
                node = child
            token_at[node] = rank
        self.edges = Table(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.token_at, self.inner = token_at, inner
        self.length = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        #: Tokens by id; null where an id has none.
        self.tokens = pa.array([b or None for b in self.bytes_of], pa.large_binary())
        #: By token: the two tokens whose merge makes it, () for a single byte, None if merging its bytes does not give it.
        self.halves: dict[int, tuple[int, int] | tuple[()] | None] = {}
        #: Whether a token may follow another, by (the one before + 1) * 2**32 + the token.
        self.fits = Table()
        self._forget()

    def _forget(self) -> None:
        # Paths, each the token before it (-1: none) and its trie node, those of a state from `first` to the next state's; the token that ends in a state.
        self.paths, self.first, self.last = array("i", [-1, 0]), array("q", [0, 1]), array("i", [-1])
        #: States by the bytes of their paths.
        self.number = {self.paths.tobytes(): 0}
        #: Next states by state * 256 + byte, and those that words by themselves have met; which tokens these have found to fit.
        self.next, self.alone, self.fit_alone = Table(), {}, {}

    def _merge(self, data: bytes) -> Iterator[list[bytes]]:
        """The parts of the bytes before each merge of the pair of lowest rank, the first of equals, and after the last."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.bytes_of)
        while True:
            yield parts
            rank, i = min(((self.ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1)), default=(none, 0))
            if rank == none:
                return
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]

    def merged(self, data: bytes) -> list[int]:
        """Ids of the bytes by merging, without the transducer."""
        *_, parts = self._merge(data)
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple:
        if (found := self.halves.get(token, 0)) == 0:
            *before, last = self._merge(self.bytes_of[token])
            found = None if len(last) > 1 else tuple(self.ranks[p] for p in before[-1]) if before else ()
            # Merges of a trained vocabulary have lower ranks than what they lead to; a token of another kind is never taken inside.
            if found and max(found) > token:
                raise ValueError(f"token {token} has a lower rank than what it is merged from")
            self.halves[token] = found
        return found

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether merging the bytes of both gives just these two.

        It does unless, when both are taken apart again from their latest merge on, the tokens that meet between them
        would have been merged earlier. Of equal ranks the merge further left is the earlier one.
        """
        found = self._halves(token) is not None
        if found and before >= 0:
            left, right, limit = before, token, len(self.bytes_of)
            while True:
                if self.ranks.get(self.bytes_of[left] + self.bytes_of[right], limit) < limit:
                    found = False
                    break
                of_left, of_right = self._halves(left), self._halves(right)
                if of_left and (not of_right or left > right):
                    limit, left = left, of_left[1]
                elif of_right:
                    limit, right = right + 1, of_right[0]
                else:
                    break
        return found

    def _fit(self, pairs: np.ndarray) -> np.ndarray:
        found = self.fits.get(pairs)
        if (new := found < 0).any():
            keys, back = np.unique(pairs[new], return_inverse=True)
            made = np.fromiter((self._may_follow((k >> 32) - 1, k & 0xFFFFFFFF) for k in keys.tolist()), np.int32, len(keys))
            self.fits.add(keys, made)
            found[new] = made[back]
        return found > 0

    def _steps(self, keys: np.ndarray) -> np.ndarray:
        """Next states by transitions (state * 256 + byte) that are not known yet."""
        keys, back = np.unique(keys, return_inverse=True)
        state, byte = keys >> 8, keys & 255
        first = view(self.first, np.int64)
        n = first[state + 1] - first[state]
        paths, own = view(self.paths, np.int32).reshape(-1, 2)[spread(first[state], n)], np.repeat(np.arange(len(keys)), n)
        del first  # what is seen through numpy cannot grow
        child = self.edges.get(paths[:, 1].astype(np.int64) << 8 | byte[own])
        there = child >= 0
        child, own, before = child[there], own[there], paths[there, 0]
        token, on = view(self.token_at, np.int32)[child], view(self.inner, bool)[child]
        ends = np.flatnonzero(token >= 0)
        ends = ends[self._fit((before[ends].astype(np.int64) + 1) << 32 | token[ends])]
        if (own[ends][1:] == own[ends][:-1]).any():
            raise ValueError("bytes that two sequences of tokens encode")
        last = np.full(len(keys), -1, np.int32)
        last[own[ends]] = token[ends]
        # Paths stay in the order in which their tokens begin; that whose token ends here comes last.
        paths = np.stack([np.r_[before[on], token[ends]], np.r_[child[on], np.zeros(len(ends), np.int32)]], axis=1)
        own = np.r_[own[on], own[ends]]
        order = np.argsort(own, kind="stable")
        paths, own = paths[order], own[order]
        raw, bounds = paths.tobytes(), (paths.itemsize * 2 * np.searchsorted(own, np.arange(len(keys) + 1))).tolist()
        number, to, new = self.number, [], []
        size = len(number)
        for k, (start, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if (at := number.setdefault(raw[start:end], size)) == size:
                size += 1
                new.append(k)
            to.append(at)
        fresh = np.zeros(len(keys), bool)
        fresh[new] = True
        self.paths.frombytes(paths[fresh[own]].tobytes())
        self.first.frombytes((self.first[-1] + np.cumsum(np.bincount(own, minlength=len(keys))[new])).tobytes())
        self.last.frombytes(last[new].tobytes())
        made = np.array(to, np.int32)
        self.next.add(keys, made)
        return made[back]

    def _step(self, state: int, byte: int) -> int:
        """The same for one transition, which is not added to those known."""
        found, last = array("i"), -1
        for at in range(2 * self.first[state], 2 * self.first[state + 1], 2):
            before = self.paths[at]
            if (child := self.edges.one(self.paths[at + 1] << 8 | byte)) < 0:
                continue
            if self.inner[child]:
                found.extend((before, child))
            if (token := self.token_at[child]) >= 0:
                pair = before + 1 << 32 | token
                if (fit := self.fit_alone.get(pair)) is None:
                    fit = self.fit_alone[pair] = self.fits.one(pair) > 0 or self._may_follow(before, token)
                if fit:
                    last = token
        if last >= 0:
            found.extend((last, 0))
        if (to := self.number.setdefault(found.tobytes(), len(self.last))) == len(self.last):
            self.paths.extend(found)
            self.first.append(self.first[-1] + len(found) // 2)
            self.last.append(last)
        return to

    def _by_itself(self, state: int, data: bytes) -> np.ndarray:
        """The tokens that end at each byte, from a state on."""
        known, states = self.alone, []
        for b in data:
            key = state << 8 | b
            if (to := known.get(key)) is None:
                if (to := self.next.one(key)) < 0:
                    to = self._step(state, b)
                known[key] = to
            state = to
            states.append(state)
        return view(self.last, np.int32)[states]

    def _side_by_side(self, data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.next.size + len(self.alone) > MOST_TRANSITIONS:
            self._forget()
        if self.fits.size > MOST_TRANSITIONS:
            self.fits = Table()
        first = np.cumsum(n) - n
        token = np.empty(len(data), np.int32)
        order = np.argsort(-n, kind="stable")
        at, state = first[order], np.zeros(len(n), np.int64)
        for i, going in enumerate(np.searchsorted(-n[order], -np.arange(n.max(initial=0))).tolist()):
            if going < ALONE:
                for start, end, s in zip((at[:going] + i).tolist(), (at + n[order])[:going].tolist(), state[:going].tolist(), strict=True):
                    token[start:end] = self._by_itself(s, data[start:end].tobytes())
                break
            here = at[:going] + i
            keys = state[:going] << 8 | data[here]
            to = self.next.get(keys)
            if (new := to < 0).any():
                to[new] = self._steps(keys[new])
            state[:going] = to
            token[here] = view(self.last, np.int32)[to]
        # Back from the ends; a word in whose last state no token ends is merged by itself.
        end = first + n - 1
        odd = token[end] < 0
        taken, end, first = np.zeros(len(data), bool), end[~odd], first[~odd]
        while len(end) >= ALONE:
            taken[end] = True
            end = end - self.length[token[end]]
            more = end >= first
            end, first = end[more], first[more]
        for stop, start in zip(end.tolist(), first.tolist(), strict=True):
            own, stops = token[start : stop + 1].tolist(), []
            at = stop - start
            while at >= 0:
                stops.append(start + at)
                at -= len(self.bytes_of[own[at]])
            taken[stops] = True
        counts = np.add.reduceat(taken, np.cumsum(n) - n, dtype=np.int64)
        ids = token[taken]
        if odd.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(odd).tolist():
                start = n[:k].sum()
                parts[k] = np.array(self.merged(data[start : start + n[k]].tobytes()), np.int32)
            ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, counts

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches of the pattern, one after another, and how many each has: the token that it is, else what merging its bytes gives. No match is empty."""
        words = words.cast(pa.large_binary())
        whole = pc.fill_null(pc.index_in(words, value_set=self.tokens), -1).to_numpy()
        cut, counts = whole < 0, np.ones(len(words), np.int64)
        data, first, n = data_of(words)
        first, n = first[cut], n[cut]
        made = [self._side_by_side(data[spread(first[at : at + WORDS_KEPT], n[at : at + WORDS_KEPT])], n[at : at + WORDS_KEPT]) for at in range(0, len(n), WORDS_KEPT)]
        if made:
            counts[cut] = np.concatenate([n for _, n in made])
        ids, by_merges = np.empty(counts.sum(), np.int32), np.repeat(cut, counts)
        ids[~by_merges] = whole[~cut]
        if made:
            ids[by_merges] = np.concatenate([i for i, _ in made])
        return ids, counts


class Codec:
    """Encoding and decoding of whole texts by one vocabulary and pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.transducer = Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.pattern = regex.compile(pattern)
        self.bytes_of = self.transducer.bytes_of
        #: All tokens' bytes, one after another, and where each one's are.
        self.bytes, self.n_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8), self.transducer.length
        self.first_byte = np.cumsum(self.n_bytes) - self.n_bytes
        #: Each id's decimal digits and a comma, filled up with zero bytes.
        decimal = np.char.add(np.arange(len(self.bytes_of)).astype(bytes), b",")
        self.decimal = decimal.view(np.uint8).reshape(len(decimal), -1)

    def _matches(self, words: pa.Array, more: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Matches of the pattern in words with a space before each, then in more texts: the distinct ones, their numbers, and where those of a word begin and how many it has.

        In words whose lines are letters and then ASCII marks, if any, the letters are one match, with the space before them, the marks
        another, and a line's end a third. The pattern cuts all others.
        """
        split = pc.split_pattern(words, "\n")
        lines, bounds = split.values, split.offsets.to_numpy().astype(np.int64)
        coded = pc.utf8_rtrim(lines, string.punctuation).dictionary_encode()
        letters = np.fromiter(map(str.isalpha, coded.dictionary.to_pylist()), bool, len(coded.dictionary))[coded.indices.to_numpy()]
        of_word = np.repeat(np.arange(len(words)), np.diff(bounds))
        plain = np.ones(len(words), bool)
        plain[of_word[~letters]] = False
        here = np.flatnonzero(plain[of_word])
        opens = np.zeros(len(lines), bool)
        opens[bounds[:-1]] = True
        opens = opens[here]
        stems = coded.dictionary.take(coded.indices.take(pa.array(here)))
        spaced, bare = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), stems.filter(pa.array(opens)), pa.scalar(" ", pa.large_string())), stems.filter(pa.array(~opens))
        data, first, n = data_of(lines)
        marks = n[here] - data_of(stems)[2]
        tails = strings(data[spread((first + n)[here] - marks, marks)], marks).filter(pa.array(marks > 0))
        cut = [self.pattern.findall(" " + w) for w in words.filter(pa.array(~plain)).to_pylist()] + [self.pattern.findall(t) for t in more]
        found = pa.concat_arrays([spaced, bare, tails, pa.array(["\n"], pa.large_string()), pa.array([m for own in cut for m in own], pa.large_string())]).dictionary_encode()
        number = found.indices.to_numpy().astype(np.int64)
        # By line: its end of the line before, its letters, its marks.
        slots = np.full((len(here), 3), -1, np.int64)
        at = np.cumsum([0, len(spaced), len(bare), len(tails), 1])
        slots[opens, 1], slots[~opens, 1], slots[marks > 0, 2], slots[~opens, 0] = number[: at[1]], number[at[1] : at[2]], number[at[2] : at[3]], number[at[3]]
        n_matches = np.zeros(len(words) + len(more), np.int64)
        n_matches[: len(words)] = np.bincount(of_word[here], (slots >= 0).sum(axis=1), len(words))
        start = np.cumsum(n_matches) - n_matches
        flat = slots[slots >= 0]
        others = np.r_[np.flatnonzero(~plain), len(words) + np.arange(len(more))]
        n_matches[others] = np.fromiter(map(len, cut), np.int64, len(cut))
        start[others] = len(flat) + np.cumsum(n_matches[others]) - n_matches[others]
        return found.dictionary, np.r_[flat, number[at[4] :]], start, n_matches

    def _arrays(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.split_pattern(texts, " ")
        coded = split.values.dictionary_encode()
        words, code, bounds = coded.dictionary, coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
        # Nothing is joined across a space between others than white space; words with white space at an end stay with their neighbours.
        starts, ends = closed(words)
        opens = np.zeros(len(code), bool)
        opens[bounds[:-1]] = True
        begins = opens.copy()
        begins[1:] |= ends[code[:-1]] & starts[code[1:]]
        unit = np.flatnonzero(begins)
        length = np.diff(np.r_[unit, len(code)])
        own, place = code[unit], {}
        others = np.flatnonzero(opens[unit] | (length > 1))
        parts = words.take(pa.array(code[spread(unit[others], length[others])])).to_pylist()
        at, made = 0, []
        for n, first in zip(length[others].tolist(), opens[unit[others]].tolist(), strict=True):
            text = " ".join(parts[at : at + n])
            made.append(len(words) + place.setdefault(text if first else " " + text, len(place)))
            at += n
        own[others] = made
        found, match, start, n = self._matches(words, list(place))
        ids, n_ids = self.transducer.encode(found)
        # Ids by match, by unit, by text.
        match = match[spread(start, n)]
        ids = ids[spread((np.cumsum(n_ids) - n_ids)[match], n_ids[match])]
        ends = np.r_[0, np.cumsum(n_ids[match])][np.r_[0, np.cumsum(n)]]
        n = np.diff(ends)[own]
        ids = ids[spread(ends[own], n)]
        stops = np.r_[0, np.cumsum(n)][np.searchsorted(unit, bounds)].tolist()
        yield from (ids[s:e] for s, e in zip(stops, stops[1:], strict=False))

    def arrays(self, texts: list[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null is encoded as empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(data_of(texts)[2])
        at = 0
        while at < len(texts):
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE)) + 1
            yield from self._arrays(texts.slice(at, stop - at))
            at = stop

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        return (ids.tolist() for ids in self.arrays(texts))

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        return self.bytes[spread(self.first_byte[ids], self.n_bytes[ids])].tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal digits, joined by commas."""
        digits = self.decimal[ids].ravel()
        return digits[digits > 0].tobytes()[:-1]


def codec(path: str, pattern: str) -> Codec:
    return held(("codec", path, pattern), lambda: Codec(path, pattern))


def _utf8_steps() -> list[list[int]]:
    """STEPS[state][byte]: state 0 is between characters, 1 to 3 wait for so many continuation bytes, 4 to 7 are those whose next byte is limited, -1 is not UTF-8."""
    steps = [[-1] * 256 for _ in range(8)]
    for state, ranges in enumerate((
        ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE1, 0xEC, 2), (0xEE, 0xEF, 2), (0xF1, 0xF3, 3), (0xE0, 0xE0, 4), (0xED, 0xED, 5), (0xF0, 0xF0, 6), (0xF4, 0xF4, 7)),
        ((0x80, 0xBF, 0),), ((0x80, 0xBF, 1),), ((0x80, 0xBF, 2),),
        ((0xA0, 0xBF, 1),), ((0x80, 0x9F, 1),), ((0x90, 0xBF, 2),), ((0x80, 0x8F, 2),),
    )):
        for low, high, to in ranges:
            steps[state][low : high + 1] = [to] * (high + 1 - low)
    return steps


UTF8_STEPS = _utf8_steps()


class StreamDecoder:
    """Ids in pieces to bytes in pieces, each of which ends between characters; bytes that are not UTF-8 pass as they are."""

    def __init__(self, bytes_of: list[bytes], joined: Callable[[Iterable[int]], bytes] | None = None):
        self.joined, self.held = joined or (lambda ids: b"".join(map(bytes_of.__getitem__, ids))), b""

    def feed(self, ids: Iterable[int]) -> bytes:
        data = self.held + self.joined(ids)
        # Only the last character can be open: from its first byte on the state machine tells.
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] >= 0xC0:
                state = 0
                for b in data[len(data) - back :]:
                    state = UTF8_STEPS[state][b] if state >= 0 else -1
                cut = len(data) - back if state > 0 else cut
                break
            if data[-back] < 0x80:
                break
        self.held = data[cut:]
        return data[:cut]

    def end(self) -> bytes:
        """What is left, an open character's bytes."""
        rest, self.held = self.held, b""
        return rest


def with_ids(docs: DataFrame, name: str = "ids", *, text: str = "text", path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with the text column replaced by its ids, array<int>, as `name`. Null and empty texts have no ids."""
    schema = ", ".join(f"`{name}` array<int>" if f.name == text else f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                i = part.schema.get_field_index(text)
                made = pa.array(codec(path, pattern).encode(part.column(i).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([made if k == i else part.column(k) for k in range(part.num_columns)], [name if k == i else part.schema.names[k] for k in range(part.num_columns)])

    return docs.mapInArrow(run, schema)


def encoded_digests(docs: DataFrame, *, path: str, pattern: str = public_tokenizers.PATTERN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the bytes that the ids decode to), one row per row of docs.

    Null counts as empty: no ids, digests of nothing. Texts of any length are encoded whole and decoded in
    pieces; repeated rows and null ids pass through; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, ROWS_AT_ONCE, key=("codec", path, pattern)):
            made = []
            own = codec(path, pattern)
            with uncollected():
                for ids in own.arrays(b.column("text")):
                    decoder, digest, decimals = StreamDecoder(own.bytes_of, own.joined), hashlib.sha256(), hashlib.sha256()
                    for at in range(0, len(ids), IDS_AT_ONCE):
                        part = ids[at : at + IDS_AT_ONCE]
                        digest.update(decoder.feed(part))
                        decimals.update(b"," * (at > 0) + own.decimals(part))
                    digest.update(decoder.end())
                    made.append((len(ids), decimals.hexdigest(), digest.hexdigest()))
            n, a, d = map(list, zip(*made, strict=True)) if made else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
