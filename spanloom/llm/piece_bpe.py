"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda.

The agenda holds the adjacent pairs of symbols whose joined string is a piece, best score first and, of equal scores, the
one further left. Taking the first pair joins its symbols and adds the pairs that these now form with their neighbours;
pairs whose symbols have changed meanwhile are passed over. What is left when the agenda is empty is the encoding;
symbols that are no piece become the pieces of their bytes.

No pair is ever joined across two characters that stand next to each other in no piece. So texts are cut
before spaces that follow something else (if the vocabulary allows), and these parts between any two such characters;
both are encoded by themselves and remembered in bounded memory. All parts that a batch meets for the first time are
given to the sentencepiece library as well, which must agree.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memo import Memo, held, sliced, uncollected

#: Parts that a Python worker remembers (twice as many at most), and the longest of them; characters encoded at a time.
PARTS_KEPT, LONGEST_KEPT, AT_ONCE = 400_000, 64, 1 << 20
#: The sign that stands for a space in pieces, and what invalid bytes are decoded to.
SPACE_SIGN, INVALID = "▁", "�"
# Fixed values of the model format: kinds of pieces, and the merge type of a model.
UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE, MERGES = 2, 3, 4, 5, 6, 2


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a serialised message: ints, 4-byte floats, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 5:
            yield key >> 3, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            size = varint() if kind == 2 else 8
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """A merge-type vocabulary: encoding of whole texts by the agenda, and decoding.

    Models of another type, with a table of normalisations, with white space to be removed or with user-defined or
    unused pieces are refused.
    """

    def __init__(self, path: str, check: bool = True):
        with open(path, "rb") as f:
            data = f.read()
        self.strings: list[str] = []
        kinds, scores, trainer, normaliser = [], [], {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.strings.append(piece[1].decode())
                scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, 1))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        if trainer.get(3, 1) != MERGES or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("not a merge-type model of plain pieces")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24):
            raise ValueError("the model normalises its texts")
        self.prefixed, self.fallback = bool(normaliser.get(3, 1)), bool(trainer.get(35))
        self.unknown, self.begin, self.end = kinds.index(UNKNOWN), trainer.get(41, 1), trainer.get(42, 2)
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.plain = {s: i for i, (s, k) in enumerate(zip(self.strings, kinds, strict=True)) if k == 1}
        #: Larger is later: the agenda takes the smallest first.
        self.turn = {s: -scores[i] for s, i in self.plain.items()}
        self.byte_of = {i: int(s[3:5], 16) for i, (s, k) in enumerate(zip(self.strings, kinds, strict=True)) if k == BYTE}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        #: What each id decodes to, as UTF-8: nothing for control pieces, one byte for byte pieces.
        self.surface = [b"" if k == CONTROL else bytes([self.byte_of[i]]) if k == BYTE else self.unknown_text.encode() if k == UNKNOWN else s.replace(SPACE_SIGN, " ").encode() for i, (s, k) in enumerate(zip(self.strings, kinds, strict=True))]
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        #: Pairs of characters that some piece has next to each other, and whether a space after something else is always the start of a symbol.
        self.adjacent = {s[i : i + 2] for s in self.plain for i in range(len(s) - 1)}
        self.cuts_at_spaces = self.prefixed and not any(p[1] == SPACE_SIGN != p[0] for p in self.adjacent)
        self.parts = Memo(self._parts, PARTS_KEPT, LONGEST_KEPT)
        self.atoms = Memo(lambda atoms: list(map(self._atom, atoms)), PARTS_KEPT // 2, LONGEST_KEPT)
        self.library = None
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def agenda(self, text: str) -> list[str]:
        """The symbols that are left of the text's characters."""
        symbols, turn = list(text), self.turn
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        waiting = [(turn[pair], i, pair) for i in range(n - 1) if (pair := symbols[i] + symbols[i + 1]) in turn]
        heapify(waiting)
        while waiting:
            _, i, pair = heappop(waiting)
            own, j = symbols[i], after[i]
            if not own or j < 0 or own + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (new := pair + symbols[k]) in turn:
                    heappush(waiting, (turn[new], i, new))
            if (k := before[i]) >= 0 and (new := symbols[k] + pair) in turn:
                heappush(waiting, (turn[new], k, new))
        return [s for s in symbols if s]

    def _atom(self, text: str) -> list[int]:
        """Ids of a text that is not cut any further."""
        plain, out = self.plain, []
        for s in self.agenda(text):
            if (i := plain.get(s)) is not None:
                out.append(i)
            elif self.fallback:
                out += map(self.id_of_byte.__getitem__, s.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _cut(self, text: str) -> list[str]:
        """The text between characters that no piece has next to each other. A short word of letters is only cut from what follows it: cutting saves work, results do not depend on it."""
        if len(text) <= LONGEST_KEPT and text[1:-1].isalpha():
            return [text] if text[-2:] in self.adjacent else [text[:-1], text[-1]]
        joined = bytes(map(self.adjacent.__contains__, map(add, text, text[1:])))
        parts, at = [], 0
        while (cut := joined.find(0, at)) >= 0:
            parts.append(text[at : cut + 1])
            at = cut + 1
        parts.append(text[at:])
        return parts

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts in which spaces are written as their sign."""
        cut = [self._cut(t) for t in texts]
        known = self.atoms.learn([a for atoms in cut for a in atoms])
        out = []
        for atoms in cut:
            if len(atoms) == 1:
                out.append(known[atoms[0]])
                continue
            ids: list[int] = []
            for a in atoms:
                more = known[a]
                ids += more[1:] if ids and more and ids[-1] == more[0] == self.unknown else more
            out.append(ids)
        return out

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Packed ids of parts of texts, each without the space that it starts with."""
        ids = self._ids([SPACE_SIGN + p.replace(" ", SPACE_SIGN) for p in parts])
        if self.library and ids != (library := self.library.encode(parts, num_threads=1)):
            for p, own, theirs in zip(parts, ids, library, strict=True):
                if own != theirs and p:  # the library gives nothing for an empty text
                    raise ValueError(f"the library encodes {p!r} as {theirs}, not {own}")
        return [array("i", x).tobytes() for x in ids]

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text, without begin and end; null and empty texts have none."""
        if not self.cuts_at_spaces:
            for t in texts:
                yield from self._ids([(SPACE_SIGN * self.prefixed + t.replace(" ", SPACE_SIGN)) if t else ""])
            return
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and size < AT_ONCE:
                text = (texts[at] or "").replace(SPACE_SIGN, " ")
                split.append(() if not text else re.findall(" ( *[^ ]*)", " " + text) if text[0] == " " or "  " in text else text.split(" "))
                size += len(text)
                at += 1
            known = self.parts.learn([p for parts in split for p in parts])
            for parts in split:
                yield array("i", b"".join(map(known.__getitem__, parts))).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: the first space goes if the model puts one before each text, bytes that are no UTF-8 are replaced one by one."""
        lead = b" " if self.prefixed else b""
        data = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if i not in self.control), None)
        try:
            text = data.decode() if self.control.isdisjoint(ids[1:-1]) else self._decode_runs(ids)
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        # An unknown or byte piece has no space sign to give up.
        drop = first is not None and lead and first not in self.byte_of and first != self.unknown and text[:1] == " "
        return text[1:] if drop else text

    def _decode_runs(self, ids: list[int]) -> str:
        out, run = [], bytearray()

        def end() -> None:
            at = 0
            while at < len(run):
                size = next((n for n in (1, 2, 3, 4) if _valid(run[at : at + n], n)), 0)
                out.append(run[at : at + size].decode() if size else INVALID)
                at += size or 1
            run.clear()

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
            else:
                end()
                out.append(self.surface[i].decode())
        end()
        return "".join(out)


def _valid(data: bytes, size: int) -> bool:
    """Whether these are the bytes of one character."""
    try:
        return len(data) == size and len(bytes(data).decode()) == 1
    except UnicodeDecodeError:
        return False


def pieces(path: str) -> Pieces:
    return held(("pieces", path), lambda: Pieces(path))


def encoded_digests(docs: DataFrame, *, path: str, doc_id: str = "doc_id", text: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the decoded text in UTF-8), one row per row of docs.

    Null counts as empty: only begin and end ids, and the digest of an empty text. Texts of any length are encoded
    whole; repeated rows and null ids pass through; an empty table gives an empty result. Other columns of docs, whatever
    their names, are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, key=("pieces", path)):
            made, own = [], pieces(path)
            first, last = [own.begin] * begin, [own.end] * end
            with uncollected():
                for ids in own.encode(b.column("text").to_pylist()):
                    ids = [*first, *ids, *last]
                    packed = array("I", ids)
                    if struct.pack("=I", 1) != struct.pack("<I", 1):
                        packed.byteswap()
                    made.append((len(ids), hashlib.sha256(packed.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
            n, a, d = map(list, zip(*made, strict=True)) if made else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_ids(docs: DataFrame, name: str = "ids", *, text: str = "text", path: str) -> DataFrame:
    """docs with the text column replaced by its ids, array<int>, as `name`, without begin and end. Null and empty texts have no ids."""
    schema = ", ".join(f"`{name}` array<int>" if f.name == text else f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, key=("pieces", path)):
            i = b.schema.get_field_index(text)
            with uncollected():
                made = pa.array(list(pieces(path).encode(b.column(i).to_pylist())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([made if k == i else b.column(k) for k in range(b.num_columns)], [name if k == i else b.schema.names[k] for k in range(b.num_columns)])

    return docs.mapInArrow(run, schema)


def with_text(rows: DataFrame, name: str = "text", *, ids: str = "ids", path: str) -> DataFrame:
    """rows with the column of ids replaced by the text that they decode to, as `name`. Null ids give a null text."""
    schema = ", ".join(f"`{name}` string" if f.name == ids else f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, key=("pieces", path)):
            i = b.schema.get_field_index(ids)
            made = pa.array([None if x is None else pieces(path).decode(x) for x in b.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([made if k == i else b.column(k) for k in range(b.num_columns)], [name if k == i else b.schema.names[k] for k in range(b.num_columns)])

    return rows.mapInArrow(run, schema)


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path=public_tokenizers.path("piece_bpe_32k.model"))
