import hashlib
import random
import zlib

import public_tokenizers as P
import pytest
import sentencepiece

from spanloom.llm import conversation_trie as trie
from spanloom.llm import periodic_runs as runs
from spanloom.llm import piece_bpe

MODEL = P.path("piece_bpe_32k.model")
EMPTY = hashlib.sha256(b"").hexdigest()


def slow_runs(w, least):
    """Every period at every place, then only the smallest of each stretch."""
    found, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            smaller = any(all(w[x] == w[x + d] for x in range(i, j + q - d)) for d in range(1, q))
            if j > i and j + q - i >= max(least, 2 * q) and not smaller:
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_against_every_period():
    rnd = random.Random(3)
    for _ in range(600):
        least = rnd.choice([2, 3, 5, 12])
        texts = []
        for _ in range(rnd.randint(0, 5)):
            w = [rnd.choice([b"a", b"b", b"c"][: rnd.randint(1, 3)]) for _ in range(rnd.randint(0, 40))]
            texts.append((w[: rnd.randint(1, 9)] * 10)[: rnd.randint(0, 50)] if rnd.random() < 0.3 else w)
        got = runs.runs_of(texts, least)
        assert [[tuple(r) for r in x.tolist()] for x in got] == [slow_runs(w, least) for w in texts]
        for w, x in zip(texts, got, strict=True):
            dropped = {i for s, length, q in x.tolist() for i in range(s + q, s + length)}
            assert runs.kept(w, x) == [c for i, c in enumerate(w) if i not in dropped]


def test_long_period_and_many_repeats():
    unit = [b"w%d" % i for i in range(7_000)]
    a, b, c = runs.runs_of([unit + unit + unit[:10], [b"x"] * 30_000, unit])
    assert a.tolist() == [[0, 14_010, 7_000]] and b.tolist() == [[0, 30_000, 1]] and not len(c)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a b " * 6, "s"), (None, None, None), (None, "", "s"), (3, "p q r " * 20_000, "s"), (4, " \t\n", "s"), (4, " \t\n", "s"), (5, "é ▁ 日本 x\x00y", None), (6, "ab" * 3_000, "s")]
    return spark.createDataFrame([(*r, "own", 7) for r in rows], "doc_id long, text string, source string, ids_sha256 string, start int")


def test_runs_of_odd_rows(spark, odd):
    out = runs.run_digests(odd)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert by[1] == [(1, 0, 12, 2, 6000, hashlib.sha256(b"0,12,2\n").hexdigest(), hashlib.sha256(b"a b").hexdigest())]
    assert by[None] == [(0, None, None, None, None, EMPTY, EMPTY)] * 2 and len(by[4]) == 2
    assert by[3][0][:5] == (1, 0, 60_000, 3, 20_000_000)
    texts = {r["doc_id"]: r for r in runs.collapsed(odd).collect()}
    assert texts[3]["text"] == "p q r" and texts[3]["start"] == 7 and texts[1]["text"] == "a b"
    assert {r["doc_id"]: r["runs"] for r in runs.with_runs(odd).collect()}[1] == [(0, 12, 2)]
    with pytest.raises(ValueError):
        runs.with_runs(odd, "START")
    assert runs.run_digests(odd.where("false")).count() == runs.collapsed(odd.where("false")).count() == 0


def test_planted_words_follow_the_contract():
    words = [b"%d" % i for i in range(50)]
    for doc_id in range(300):
        h = zlib.crc32(str(doc_id).encode())
        g, n, want = h // 10, len(words), list(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert runs.planted(doc_id, words) == want
    assert runs.planted(None, []) == []


def test_op11_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in runs.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs[:60]:
        words = runs.planted(doc_id, runs.words_of(text))
        if len(words) > 250:
            continue
        want = slow_runs(words, 12)
        assert got[doc_id]["n_runs"] == len(want)
        assert got[doc_id]["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % r for r in want).encode()).hexdigest()


def test_pieces_against_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_bpe.Pieces(MODEL, check=False)
    rnd = random.Random(1)
    for _ in range(4_000):
        text = "".join(rnd.choice(" ▁abeinst.,\n\t\x00é日𠮷<>s/01x́﻿") for _ in range(rnd.randint(0, 24)))
        ids = library.encode(text)
        assert next(iter(own.encode([text]))) == ids
        assert own.decode([1, *ids, 2]) == library.decode([1, *ids, 2])
        some = [rnd.choice([0, 1, 2, 3 + rnd.randrange(256), 198, 172, 240, 259, 260, 264, 28705, rnd.randrange(32_000)]) for _ in range(rnd.randint(0, 8))]
        assert own.decode(some) == library.decode(some)


def test_pieces_without_spaces_to_cut_at():
    own = piece_bpe.Pieces(MODEL)
    texts = ["", None, "  a  b ", "▁", "x" * 3_000, "日本語" * 500]
    fast = list(own.encode(texts))
    own.cuts_at_spaces = False
    assert list(own.encode(texts)) == fast == [own.library.encode(t or "") for t in texts]


def test_pieces_that_the_library_denies():
    own = piece_bpe.Pieces(MODEL)
    own.turn = {**own.turn, "▁t": -1e12}
    own.plain = {**own.plain, "▁t": 5}
    with pytest.raises(ValueError, match="the library encodes"):
        list(own.encode(["t"]))


def test_pieces_of_odd_rows(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = piece_bpe.encoded_digests(odd, path=MODEL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    texts = [r["text"] or "" for r in odd.collect()]
    want = []
    for t in texts:
        ids = library.encode(t, add_bos=True, add_eos=True)
        want.append((len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r)[1:] for r in out.collect()) == sorted(want)
    ids = piece_bpe.with_ids(odd, "doc_ids", path=MODEL)
    back = piece_bpe.with_text(ids, "again", ids="doc_ids", path=MODEL)
    assert back.columns == ["doc_id", "again", "source", "ids_sha256", "start"]
    assert sorted(r["again"] for r in back.collect()) == sorted(t.replace("▁", " ") for t in texts)
    assert piece_bpe.encoded_digests(odd.where("false"), path=MODEL).count() == 0


def slow_trie(sequences):
    members = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        end = ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(len(x) == len(k) + 1 for x in below), leaves, saved, hashlib.sha256(end.encode()).hexdigest()))
    return sorted(map(str, out))


def slow_rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest()[:32], r or "", x or ""))
    own = {c: [y[3:] for y in sorted(v)] for c, v in own.items()}
    return {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + v[h:] for c, v in own.items()}


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("part_turns", [1, 20, 200_000])
def test_trie_against_all_prefixes(spark, part_turns):
    rnd = random.Random(part_turns)
    rows = [(None, 1, "u", "no conversation"), (7, 1, None, None), (7, 1, None, None)]
    for c in [*rnd.sample(range(330), 50), 100]:
        rows += [(c, rnd.choice([t, t, None]), rnd.choice(["u", "a", None]), rnd.choice(["x", "yy", "", None])) for t in range(rnd.randint(1, 8))]
    rows += [(c, t, "u", f"same {t}") for c in range(1000, 1040) for t in range(12)]  # copies, with a shared beginning
    rows += [(c, t, "u", f"same {t}" if t < 9 else f"{c}") for c in range(2001, 2010) for t in range(12)]
    made = trie.trie(trie.rebuilt(trie.turns(spark.createDataFrame(rows, CONVERSATIONS).repartition(3))), part_turns)
    assert sorted(str(tuple(r)) for r in made.collect()) == slow_trie(slow_rebuilt(rows))


def test_trie_of_odd_tables(spark):
    assert trie.trie(trie.turns(spark.createDataFrame([], CONVERSATIONS))).count() == 0
    # Other names, a further column whose name clashes, and a very long conversation.
    rows = [(1, i, "u", "t" * (i % 3), "x") for i in range(3_000)] + [(2, i, "u", "t" * (i % 3), "y") for i in range(2_999)]
    table = spark.createDataFrame(rows, "c long, turn long, who string, said string, turns string")
    made = trie.trie(trie.turns(table, conv_id="c", role="who", text="said"), 500)
    nodes = {r["depth"]: r for r in made.collect()}
    assert len(nodes) == 3_001 and nodes[0]["n_convs"] == 2 and nodes[3_000]["n_convs"] == 1 and nodes[0]["n_leaves"] == 1
    assert nodes[2_999]["ends_sha256"] == hashlib.sha256(b"2").hexdigest() and nodes[0]["saved_tokens"] == sum(i % 3 for i in range(2_999))


def test_ends_of_many_copies(spark):
    ids = [*range(-5_000, 5_000), 10**12]
    rows = spark.createDataFrame([(i, "s") for i in reversed(ids)], "conv_id long, seq string")
    assert [tuple(r) for r in trie.ends(rows).collect()] == [("s", len(ids), -5_000, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]
