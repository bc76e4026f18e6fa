import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash

from spanloom.llm import byte_bpe, embedding_dedup, exact_dedup, license_scan, mixing, sharding, simhash, token_output, toxicity, url_filter
from spanloom.llm.common import components

DOCS = "doc_id long, text string, source string"
ODD = [
    (1, "A b c d e", "s1"),
    (2, "a B c d e", "s2"),
    (None, "a b c d e", None),
    (3, "", "s1"),
    (4, None, "s1"),
    (5, "x y \t\n z", "s2"),
    (5, "x y \t\n z", "s2"),
    (6, "word " * 30_000, "s3"),
    (7, "é" * 2_000, "s3"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def labels_of(n, linked):
    label = np.arange(n)
    while True:
        new = np.array([label[linked[i]].min() for i in range(n)])
        if (new == label).all():
            return label
        label = new


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    linked = np.eye(300, dtype=bool)
    for a, b in edges:
        linked[a, b] = linked[b, a] = True
    expected = labels_of(300, linked)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == expected[i] for i in range(300))


def test_exact_dedup(spark, odd):
    _, rows, _, _ = exact_dedup.located_rows(odd, "doc_id", "text")
    for digest in (exact_dedup.sha256, lambda data: b"same"):  # all texts under one digest must come apart again
        got = exact_dedup.decide(rows, digest=digest).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == Counter(
            [(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (5, 5, 2, False), (6, 6, 1, True), (7, 7, 1, True)]
        )
    clash = odd.withColumn("loc_file", odd.source).withColumn("Kept", odd.source)
    assert exact_dedup.dedup(clash).columns == clash.columns and exact_dedup.dedup(clash).count() == 5
    assert exact_dedup.dedup(odd.limit(0)).count() == 0


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    first = spark.createDataFrame([(b"k", 1, "f", 0), (b"l", 2, "f", 1)], "digest binary, doc_id long, file string, row long")
    log = str(tmp_path / "log")
    first.write.parquet(log)
    exact_dedup.stream_state(spark, log, first.schema, str(tmp_path / "state"))
    spark.createDataFrame([(b"k", 9, "g", 0)], first.schema).write.mode("append").parquet(log)
    got = exact_dedup.stream_state(spark, log, first.schema, str(tmp_path / "state"))
    assert {bytes(r["digest"]): (r["n"], r["keeper"]["doc_id"]) for r in got.collect()} == {b"k": (2, 9), b"l": (1, 2)}


def test_exact_dedup_compares_with_texts_of_earlier_calls(spark, tmp_path):
    """The second call meets a digest of the first whose text is another, one whose text is the same, and one that the first call had seen twice."""
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, text string, file string, row long")
    digest = lambda data: data[:1]
    first = rows((1, "Aa", "f", 0), (2, "b", "f", 1), (3, "c1", "f", 2), (4, "c2", "f", 3))
    second = rows((5, "ab", "g", 0), (6, "B", "g", 1), (7, "C1", "g", 2), (8, "d", "g", 3))
    of = lambda df: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())
    state = "file://" + str(tmp_path / "state")
    assert of(exact_dedup.decide(first, digest=digest, state_dir=state)) == [(1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 1, True)]
    got = of(exact_dedup.decide(second, digest=digest, state_dir=state, earlier=first))
    assert got == [(5, 5, 1, True), (6, 6, 2, True), (7, 7, 2, True), (8, 8, 1, True)]


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "one", "one two", "A b c", "é Ü a\x0bb c\x1cd e", "a b c d " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_gray_rank_is_the_place_in_the_gray_sequence():
    i = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(i ^ (i >> np.uint64(1))) == i).all()


@pytest.mark.parametrize("chunk", [30, 20_000])
def test_simhash_links(spark, chunk):
    rng = np.random.default_rng(2)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40, 4)).astype(np.uint64), axis=1) for b in rng.integers(0, 2**63, 15, dtype=np.uint64)]
    codes = np.unique(np.concatenate([*near, rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    expected = labels_of(len(codes), np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3)
    signed = codes.view(np.int64).tolist()
    got = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), 3, chunk)).collect()}
    groups = {}
    for i, c in enumerate(signed):
        groups.setdefault(got.get(c, c), set()).add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(np.flatnonzero(expected == x).tolist()) for x in set(expected)}


def test_near_dedup_keeps_one_of_each_group(spark, odd):
    assert sorted(r["doc_id"] for r in simhash.near_dedup(odd).collect()) == [1, 3, 5, 6, 7]
    assert simhash.near_dedup(odd.limit(0)).count() == 0


TRICKY = ["áb x", "don't it's", "x\n\n y  z q", "<|endoftext|> a<|startoftext|>b", "ΟΔΥΣΣΕΥΣ Σ\x1cB", "İI ẞ 한글", " \t lead", "tail \n", "end. Next, word; x:y", ""]


def test_token_ids(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    ids = lambda t: plain.encode(t or "", add_special_tokens=False).ids
    assert [np.frombuffer(x, "<u4").tolist() for x in token_output.encode(TRICKY, path)] == [ids(t) for t in TRICKY]
    for kind in ("byte", "bit"):
        for n in (1, 13, token_output.BLOCK):
            block = np.random.default_rng(n).integers(0, 49_000, n)
            assert (token_output.from_planes(token_output.to_planes(block, kind), n) == block).all()
        token_output.write_ids(odd, str(tmp_path / kind), tokenizer=path, kind=kind)
        got = sorted(token_output.read_ids(spark, str(tmp_path / kind)).collect(), key=lambda r: r["start"])
        start = 0
        for r, (doc_id, text, _) in zip(got, sorted(ODD, key=lambda d: (d[0] is not None, d[0] or 0)), strict=True):
            assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (doc_id, start, [*ids(text), 1])
            start += len(r["ids"]) // 4
    token_output.write_ids(odd.limit(0), str(tmp_path / "none"), tokenizer=path)
    assert token_output.read_ids(spark, str(tmp_path / "none")).count() == 0


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "Foo<|endoftext|>Bar. <|startoftext|>baz,", "x.<|endoftext|>, <|endoftext|>\n<|startoftext|><|endoftext|>!", "<|ENDOFTEXT|> <|endoftext| > <|EndOfText|>x É<|endoftext|>É", "<|endoftext|>'s it'<|endoftext|>s 12<|startoftext|>34 <|<|endoftext|>|>", "a\t<|endoftext|>\u00a0b\r\n<|endoftext|>\u0301 e\u0301"]


def test_token_ids_of_added_tokens_are_the_librarys(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = [library.encode(t, add_special_tokens=False).ids for t in SPECIAL]
    assert ids[0] == [320, 49407, 321]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_output.encode(SPECIAL, path, added=True)] == ids
    token_output.write_ids(spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string"), str(tmp_path / "t"), tokenizer=path)
    got = sorted(token_output.read_ids(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [[*x, 1] for x in ids]


def test_token_ids_ask_the_tokenizer_for_stems_together(monkeypatch):
    """Thousands of words that were never seen are few calls and few texts for the library; each distinct word of a batch is looked up once."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghäßñÉ", k=rnd.randint(3, 12))) for _ in range(3_000)]
    odd = ["İstanbul", "ǅabc", "ªº", "ʰx", "日本語", "x</w>y", "it's", "o'clock're", "a1b22", "foo@bar.com", "x\x1cy", "e\u0301a", "\u1100\u1161", "ﬁn"]
    texts = [" ".join(words[:2_000]), None, " ".join(w.title() + rnd.choice(["", ".", "'s", "-7", "&&&"]) for w in words), " ".join(odd), "\n".join(odd) + "<|endoftext|>"] + odd
    asked, batch = [], Tokenizer.encode_batch_fast

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __setattr__(self, name, value):
            object.__setattr__(self, name, value) if name == "inner" else setattr(self.inner, name, value)

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode(self, text, **options):
            asked.append(1)
            return self.inner.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            asked.append(len(texts))
            return batch(self.inner, texts, **options)

    class Source:
        from_file = staticmethod(lambda p: Counted(library))

    monkeypatch.setattr("tokenizers.Tokenizer", Source)
    monkeypatch.setattr(token_output, "held", lambda key, make: make())
    got = [np.frombuffer(x, "<u4").tolist() for x in token_output.encode(texts, path, added=True)]
    assert 2 * sum(asked) < len({w for t in texts for w in (t or "").split()})
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_ids_look_up_each_stem_of_a_batch_once(monkeypatch):
    """Words that differ in case or in what follows them are cut by columns; only their stems are looked up, each once."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(13)
    stems = list({"".join(rnd.choices("abcdefgh", k=9)) for _ in range(400)})
    texts = [" ".join(form(s) + end for s in stems) for form in (str, str.title, str.upper) for end in ("", ".", ",", "'s", "\t\r")]
    looked = []

    class Counted(token_output.Memo):
        def learn(self, words):
            looked.extend(words)
            return super().learn(words)

    monkeypatch.setattr(token_output, "Memo", Counted)
    monkeypatch.setattr(token_output, "held", lambda key, make: make())
    got = [np.frombuffer(x, "<u4").tolist() for x in token_output.encode(texts, path, added=True)]
    assert len(looked) < 2 * len(stems)
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_ids_forget_long_stems(monkeypatch):
    """Blobs without a space are not remembered beyond their batch, or a worker's memory would grow with them."""
    from tokenizers import Tokenizer

    path, made = P.path("word_bpe_49k.json"), []
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(token_output, "AT_ONCE", 3_000)
    monkeypatch.setattr(token_output, "held", lambda key, make: made.append(make()) or made[0])
    rnd = random.Random(14)
    texts = ["".join(rnd.choices("abcdefghé", k=2_000)) + " word" for _ in range(20)]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_output.encode(texts, path, added=True)]
    assert sum(map(len, made[0].young)) < 10_000
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_ids_of_letters_that_come_apart_before_a_mark():
    """Folded or composed, these letters end with a mark of their own, to which the library joins what follows."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["\u0130,", "x \u0130! y", "\ufb1d.", "a\u0958; b", "É, ß."]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_output.encode(texts, path, added=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base[:30] + 0.2 * rng.normal(size=(30, 24)), base[:5], rng.normal(size=(60, 24))]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, True)
    expected = labels_of(len(x), linked)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    for stripe in (20, 4096):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df, stripe=stripe).collect()}
        assert got == {i: (int(linked[i].sum()) - 1, expected[i], expected[i] == i) for i in range(len(x))}
    # Equal leading coordinates of all vectors, and a length that no sample shows: one stripe, in many chunks.
    wide = np.c_[np.full(90, 3.0), rng.normal(size=(90, 6))]
    wide[60:] = wide[:30] + 0.1 * rng.normal(size=(30, 7))
    rest = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate([*wide, *rest])] + [(None, [9.0] * 5), (None, [9.0] * 5)], "vec_id long, embedding array<double>")
    expected = np.zeros((130, 130), bool)
    for at in (slice(0, 90), slice(90, 130)):
        x = np.array([*wide] if at.start == 0 else [*rest])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        expected[at, at] = x @ x.T >= 0.95
    np.fill_diagonal(expected, True)
    least = labels_of(130, expected)
    for sample in (4096, 3):
        monkeypatch.setattr(embedding_dedup, "SAMPLE", sample)
        rows = embedding_dedup.near_vectors(df, stripe=4).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows if r["vec_id"] is not None} == {i: (int(expected[i].sum()) - 1, least[i]) for i in range(130)}
        assert [tuple(r) for r in rows if r["vec_id"] is None] == [(None, 1, None, True)] * 2
    none = spark.createDataFrame([], df.schema)
    assert embedding_dedup.near_vectors(none).collect() == []
    odd = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [])]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    syllables = "ba do ke li mu ra so te".split()
    word = lambda: "".join(rng.choice(syllables, 3))
    rows = []
    for i in range(400):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            words[int(rng.integers(40))] = rng.choice(["grumpf", "zwackel", "quarg"])
        rows.append((i, " ".join(words) + ".", int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train_on(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.with_score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= 0.7) == bool(y) for i, _, y in held]) > 0.97
    of = lambda text: model.probability(model.score_words(toxicity.words_of(text) or [""]))
    assert of("ba q-u-a-r-g") > 0.5 and of("so g r u m p f") > 0.5 and of("zwackkel") > 0.5 > of("baleso")
    odd = spark.createDataFrame(ODD, DOCS)
    assert toxicity.with_score(odd, model).count() == len(ODD) and toxicity.without_toxic(odd, model).columns == odd.columns
    assert {r["score"] for r in toxicity.with_score(odd, toxicity.train([], [])).collect()} == {toxicity.train([], []).probability([0.0])}


def test_subsequence_kernel_against_plain_loops():
    """Feature maps, norms and scores of words, letter by letter."""
    def features(word):
        code = [0, *(int(toxicity._CLASS[ord(c)]) for c in word), 0]
        out, norm = Counter(), 0.0
        for length in (3, 4):
            for places in itertools.combinations(range(len(code)), length):
                if places[-1] - places[0] < toxicity.SPAN:
                    w = toxicity.DECAY ** (places[-1] - places[0] - length + 1)
                    number = 0
                    for at in places:
                        number = number * toxicity.CLASSES + code[at]
                    out[number + (length - 3) * toxicity.CLASSES**3] += w
                    norm += w * w
        return {f: w / max(norm, 1e-12) ** 0.5 for f, w in out.items()}

    words = ["", "a", "ab", "quarg", "qxuarg", "zwackel7", "éßa", "aaaaaaaa"]
    weights = np.random.default_rng(8).normal(size=toxicity.FEATURES)
    maps = [features(w) for w in words]
    assert toxicity.Subsequences(words).dot(weights) == pytest.approx([sum(v * weights[f] for f, v in m.items()) for m in maps])
    kernel = [[sum(v * other.get(f, 0) for f, v in m.items()) for other in maps] for m in maps]
    found, place, columns = toxicity.Subsequences(words).features()
    assert set(found.tolist()) == {f for m in maps for f in m} and (place[found] == np.arange(1, len(found) + 1)).all()
    assert toxicity.to_landmarks(words, columns, place, 3) == pytest.approx(np.array(kernel), abs=1e-5)
    assert kernel[3][4] > 0.5 > kernel[3][5]  # an inserted letter leaves a word close to itself


def test_toxicity_score_of_a_document_against_plain_loops(spark):
    """A document's score from its words, one by one; a score column that is there already is replaced."""
    rng = np.random.default_rng(11)
    slopes = rng.normal(size=toxicity.WORST + 4)
    weights = rng.normal(size=toxicity.FEATURES).astype(np.float32)
    model = toxicity.Model(weights, 0.3, slopes)

    def slow(text):
        words = (text or "").lower().split()
        words += [re.sub(r"[ \t]", "", x) for x in re.findall(r"(?<!\S)\w(?:[ \t]\w){2,}(?!\S)", (text or "").lower())]
        scores = [model.score_words([w])[0] for w in words or [""]]
        top = [min(max(x, -2), 4) for x in sorted(set(scores), reverse=True)[: toxicity.WORST]]
        top += [-2] * (toxicity.WORST - len(top))
        bad = sum(1 / (1 + math.exp(-toxicity.SHARP * (min(max(x, -9), 9) - toxicity.BAD))) for x in scores)
        z = [*top, math.log(1 + bad), math.log(bad + 0.3) - math.log(len(scores) + 20), math.log(len(scores) + 20), 1]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, slopes, strict=True))))

    texts = ["quarg ba do", "Quarg quarg, quarg!", "s p e l l e d out", "", None, "x" * 5000 + " a b", "a b c a b c", "ba do ke li mu " * 300]
    docs = spark.createDataFrame([(i, 7.5, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, score double, text string")
    rows = toxicity.with_score(docs, model).collect()
    assert [c for c in rows[0].asDict()] == ["doc_id", "text", "score"]
    assert {r["doc_id"]: r["score"] for r in rows} == pytest.approx({i: slow(t) for i, t in enumerate([*texts, texts[0]])})
    assert toxicity.with_score(docs.where("false"), model).count() == 0
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_toxicity_counts_how_many_words_are_bad():
    """What looks like an insult by chance says less in a long text, and insults add up."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice("ba do ke li mu ra so te".split(), 3))
    texts, toxic = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = [word() for _ in range(40 if bad else 400)]
        for _ in range(4 if bad else int(i % 10 == 1)):
            words[int(rng.integers(len(words)))] = "bado" + word()[:2] + "kral"
        texts.append(" ".join(words))
        toxic.append(int(bad))
    model = toxicity.train(texts, toxic)
    of = lambda text: model.probability(model.score_words(toxicity.words_of(text)))
    plain = [word() for _ in range(400)]
    assert of(" ".join(["badolikral", "badomukral", "badorakral", *plain[:40]])) > 0.7 > of(" ".join(["badolikral", *plain]))


def test_toxicity_collects_within_its_budget(spark, monkeypatch):
    rows = [(0, f"{i:02} " + "ba do ke li " * 4) for i in range(30)] + [(1, "long " * 1000)] + [(i, f"mu ra so te {i:02}") for i in range(3, 30)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    kept = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert {0, 1} <= set(kept)
    seen, trained, collect = [], [], type(docs).collect
    monkeypatch.setattr(toxicity, "TRAINING_CHARS", 1000)
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: trained.append(sorted(texts)))
    monkeypatch.setattr(type(docs), "collect", lambda self: (out := collect(self), seen.extend(r["text"] for r in out if "text" in r))[0])
    toxicity.train_on(docs, labels)
    assert trained[0] == sorted(f"mu ra so te {i:02}" for i in kept if i > 2) and sum(map(len, seen)) <= 1000


def test_url_filter(spark):
    urls = ["http://A.Example.org/es/1", "http://example.org/en/12", "http://badexample.org/es/1", "http://x.com/fr/1?/de/", "x.com/fr/1", None, "http://com/de/", "http://org", "http://a.org?q=/", "http://x.net/de/"]
    got = [(r["host"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rule_table(spark)).orderBy("page_id").collect()]
    assert got == [("a.example.org", "example.org/es/", "block"), ("example.org", "example.org/en/1", "block"), ("badexample.org", "org/", "allow"), ("x.com", "com/fr/", "allow"), ("", None, "allow"), ("", None, "allow"), ("com", "com/de/", "block"), ("org", None, "allow"), ("a.org", None, "allow"), ("x.net", None, "allow")]
    rules = spark.createDataFrame([], "rule_host string, rule_path string, rule_verdict string")
    assert url_filter.judge_urls(spark.createDataFrame([(1, "http://a.b/c", "r")], "page_id long, url string, rule string"), rules).first()["verdict"] == "allow"


def test_odd_rows_of_native_operators(spark):
    """Repeated rows, null ids, clashing columns in other case, and empty tables."""
    pages = spark.createDataFrame([(1, "http://a.org/x", "s"), (1, "http://a.org/x", "s"), (None, "http://x.com/de/", None), (2, "", "s")], "page_id long, url string, Verdict string")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark))
    assert Counter((r["page_id"], r["rule"], r["verdict"]) for r in got.collect()) == Counter({(1, "org/", "allow"): 2, (None, "com/de/", "block"): 1, (2, None, "allow"): 1})
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).collect() == []
    docs = spark.createDataFrame([(None, "w w", None, "k", 1), (None, "w w", None, "k", 1), (3, None, "a", None, None)], "doc_id long, text string, source string, arc string, draw int")
    shards = sharding.shard(docs, shards=2).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in shards) == [("3", 1), ("None", 4), ("None", 4)] and sorted(Counter(r["shard"] for r in shards).values()) == [1, 2]
    assert sorted((r["size"], r["source_size"]) for r in mixing.mix(docs).collect() if r["doc_id"] is None) == [(2, 4)] * 2


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in names if s not in fixed))
        above = [s for s in names if s not in fixed and level * weight[s] > 3 * sizes[s]]
        if not above:
            return {s: fixed.get(s, level * weight[s]) for s in names}
        fixed |= {s: 3.0 * sizes[s] for s in above}


def test_mixing(spark, odd):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["a", "b", "c", "tiny", None][int(rng.choice(5, p=[0.5, 0.2, 0.2, 0.02, 0.08]))]) for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), bins=64).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    expected = slow_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(expected[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - expected[s]) <= 30 for s in sizes)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(odd.limit(0)).count() == 0


def test_mixing_pareto_order(spark):
    """Inclusion probabilities and the order of the sample against plain loops."""
    rng = np.random.default_rng(16)
    rows = [(i, "w " * int(rng.choice([0, 1, 3, 20, 21, 90, 400], p=[0.05, 0.15, 0.2, 0.2, 0.2, 0.15, 0.05])), "abc"[i % 3] if i % 2 else "a") for i in range(1200)]
    rows += [(7, rows[7][1], rows[7][2])] * 3  # alike with the first
    rows += [(5_000, "w w w w w w w", "c")] * 700 + [(None, "w w", "b")] * 90
    got = mixing.mix(spark.createDataFrame(rows, DOCS), bins=16).collect()
    for source in "abc":
        own = [r for r in got if r["source"] == source]
        total, target = own[0]["source_size"], own[0]["target"]
        certain = int(target / total + 1e-12)
        lacking = target - certain * total
        weigh = lambda size: (size + 1).bit_length()
        low, high = 0.0, 1.0
        for _ in range(200):  # bisection for the scale
            scale = (low + high) / 2
            low, high = (scale, high) if sum(min(1, scale * weigh(r["size"])) * r["size"] for r in own) < lacking else (low, scale)
        assert len({min(1, scale * weigh(r["size"])) for r in own}) > 2 or not lacking
        units = Counter()
        for r in own:
            draw = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16)
            u, p = (draw + 0.5) / 2**52, min(1, scale * weigh(r["size"]))
            units[(u / (1 - u)) / (p / (1 - p)) if p < 1 else 0.0, r["doc_id"], r["size"]] += r["size"]
        start, taken, left = 0, Counter(), Counter()
        for (place, doc, size), words in sorted(units.items(), key=lambda x: (x[0][0], x[0][1] is not None, x[0][1] or 0, x[0][2])):
            n = words // size if size else sum((r["doc_id"], r["size"]) == (doc, size) for r in own)
            fit = 0 if left else n if start + words <= lacking else int((lacking - start) // size)
            taken[doc, size] = fit
            start += fit * size
            if fit < n:
                left[place, doc, size] = n - fit
        gap = lacking - start
        best = min(((abs(gap - size), place, doc is not None, doc or 0, size) for place, doc, size in left if abs(gap - size) < gap), default=None)
        if best:
            taken[best[3] if best[2] else None, best[4]] += 1
        assert Counter((r["doc_id"], r["size"]) for r in own if r["copies"] > certain) == +taken and 0 < sum(taken.values()) < len(own)
        assert all(r["copies"] in (certain, certain + 1) for r in own)


def test_mixing_of_repeated_rows(spark):
    """Half of each source is one row, repeated: so many of it are taken as are needed, also where its draw comes first or last."""
    rows = [(i, "w " * (10 + i % 7), "ab"[i % 2]) for i in range(600)] + [(1_000, "w " * 50, "a")] * 300 + [(1_001, "w " * 50, "b")] * 300
    for seed in ("x", "y", "z"):
        got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(4), seed=seed).collect()
        for source in "ab":
            own = [r for r in got if r["source"] == source]
            assert len(own) == 600 and abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 8


def test_sharding(spark, odd):
    counts = {int(a): int(n) for a, n in zip(*np.unique(np.random.default_rng(7).integers(0, 1024, 5003), return_counts=True), strict=True)}
    where = {}
    for shards in (16, 17):
        per, out = Counter(), sharding.place(counts, shards, 32, 1024)
        for arc, lo, hi, s, first in sorted(out, key=lambda p: (p[3], p[4])):
            assert first == per[s]
            per[s] += hi - lo
            where.setdefault(shards, {}).update({(arc, n): s for n in range(lo, hi)})
        assert max(per.values()) - min(per.values()) <= 1 and len(where[shards]) == 5003
    moved = sum(where[16][k] != where[17][k] for k in where[16]) / 5003
    assert moved < 0.5  # dealing anew would move 16 of 17
    got = sharding.shard(odd, shards=4).collect()
    assert sorted(r["slot"] for r in got if r["shard"] == got[0]["shard"]) == list(range(sum(r["shard"] == got[0]["shard"] for r in got)))
    assert len(got) == len(ODD) and {r["size"] for r in got if r["doc_id"] in (3, 4)} == {1} and sharding.shard(odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_byte_bpe(name):
    import base64
    import random

    import tiktoken

    path = P.path(name)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(8)
    letters = "aeinrstu äößñéÈ 0127.,!?'\n\t  \xa0日本語한글🙂\x1c\x85 -_()"
    texts = TRICKY + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(800)] + ["aeithn" * 300]
    codec = byte_bpe.codec(path, P.PATTERN)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == plain.encode_ordinary(text)
        decoder = byte_bpe.StreamDecoder(codec.bytes_of)
        parts = [decoder.feed([i]) for i in ids] + [decoder.end()]
        assert "".join(p.decode() for p in parts) == text  # each part ends between characters
    assert list(codec.encode([None])) == [[]]


def test_pairs_of_tokens():
    """Which token may follow which, against merging the bytes of both."""
    made = byte_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).transducer
    rng = random.Random(5)
    tokens = [rng.randrange(len(made.bytes_of)) for _ in range(1500)] + list(range(256))
    fits = 0
    for _ in range(6000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if made.merged(made.bytes_of[a]) == [a]:
            slow = made.merged(made.bytes_of[a] + made.bytes_of[b]) == [a, b]
            assert made._may_follow(a, b) == slow, (a, b)
            fits += slow
    assert 500 < fits < 5900


def test_transducer_forgets(monkeypatch):
    """Results stay the same when what is remembered is dropped again and again."""
    monkeypatch.setattr(byte_bpe, "MOST_TRANSITIONS", 50)
    monkeypatch.setattr(byte_bpe, "WORDS_KEPT", 5)
    texts = ["some words, again and again; überall Wörter! niñas: " + "x" * 200 + f" word{i % 7}." for i in range(20)]
    own = byte_bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    tokens = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.transducer.ranks, special_tokens={})
    assert [x for t in texts for x in own.encode([t])] == [tokens.encode_ordinary(t) for t in texts]


def test_byte_bpe_words_side_by_side():
    """New words of known parts take few calls each; lines, marks and spaces are cut as the library cuts them."""
    own = byte_bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng, parts, calls = random.Random(6), ["th", "ing", "ha", "er", "ción", "éa", "on", "wh", "ed", "ß", "que", "ach"], Counter()
    words = list(dict.fromkeys("".join(rng.choice(parts) for _ in range(5)) for _ in range(40_000)))
    known, new = words[:18_000], words[18_000:]
    list(own.encode([" ".join(known)]))
    before = sys.getprofile()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        (ids,) = own.encode([" ".join(new)])
    finally:
        sys.setprofile(before)
    assert calls["call"] + calls["c_call"] < 4 * len(new)
    tokens = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.transducer.ranks, special_tokens={})
    assert ids == tokens.encode_ordinary(" ".join(new))
    between = [" ", "\n", ".\n", "***", ", ", "  ", " \n ", "\n\n", "'s ", "'\n's", "²", "\x1c", "\xa0", "\u3000 ", "1", "́", ""]
    texts = ["".join(rng.choice(between) + rng.choice(words) * rng.randrange(3) for _ in range(12)) for _ in range(500)] + ["", " ", "\n", ". .", "ab" * 4_000]
    assert list(own.encode(texts)) == [tokens.encode_ordinary(t) for t in texts]


def test_byte_bpe_query(spark, odd):
    got = byte_bpe.encoded_digests(odd, path=P.path("byte_bpe_50k.tiktoken"))
    assert got.count() == len(ODD) and got.where("doc_id in (3, 4)").select("n_tokens", "ids_sha256").distinct().count() == 1
    assert byte_bpe.with_ids(odd, path=P.path("byte_bpe_50k.tiktoken")).columns == ["doc_id", "ids", "source"]


def test_license_scan(spark, odd):
    text = "This work is licensed under the GNU General Public License, version 3.\nfoo bar. Either version 3 of the License, or (at your option) any later version! All rights reserved"
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["sentence_ids"], row["licenses"], row["unmatched"]) == (["gpl3", "gpl-any-later", "reserved"], ["GPL-3.0-or-later", "Proprietary"], [])
    assert {tuple(r["licenses"]) for r in license_scan.scan(odd).collect()} == {()}
    assert license_scan.scan(odd.limit(0)).count() == 0


WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
MIT = f"""MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{WARRANTY}
"""
ISC = """Copyright (c) 2004-2010 by Some Consortium

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES."""
GNU = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {0}General Public License as published by
 * the Free Software Foundation, either version {1} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY.
 */"""
BSD2 = """Copyright (c) 2015, Some Firm, Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2) Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = "\n3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
MPL = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/."
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software"""
NOTICES = [
    (MIT, "MIT"), (MIT.replace("\n", "\r\n"), "MIT"), (ISC, "ISC"), (ISC.replace("THE AUTHOR", "SOME CONSORTIUM").replace("and/or", "and"), "ISC"),
    (GNU.format("", 3), "GPL-3.0-or-later"), (GNU.format("", 2), "GPL-2.0-or-later"), (GNU.format("Affero ", 3), "AGPL-3.0-or-later"), (GNU.format("Lesser ", 3), "LGPL-3.0-or-later"),
    (GNU.format("Lesser ", "2.1").replace("program", "library"), "LGPL-2.1-or-later"),
    (BSD2, "BSD-2-Clause"), (BSD2 + BSD3.format("the copyright holder"), "BSD-3-Clause"), (BSD2 + BSD3.format("Some Firm, Inc."), "BSD-3-Clause"), (BSD2.replace("All rights reserved.", "") + BSD3.format("the copyright holder"), "BSD-3-Clause"),
    (MPL, "MPL-2.0"), (APACHE, "Apache-2.0"), ("Intro without a mark\nAll rights reserved.", "Proprietary"), ("Released under.\n\nThe MIT License.", ""),
]


def test_license_scan_finds_genuine_wrapped_notices(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r["doc_id"]: ",".join(r["licenses"]) for r in license_scan.scan(rows).collect()}
    assert [got[i] for i in range(len(NOTICES))] == [x for _, x in NOTICES]
    # Each rule fires on its own sentences, wrapped after every word and with other words for the wild ones.
    known = license_scan.SENTENCES | license_scan.NOTICES
    texts = [(i, "\n\n".join(known[n].replace("*", "any two").replace(" ", "\n") for n in names)) for i, (_, names) in enumerate(license_scan.RULES)]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [[x] for x, _ in license_scan.RULES]
