"""Toxicity by a support vector machine over a gapped subsequence kernel with Nyström landmarks.

The kernel compares two words by the threes and fours of characters that they share in order, gaps allowed: each
occurrence weighs DECAY per skipped character, so insults with inserted, dropped or separated letters stay
close to their plain form. The feature map is normalised by the weights of its occurrences. Training takes
labelled documents as bags of sentences: a toxic document has a toxic sentence, and in it a word that makes it so;
which one is found in rounds (the word of highest score), against all words of clean documents, the hardest
among them. The machine is linear in the kernel values to some landmarks, so for scoring it folds into one
weight per subsequence. A document's score is a probability
fitted to the scores of its worst words, in whichever sentences they stand, and to how many of its words, repeats
included, are bad ones: one word like an insult says less in a long text.
"""

from __future__ import annotations

import heapq
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, written
from .memo import Memo, give_back, held, sliced

#: The training sample: so many toxic and clean documents at most, by the order of a hash of their ids, and so many characters of them.
TOXIC_DOCS, CLEAN_DOCS, TRAINING_CHARS = 1500, 3000, 12_000_000
LANDMARKS, ROUNDS, THRESHOLD = 320, 3, 0.7
#: Words of a document that decide on it.
WORST = 3
#: Logarithm of how much more often a word comes in toxic documents to count as guilty by itself.
STRONG_LIFT = 3.5
#: Span of a subsequence in characters, weight of a skipped one, longest piece of a word looked at in one go and its overlap.
SPAN, DECAY, PIECE, OVERLAP = 6, 0.5, 32, 12
#: Character classes: end of word, letters, digits, others by their number.
CLASSES = 40
#: Words whose scores a Python worker remembers.
WORDS_KEPT = 120_000
#: Places of the characters after the first, for threes and fours; those without gaps first.
OFFSETS = [rest for length in (2, 3) for rest in sorted(combinations(range(1, SPAN), length), key=max)]
FEATURES = CLASSES**3 + CLASSES**4
#: Scores above which a word counts as bad rather than not, and how sharply.
BAD, SHARP = 1.0, 4.0
AT_ONCE, AT_ONCE_WORDS = 1 << 20, 20_000
_SPELLED = re.compile(r"(?<!\S)\w(?:[ \t]\w){2,}(?!\S)")
_OTHER = re.compile(r"[\W_]+")
_CLASS = np.array([1 + c - 97 if 97 <= c <= 122 else 27 + (c - 48) % 2 if 48 <= c <= 57 else 29 + c % (CLASSES - 29) for c in range(0x10000)], np.int64)


def words_of(text: str | None) -> list[str]:
    """Words in lower case, and runs of three or more single characters as one word each."""
    text = (text or "").lower()
    return text.split() + [s.replace(" ", "").replace("\t", "") for s in _SPELLED.findall(text)]


def sentences(text: str | None) -> list[str]:
    return [s for s in re.split(r"[.!?\n]+", text or "") if s.strip()]


def pieces(word: str) -> list[str]:
    """A word without punctuation, cut into overlapping pieces if it is long, so that every span of it is whole in one."""
    word = _OTHER.sub("", word) if not word.isalnum() else word
    return [word[i : i + PIECE] for i in range(0, max(1, len(word) - OVERLAP), PIECE - OVERLAP)]


class Subsequences:
    """Occurrences of the threes and fours of many pieces: places of each kind of gaps, their features, and norms."""

    def __init__(self, parts: list[str]):
        joined = "\0" + "\0\0".join(parts) + "\0" if parts else ""  # each piece stands between two ends of word
        code = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF).astype(np.int64)
        self.code = np.where(code == 0, 0, _CLASS[code])
        size = np.array([len(p) + 2 for p in parts], np.int64)
        self.start = np.cumsum(size) - size
        self.end = np.repeat(self.start + size, size)
        self.n = len(parts)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        at, c = np.arange(len(self.code)), self.code
        for rest in OFFSETS:
            here = at[at + rest[-1] < self.end]
            feature = c[here]
            for step in rest:
                feature = feature * CLASSES + c[here + step]
            yield here, feature + (CLASSES**3 if len(rest) == 3 else 0), DECAY ** (rest[-1] - len(rest))

    def norms(self) -> np.ndarray:
        total = np.zeros(len(self.code))
        for here, _, w in self:
            total[here] += w * w
        return np.sqrt(np.maximum(np.add.reduceat(total, self.start), 1e-12)) if self.n else np.zeros(0)

    def dot(self, weights: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        """Normalised feature map times weights (one column, or several), by piece. With `place`, the row of weights of each feature, 0 for none."""
        total = np.zeros((len(self.code), *weights.shape[1:]), np.float64)
        for here, feature, w in self:
            if place is not None:
                feature = place[feature]
                here, feature = here[feature > 0], feature[feature > 0]
            total[here] += w * weights[feature]
        return (np.add.reduceat(total, self.start, axis=0).T / self.norms()).T if self.n else total

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The normalised feature map, a column per piece, as (features that occur, place of each feature or 0, rows by place, the first of zeros); for landmarks only."""
        norms, of = self.norms(), np.repeat(np.arange(self.n), np.diff(np.r_[self.start, len(self.code)]))
        found = np.unique(np.concatenate([feature for _, feature, _ in self]))
        place = np.zeros(FEATURES, np.int32)
        place[found] = np.arange(1, len(found) + 1)
        out = np.zeros((len(found) + 1, self.n), np.float32)
        for here, feature, w in self:
            np.add.at(out, (place[feature], of[here]), w / norms[of[here]])
        return found, place, out


class Model:
    """weights per subsequence, bias, and the slopes that make a probability of the scores of a document's words."""

    def __init__(self, weights: np.ndarray, bias: float, slopes: np.ndarray):
        self.weights, self.bias, self.slopes, self.id = weights, bias, slopes, uuid.uuid4().hex

    def score_words(self, words: list[str], at_once: int = 20_000) -> list[float]:
        out: list[float] = []
        for at in range(0, len(words), at_once):
            cut = [pieces(w) for w in words[at : at + at_once]]
            flat = Subsequences([p for ps in cut for p in ps]).dot(self.weights) + self.bias
            out += np.maximum.reduceat(flat, np.cumsum([0] + [len(ps) for ps in cut[:-1]])).tolist()
        return out

    def probability(self, scores: list[float]) -> float:
        """That a document with words of these scores is toxic."""
        return float(1 / (1 + np.exp(-np.clip(evidence(scores) @ self.slopes, -40, 40))))


def to_landmarks(words: list[str], columns: np.ndarray, place: np.ndarray, at_once: int = 500) -> np.ndarray:
    """Kernel values of words to the landmarks whose features are the columns."""
    return np.concatenate([Subsequences(words[i : i + at_once]).dot(columns, place) for i in range(0, len(words), at_once)])


def fit_machine(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Squared-hinge support vector machine (last weight: bias) over rows that weigh `share`, by Newton steps on the active rows."""
    x = np.c_[x, np.ones(len(x))]
    v, damp = np.zeros(x.shape[1]), np.diag(ridge * np.r_[np.ones(x.shape[1] - 1), 1e-3])
    for step in range(30):
        on = y * (x @ v) < 1
        left, right = damp.copy(), np.zeros(len(v))
        for i in range(0, len(x), 1000):  # no copy of all rows
            some = on[i : i + 1000]
            rows = x[i : i + 1000][some]
            weighed = rows * share[i : i + 1000][some, None]
            left += weighed.T @ rows
            right += weighed.T @ y[i : i + 1000][some]
        new = np.linalg.solve(left, right)
        if np.abs(new - v).max() < 1e-6:
            break
        v = new if step < 10 else 0.5 * (v + new)
    return v


def disguised(word: str, rng: np.random.Generator) -> str:
    """The word with a random letter or digit put inside it."""
    at = int(rng.integers(1, max(2, len(word))))
    return word[:at] + "abcdefghijklmnopqrstuvwxyz01"[rng.integers(28)] + word[at:]


def train(texts: list[str | None], toxic: list[int]) -> Model:
    """A model from labelled documents. With one class only, every score is the share of toxic rows, smoothed."""
    toxic = np.array(toxic, bool)
    if not toxic.any() or toxic.all():
        share = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.0
        return Model(np.zeros(FEATURES, np.float32), 0.0, np.r_[np.zeros(WORST + 3), np.log(share / (1 - share)) if share else -40.0])
    bags = [sorted({p for s in sentences(t) for w in words_of(s) for p in pieces(w)} | {""}) for t in texts]
    names = sorted({w for bag in bags for w in bag})
    number = {w: i for i, w in enumerate(names)}
    bags = [np.array([number[w] for w in bag]) for bag in bags]
    size = np.array([len(b) for b in bags])
    first, flat = np.cumsum(size) - size, np.concatenate(bags)
    clean_words = np.unique(np.concatenate([b for b, t in zip(bags, toxic, strict=True) if not t]))

    # First guess: words whose ungapped triples and which themselves come in more toxic than clean documents than chance has it.
    of, feature = [], []
    for i in range(0, len(names), AT_ONCE_WORDS):
        table = Subsequences(names[i : i + AT_ONCE_WORDS])
        here, found, _ = next(iter(table))
        of.append((np.repeat(np.arange(table.n), np.diff(np.r_[table.start, len(table.code)]))[here] + i).astype(np.int32))
        feature.append(found.astype(np.int32))
    of, feature = np.concatenate(of), np.concatenate(feature)
    del table, here, found
    seen = np.zeros((2, CLASSES**3))
    for bag, t in zip(bags, toxic, strict=True):
        lo, hi = np.searchsorted(of, bag), np.searchsorted(of, bag, "right")
        seen[int(t), np.unique(np.concatenate([feature[a:b] for a, b in zip(lo, hi, strict=True)] or [np.zeros(0, np.int64)]))] += 1
    # Lower bounds of the logarithms of odds, so that what was seen once says little.
    n1, n0 = toxic.sum() + 1, (~toxic).sum() + 1
    odds = np.log((seen[1] + 0.5) / n1) - np.log((seen[0] + 0.5) / n0) - np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    score = np.full(len(names), -9.0)
    np.maximum.at(score, of, odds[feature])

    # Words that come in many toxic documents and next to no clean ones are guilty whatever stands beside them. Near copies
    # count once: documents with the same three smallest hashes of words.
    del feature, of
    hashes = np.fromiter((zlib.crc32(f"{turn}{w}".encode()) for w in names for turn in "abc"), np.int64, 3 * len(names)).reshape(-1, 3)
    key = [(bool(t), *hashes[b].min(axis=0).tolist()) for b, t in zip(bags, toxic, strict=True)]
    single = np.array(sorted({k: d for d, k in enumerate(key)}.values()))
    counts = [np.bincount(np.concatenate([bags[d] for d in single if toxic[d] == c] or [np.zeros(0, np.int64)]), minlength=len(names)) for c in (False, True)]
    lift = np.log((counts[1] + 0.5) / (toxic[single].sum() + 1)) - np.log((counts[0] + 0.5) / ((~toxic[single]).sum() + 1))
    strong = np.flatnonzero((lift > STRONG_LIFT) & (counts[1] >= 4))
    strong = strong[np.argsort(-counts[1][strong], kind="stable")]
    # A word that clean documents use about as often never speaks for a toxic one.
    innocent = (counts[0] > 0) & (lift < 1.5)
    common = np.argsort(-counts[0], kind="stable")[:2000]

    rng = np.random.default_rng(7)
    for _ in range(ROUNDS):
        suspect = np.where(innocent, -np.inf, score)
        witness = Counter(int(bag[np.argmax(suspect[bag])]) for bag, t in zip(bags, toxic, strict=True) if t)
        guilty = np.union1d(sorted(witness), strong).astype(np.int64)
        hard = clean_words[np.argsort(-score[clean_words], kind="stable")[:4000]]
        rest = np.unique(np.r_[hard, common[counts[0][common] > 0], rng.choice(clean_words, min(6000, len(clean_words)), replace=False)])
        often = np.array([w for w, _ in witness.most_common(LANDMARKS // 3)])
        marks = np.unique(np.r_[often, strong[: LANDMARKS // 3], hard[: LANDMARKS // 6], rng.choice(rest, min(len(rest), LANDMARKS // 6), replace=False)]).astype(np.int64)
        found, place, columns = Subsequences([names[m] for m in marks]).features()
        own, vectors = np.linalg.eigh(to_landmarks([names[m] for m in marks], columns, place))
        root = vectors[:, own > 1e-6] / np.sqrt(own[own > 1e-6])
        # Words weigh by the documents that they speak for; each also counts with a character put in between, so that
        # the machine learns to look past it.
        weight, blame = 1.0 + counts[1][guilty], 1.0 + counts[0][rest]
        bent = [disguised(names[w], rng) for w in [*guilty, *np.repeat(strong[:100], 8)]]
        share = np.r_[weight / weight.sum() / 3, np.full(len(bent), 1 / len(bent) / 6), np.minimum(blame, 20) / np.minimum(blame, 20).sum() / 2]
        v = fit_machine(to_landmarks([names[w] for w in guilty] + bent + [names[w] for w in rest], columns, place) @ root, np.r_[np.ones(len(guilty) + len(bent)), -np.ones(len(rest))], share)
        mix, bias = root @ v[:-1], v[-1]
        weights = np.zeros(FEATURES, np.float32)
        weights[found] = np.concatenate([columns[i : i + 4_000] @ mix for i in range(0, len(columns), 4_000)])[1:]  # a product of mixed types copies its matrix
        del columns, place
        score = np.concatenate([Subsequences(names[i : i + AT_ONCE_WORDS]).dot(weights) for i in range(0, len(names), AT_ONCE_WORDS)]) + bias
    # Platt's fit of a probability, with his smoothed targets, to the evidence of the documents. Toxic documents
    # weigh more where they are few, up to five times.
    model = Model(weights, float(bias), np.zeros(WORST + 4))
    del bags, names, number, hashes, flat
    z, known = [], {}
    for i in range(0, len(texts), 100):
        split = [words_of(t) or [""] for t in texts[i : i + 100]]
        fresh = sorted({w for words in split for w in words} - known.keys())
        known.update(zip(fresh, model.score_words(fresh), strict=True))
        z += [evidence([known[w] for w in words]) for words in split]
    z = np.array(z)
    aim = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    share = np.where(toxic, np.clip((~toxic).sum() / toxic.sum(), 1, 5), 1.0)
    slopes = model.slopes
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ slopes, -40, 40)))
        slopes += np.clip(np.linalg.solve((z * (share * p * (1 - p) + 1e-6)[:, None]).T @ z + 0.1 * np.eye(len(slopes)), z.T @ (share * (aim - p)) - 0.1 * slopes), -2, 2)
    return model


def evidence(scores: list[float]) -> np.ndarray:
    """What a document's words say: the highest scores of distinct words, within the margins' reach; how many words, repeats included, are bad, and what share of all (logarithms, as is the number of words); and a constant."""
    scores = np.asarray(scores, float)
    top = np.array(heapq.nlargest(WORST, set(scores[scores > -2].tolist())))
    bad = (1 / (1 + np.exp(-SHARP * (np.clip(scores, -9, 9) - BAD)))).sum()
    size = np.log(len(scores) + 20)
    return np.r_[np.clip(top, -2, 4), np.full(WORST - len(top), -2.0), np.log1p(bad), np.log(bad + 0.3) - size, size, 1.0]


def held_out(doc_id) -> object:
    """True for rows whose labels are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train_on(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from a bounded sample (see the constants above) of the labelled documents that are not held out."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    marked = marked.where(~held_out(F.col("id"))).join(docs.select(F.col(doc_id).alias("id")), "id", "left_semi")
    order = [F.xxhash64("id"), "id"]
    ids = marked.where("y = 1").orderBy(*order).limit(TOXIC_DOCS).unionByName(marked.where("y = 0").orderBy(*order).limit(CLEAN_DOCS))
    ids = F.broadcast(written(ids, "toxicity-ids"))  # at most TOXIC_DOCS + CLEAN_DOCS rows
    # Each text of an id once. Only lengths are collected before the ids are chosen, and then only texts within the budget.
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(ids, "id").select("id", "y", "text").distinct()
    rows = written(rows.withColumn("n", F.length(F.coalesce("text", F.lit("")))), "toxicity-sample")
    total, take = 0, []
    for r in sorted(rows.groupBy("id").agg(F.sum("n").alias("n")).collect(), key=lambda r: hash_order(r["id"])):
        if total + r["n"] <= TRAINING_CHARS:
            total += r["n"]
            take.append(r["id"])
    found = [(r["id"], r["text"], r["y"]) for r in rows.where(F.col("id").isin(take)).select("id", "text", "y").collect()] if take else []
    found.sort(key=lambda r: (hash_order(r[0]), r[1] or ""))
    return train([t for _, t, _ in found], [y for _, _, y in found])


def hash_order(key: object) -> tuple:
    return zlib.crc32(f"order:{key}".encode()), str(key)


def with_score(docs: DataFrame, model: Model, name: str = "score", *, text: str = "text") -> DataFrame:
    """docs with the double column `name`: the model's probability that the whole text is toxic.

    Null and empty texts count as one empty word and have a score; very long texts are taken whole; repeated rows stay and
    score alike; an empty table gives an empty one. A column that is called `name` already is replaced, wherever it stood, as withColumn
    does; all others go through as they are.
    """
    docs = docs.drop(name)
    model_of = docs.sparkSession.sparkContext.broadcast(model)  # one weight per subsequence, whatever the input
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of.value
        memo = held(("toxicity", own.id), lambda: Memo(own.score_words, WORDS_KEPT))
        for b in sliced(batches, key=("toxicity", own.id)):
            texts, made, at = b.column(b.schema.get_field_index(text)).to_pylist(), [], 0
            while at < len(texts):
                split, size = [], 0
                while at < len(texts) and size < AT_ONCE:
                    split.append(words_of(texts[at]) or [""])
                    size += len(texts[at] or "")
                    at += 1
                known = memo.learn([w for words in split for w in words])
                made += [own.probability(list(map(known.__getitem__, words))) for words in split]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with the same columns."""
    score = free_name(docs, "score")
    return with_score(docs, model, score, text=text).where(F.col(score) < threshold).drop(score)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
