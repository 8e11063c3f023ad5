"""Toxicity by a gapped-subsequence string kernel and a support vector machine on Nystroem landmarks.

The kernel of two words sums, over triples of letters that both hold in order, decay ** (spans), spans
of at most SPAN letters; gaps let it pass over inserted characters. Its feature space (triples of a
small alphabet) is finite, so a machine trained on Nystroem features is written out as one weight per
triple: a word's score is then the same sum over its own triples, without going through the landmarks.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters written for others, fixed values: digits and signs that stand for letters.
ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
ALPHABET, SPAN, DECAY, WIDEST = 32, 5, 0.7, 40
#: Offsets of the second and third letter of a triple.
OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
#: Signs that are stripped from a word's ends.
EDGES = "#*$%&|<>.,;:!?\"'()[]{}-_~`"
#: Characters written around each word.
BEGIN, END = 1, 2
#: Distinct words whose scores a worker remembers.
MEMO = 800_000


def _codes() -> dict[int, int]:
    """Code of each character: a letter 1 to 26, what looks like one its code, other letters 27 to 29, a word's begin and end 30 and 31, all else 0."""
    table = {}
    for c in range(0x250):
        ch = chr(c).lower()[:1]
        ch = ALIKE.get(ch, ch)
        table[c] = ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) % 3 if ch.isalpha() else 0
    return table | {BEGIN: 30, END: 31}


CODES = _codes()


_APART = "\0" * SPAN


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words one after another, SPAN zeros after each, and where each begins."""
    joined = "".join(f"\x01{w}\x02{_APART}" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    table = np.zeros(0x250 + 1, np.int64)
    table[list(CODES)] = list(CODES.values())
    codes = table[np.minimum(points, 0x250)]
    wide = (points >= 0x250) & (points < 0xFFFE)
    codes[wide] = 27 + points[wide] % 3
    lengths = np.array([len(w) for w in words], np.int64) + SPAN + 2
    return codes, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def triples(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of offsets: (place, triple, weight) of the triples of letters in the words."""
    codes, _ = coded(words)
    padded = np.concatenate([codes, np.zeros(SPAN, np.int64)])
    n = len(codes)
    for i, j in OFFSETS:
        second, third = padded[i : n + i], padded[j : n + j]
        # the zeros after a word are as many as a span, so no triple reaches into the next word
        at = np.flatnonzero((codes > 0) & (second > 0) & (third > 0))
        yield at, (codes[at] * ALPHABET + second[at]) * ALPHABET + third[at], DECAY ** (j + 1)


def norms(words: list[str]) -> np.ndarray:
    """Root of the squared weights of each word's triples, at least that of a three-letter word."""
    codes, starts = coded(words)
    total = np.zeros(len(codes))
    for at, _, weight in triples(words):
        total[at] += weight * weight
    return np.sqrt(np.maximum(np.add.reduceat(total, starts), DECAY**6)) if len(words) else np.zeros(0)


def features(words: list[str]) -> np.ndarray:
    """The words in the kernel's own space, one row each; for landmarks and training words only."""
    _, starts = coded(words)
    out = np.zeros((len(words), ALPHABET**3), np.float32)
    for at, triple, weight in triples(words):
        np.add.at(out, (np.searchsorted(starts, at, "right") - 1, triple), weight)
    return out / norms(words)[:, None].astype(np.float32)


def word_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The machine's value of each word, without its bias."""
    if not words:
        return np.zeros(0)
    codes, starts = coded(words)
    total = np.zeros(len(codes))
    for at, triple, weight in triples(words):
        total[at] += weight * weights[triple]
    return np.add.reduceat(total, starts) / norms(words)


def units(text: str | None) -> list[str]:
    """Words of a text as the kernel sees them.

    Lower case, split at white space, signs at either end stripped; a run of three or more single characters is one word too,
    as spaced-out letters hide one; very long words are cut into overlapping stretches of WIDEST.
    """
    words = [w.strip(EDGES) for w in (text or "").lower().split()]
    if any(len(w) > WIDEST for w in words):
        words = [w[k : k + WIDEST] for w in words for k in range(0, max(1, len(w) - WIDEST // 2), WIDEST // 2)]
    run: list[str] = []
    joined = []
    for w in words if sum(len(w) == 1 for w in words) >= 3 else ():
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) >= 3:
                joined.append("".join(run))
            run = []
    if len(run) >= 3:
        joined.append("".join(run))
    return words + [j[k : k + WIDEST] for j in joined for k in range(0, max(1, len(j) - WIDEST // 2), WIDEST // 2)]


@dataclass
class Model:
    """Weights of triples, the machine's bias, and the calibration of a document's best words."""

    weights: np.ndarray
    bias: float
    scale: np.ndarray
    intercept: float


class Scorer:
    """Scores whole texts, remembering the scores of words."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return calibrated(self.best(texts), self.model)

    def best(self, texts: list[str | None]) -> np.ndarray:
        memo, split = self.memo, [units(t) for t in texts]
        missing = list({w for words in split for w in words if w not in memo})
        for at in range(0, len(missing), 20000):
            part = missing[at : at + 20000]
            memo.update(zip(part, (word_scores(part, self.model.weights) + self.model.bias).tolist(), strict=True))
        out = np.array([summary([memo[w] for w in words]) for words in split]).reshape(len(split), 4)
        if len(memo) > MEMO:
            for w in list(memo)[MEMO // 2 :]:
                del memo[w]
        return out


def summary(values: list[float]) -> tuple[float, float, float, float]:
    """Of a document: its three best words' values, from -3 to 3, and the log of its length."""
    top = sorted(values, reverse=True)[:3] + [-3.0] * 3
    return (*(min(3.0, max(-3.0, v)) for v in top[:3]), float(np.log1p(len(values))))


def calibrated(best: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(best @ model.scale + model.intercept, -30, 30)))


def support_vectors(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * len(x))
    ridge[-1] = 1e-6 * len(x)
    for _ in range(steps):
        margin = 1 - y * (x @ w)
        on = margin > 0
        grad = ridge * w - x[on].T @ (cost[on] * y[on] * margin[on])
        step = np.linalg.solve((x[on] * cost[on, None]).T @ x[on] + np.diag(ridge), grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps; the last column of x is the intercept."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def kernel(words: list[str], phi: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark, phi being the landmarks in the kernel's own space."""
    used = np.flatnonzero(phi.any(0))
    place = np.full(phi.shape[1], len(used), np.int64)  # triples of no landmark share one row of zeros
    place[used] = np.arange(len(used))
    by_triple, parts = np.concatenate([phi.T[used], np.zeros((1, len(phi)), np.float32)]), []
    for k in range(0, len(words), 500):
        part = words[k : k + 500]
        codes, starts = coded(part)
        total = np.zeros((len(codes), len(phi)), np.float32)
        for at, triple, weight in triples(part):
            total[at] += np.float32(weight) * by_triple[place[triple]]
        parts.append(np.add.reduceat(total, starts, axis=0).astype(np.float64) / norms(part)[:, None])
    return np.concatenate(parts) if parts else np.zeros((0, len(phi)))


def disguises(word: str) -> list[str]:
    """Ways to hide a word by inserted characters, for the machine to learn."""
    half = len(word) // 2
    return [".".join(word), f"{word[:half]}*{word[half:]}", f"{word[: half - 1]}x{word[half - 1 :]}"]


def train(texts: list[str], toxic: np.ndarray, *, landmarks: int = 96, more: int = 64, rounds: int = 4, sample: int = 8000, seed: int = 11) -> Model:
    """Train on labelled texts.

    A toxic text says only that one of its words is: the witnesses start as its words with the highest
    log odds over the clean texts, and are chosen anew by each machine. Every word of a clean text is
    clean. Landmarks are the commonest witnesses and seeded words of clean texts; after each round the
    `more` words that the machine gets most wrong join them, and the hardest clean words the training.
    """
    rng = np.random.default_rng(seed)
    split, clean, bad = [], Counter(), Counter()
    for text, t in zip(texts, toxic, strict=True):
        words = sorted(set(units(text)))
        (bad if t else clean).update(words)
        if t and words:
            split.append(words)
    n_bad, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    if not bad or not clean:
        return Model(np.zeros(ALPHABET**3), -1.0, np.zeros(4), -4.0 if not bad else 0.0)
    odds = {w: np.log((c + 0.5) / (n_bad + 1)) - np.log((clean[w] + 0.5) / (n_clean + 1)) for w, c in bad.items()}
    value = {w: odds[w] * np.sqrt(bad[w]) for w in bad}  # a word of one text only says little
    positive = Counter(max(words, key=lambda w: (value[w], w)) for words in split)
    positive.update({w: bad[w] for w in bad if odds[w] > 2 and bad[w] >= 5 and clean[w] <= 0.05 * bad[w]})
    common = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))]
    negative = sorted({*common[: sample // 2], *(common[i] for i in rng.permutation(len(common))[: sample // 2])})
    ranked = [w for w, _ in sorted(positive.items(), key=lambda x: (-x[1], x[0]))]
    marks = sorted({*ranked[: landmarks // 2], *common[: landmarks // 4], *(negative[i] for i in rng.permutation(len(negative))[: landmarks // 4])})
    weights, bias, bad_words = np.zeros(ALPHABET**3), 0.0, sorted(bad)
    for last in range(rounds):
        phi = features(marks)
        values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
        solid = values > 1e-6 * values.max()
        nystroem = vectors[:, solid] / np.sqrt(values[solid])  # kernel with the landmarks -> features
        witnesses = sorted(positive)
        hidden = [(v, 0.5 * positive[w]) for w in witnesses if positive[w] >= 5 and len(w) >= 4 for v in disguises(w)]
        witnesses += [v for v, _ in hidden]
        x = np.concatenate([kernel(witnesses, phi), kernel(negative, phi)]) @ nystroem
        y = np.concatenate([np.ones(len(witnesses)), -np.ones(len(negative))])
        cost = np.concatenate([np.sqrt([*(positive[w] for w in witnesses[: len(witnesses) - len(hidden)]), *(c for _, c in hidden)]), np.sqrt([clean[w] for w in negative])])
        cost[: len(witnesses)] *= 0.3 * cost[len(witnesses) :].sum() / cost[: len(witnesses)].sum()
        w = support_vectors(np.hstack([x, np.ones((len(x), 1))]), y, cost / cost.mean(), penalty=1e-4)
        weights, bias = ((nystroem @ w[:-1]).astype(np.float32) @ phi).astype(np.float64), float(w[-1])
        if last + 1 == rounds:
            break
        valued = lambda words: [v for at in range(0, len(words), 20000) for v in (word_scores(words[at : at + 20000], weights) + bias).tolist()]  # noqa: E731,B023
        found = dict(zip(bad_words, valued(bad_words), strict=True))
        positive = Counter(max(words, key=lambda w: (found[w] + 0.1 * min(odds[w], 3), w)) for words in split)  # noqa: B023
        positive.update({w: bad[w] for w in bad if found[w] > 0.5 and odds[w] > 1.5})
        positive = Counter({w: c for w, c in positive.items() if odds[w] > 0.5})
        if not positive:
            break
        wrong = sorted(zip(valued(common), common, strict=True), key=lambda v: (-v[0] * np.sqrt(clean[v[1]]) if v[0] > -0.5 else 0, v[1]))
        negative = sorted({*negative, *(c for v, c in wrong[: sample // 4] if v > -0.8)})
        weak = sorted(positive, key=lambda w: (found[w] - 0.05 * np.sqrt(positive[w]), w))  # noqa: B023
        marks = sorted({*marks, *(c for _, c in wrong[: more // 2]), *weak[: more // 2]})
    model = Model(weights, bias, np.zeros(4), 0.0)
    scorer = Scorer(model)
    best = np.concatenate([scorer.best(texts[k : k + 100]) for k in range(0, len(texts), 100)])
    w = logistic(np.hstack([best, np.ones((len(best), 1))]), toxic.astype(float))
    return Model(weights, bias, w[:-1], float(w[-1]))


def held_out(doc_id: int | None) -> bool:
    """Whether a document's label is kept from training."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def fitting(sizes: list[int], most: int) -> list[bool]:
    """Whether each is taken, in order; one that would go beyond `most` is passed over, and the next ones are tried."""
    total, taken = 0, []
    for n in sizes:
        taken.append(total + n <= most)
        total += n * taken[-1]
    return taken


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 4000, max_chars: int = 14_000_000, seed: int = 11) -> Model:
    """Learn from at most `max_rows` labelled documents of each label, those with the least seeded hash of their id.

    Held-out documents, null labels and labels without a document teach nothing; of repeated labels the
    greatest holds. The sample's texts come to one task, at most `max_chars` characters of them: whole texts
    in the order of the hash, those left out that would go beyond.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where("pmod(crc32(cast(%s as string)), 3) <> 1" % id_col)
    marked = marked.groupBy(F.col(id_col).alias("i")).agg((F.max(label_col) == 1).alias("y"))
    order = [F.xxhash64(F.lit(seed), "i"), F.col("i")]
    sample = marked.where("y").orderBy(*order).limit(max_rows).unionByName(marked.where("not y").orderBy(*order).limit(max_rows))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("i"))
    sizes = rows.select("doc_id", "y", F.length("text").alias("n"), F.xxhash64(F.lit(seed), "doc_id").alias("h")).toPandas().sort_values(["y", "h", "doc_id"])  # two rows of numbers per sampled document
    fits = sizes.groupby("y")["n"].transform(lambda n: fitting(n.tolist(), max_chars // 2)).astype(bool)
    chosen = docs.sparkSession.createDataFrame([(int(i),) for i in sorted(set(sizes["doc_id"][fits]))], "k long")
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("k"), "left_semi").select("doc_id", "y", "text")

    def trained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if parts:
            sample = pd.concat(parts).sort_values(["doc_id", "text"])
            yield pd.DataFrame({"model": [pickle.dumps(train(sample["text"].tolist(), sample["y"].to_numpy(bool), seed=seed))]})

    models = found.repartition(1).mapInPandas(trained, "model binary").collect()  # one task has the bounded sample, and the driver the model alone
    return pickle.loads(models[0]["model"]) if models else train([], np.zeros(0, bool), seed=seed)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text, from 0 to 1; null texts count as empty, repeated rows score alike, a null id stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scorer.scores(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scored, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below `threshold`, with their columns as they are; texts are scored where they stand, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(kept, docs.schema)


def train_frame(frame: pd.DataFrame) -> Model:
    """Train on a pandas frame of (text, toxic); for tests."""
    return train(frame["text"].fillna("").tolist(), (frame["toxic"] == 1).to_numpy())
