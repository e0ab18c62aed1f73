"""Toxicity by a linear-chain conditional random field over the words of a line.

Only documents are labelled, so the tokens to train on get their labels first: a word is toxic in a toxic document if the
word, or one of its prefixes, occurs in a far larger share of the toxic than of the other documents of the sample. A
two-state chain with word, prefix and suffix features is trained on those by maximum likelihood. Forward-backward
marginals of a document's words are aggregated (the largest, how many are likelier toxic than not, and their share) into a score by a logistic
function fitted on the part of the sample that the chain has not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the sample to learn from: documents of each label, by the order of a hash of their ids, and words of them that
#: the chain is trained on; and characters of one document.
SAMPLE_DOCS, SAMPLE_WORDS, DOC_CHARS = 2_500, 250_000, 10_000
#: A word or prefix counts as toxic from this log ratio of its shares on, if the log likelihood ratio of its counts is so
#: large that no accident among some 100,000 words explains it.
LOG_RATIO, EVIDENCE = 2.0, 11.0
#: Words in a chain; a longer line is several chains.
CHAIN = 64
THRESHOLD = 0.7
KEPT = 150_000
_RUN = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """Features of a word in lower case."""
    return [f"={word}", *(f"<{word[:k]}" for k in range(3, 9) if len(word) > k), *(f">{word[-k:]}" for k in range(3, 6) if len(word) > k)]


def _keys(word: str) -> list[str]:
    return [f"={word}", *(f"<{word[:k]}" for k in range(4, 9) if len(word) > k)]


# ---- the chain ------------------------------------------------------------------------------------------------------


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: float, counts: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of state 1, and expected moves (2 x 2) if asked for, of chains: scores (chains x words) of state 1 over state 0.

    moves: logarithmic weights of going from one state to another; start: that of beginning in state 1. With two states one
    number a word is enough in either direction: `ahead` the odds of state 1 from the words up to it, `behind` from those after.
    """
    (m00, m01), (m10, m11) = np.exp(moves)
    lift = np.exp(np.clip(scores.T, -30, 30))
    ahead, behind = np.empty_like(lift), np.ones_like(lift)
    inside = np.arange(len(lift))[:, None] < lengths[None, :]
    ahead[0] = math.exp(start) * lift[0]
    for t in range(1, len(lift)):
        ahead[t] = lift[t] * (m01 + ahead[t - 1] * m11) / (m00 + ahead[t - 1] * m10)
    for t in range(len(lift) - 2, -1, -1):
        onward = lift[t + 1] * behind[t + 1]
        behind[t] = np.where(inside[t + 1], (m10 + m11 * onward) / (m00 + m01 * onward), 1.0)
    both = ahead * behind
    marginals = np.where(inside, both / (1 + both), 0.0).T
    if not counts:
        return marginals, None
    onward, here, on = (lift * behind)[1:], ahead[:-1], inside[1:]
    joint = [m00 * np.ones_like(here), m01 * onward, m10 * here, m11 * here * onward]
    total = sum(joint)
    return marginals, np.array([(x / total)[on].sum() for x in joint]).reshape(2, 2)


def _chains(ids: np.ndarray, line_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of the chains of lines that hold line_sizes words each."""
    ends = np.cumsum(line_sizes)
    firsts, sizes = [], []
    pieces = -(-line_sizes // CHAIN)
    owner = np.repeat(np.arange(len(line_sizes)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    firsts = (ends - line_sizes)[owner] + within * CHAIN
    sizes = np.minimum(CHAIN, line_sizes[owner] - within * CHAIN)
    return firsts, sizes


def marginals(scores: np.ndarray, line_sizes: np.ndarray, moves: np.ndarray, start: float) -> np.ndarray:
    """Marginals of state 1 of all words, from the scores of the words of lines one after another."""
    out = np.zeros(len(scores))
    firsts, sizes = _chains(scores, line_sizes)
    width = 1
    while width < 2 * CHAIN:
        some = np.flatnonzero((sizes <= width) & (sizes > width // 2))
        for part in np.array_split(some, max(1, len(some) * width >> 19)):
            if len(part):
                at = np.minimum(firsts[part][:, None] + np.arange(width), len(scores) - 1)
                inside = np.arange(width) < sizes[part][:, None]
                p, _ = forward_backward(np.where(inside, scores[at], 0.0), sizes[part], moves, start, counts=False)
                out[at[inside]] = p[inside]
        width *= 2
    return out


class _Emissions(dict):
    """Scores of the words in each blank-separated token, kept up to a bound."""

    def __init__(self, weights: dict[str, float]):
        kinds = {sign: {f[1:]: w for f, w in weights.items() if f[:1] == sign} for sign in "=<>"}
        self.whole, self.heads, self.tails, self.always = kinds["="], kinds["<"], kinds[">"], weights.get("", 0.0)

    def _word(self, word: str) -> float:
        """The sum of the weights of a word's features (see `features`)."""
        n, heads, tails = len(word), self.heads, self.tails
        total = self.always + self.whole.get(word, 0.0)
        for k in range(3, min(9, n)):
            total += heads.get(word[:k], 0.0)
        for k in range(3, min(6, n)):
            total += tails.get(word[-k:], 0.0)
        return total

    def __missing__(self, token: str) -> tuple[float, ...]:
        if len(self) >= KEPT:
            self.clear()
        found = (token,) if token.isalpha() else _RUN.findall(token)
        self[token] = value = tuple([self._word(w.lower()) for w in found])
        return value


class Model:
    """A trained chain and its aggregation; picklable."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, start: float, fit: np.ndarray):
        self.weights, self.moves, self.start, self.fit = weights, moves, start, fit
        self.known = _Emissions(weights)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.known = _Emissions(self.weights)

    def word_marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words (runs of letters, as in training) of some texts, and the number of words of each text."""
        score, scores, lines, sizes = self.known.__getitem__, [], [], []
        for text in texts:
            n = 0
            for line in text.split("\n"):
                found = list(chain.from_iterable(map(score, line.split())))
                if found:
                    lines.append(len(found))
                    n += len(found)
                    scores += found
            sizes.append(n)
        if not scores:
            return np.zeros(0), np.array(sizes, np.int64)
        return marginals(np.array(scores), np.array(lines), self.moves, self.start), np.array(sizes, np.int64)

    def measures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a score is made of, for each text; and the marginals and sizes behind it."""
        p, sizes = self.word_marginals(texts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        total = np.bincount(owner, p, len(texts))
        most = np.full(len(texts), 1e-7)
        np.maximum.at(most, owner, np.clip(p, 1e-7, 1 - 1e-7))
        hits = np.bincount(owner, p > 0.5, len(texts))
        return np.stack([np.ones(len(texts)), np.log(most / (1 - most)) / 4, np.log1p(hits), np.minimum(1, 20 * total / (sizes + 20))], axis=1), p, sizes

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, p, sizes = self.measures(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.fit, -30, 30))), p, sizes


# ---- training -------------------------------------------------------------------------------------------------------


def _words(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return [w.lower() for w in _RUN.findall(text)]


def _split_words(text: str) -> list[list[str]]:
    return [words for line in text.split("\n") if (words := _words(line))]


def toxic_words(texts: list[str], labels: list[int]) -> set[str]:
    """Features (words and prefixes) that occur in a far larger share of toxic than of other texts."""
    seen, n = (Counter(), Counter()), [labels.count(0), labels.count(1)]
    for text, label in zip(texts, labels, strict=True):
        seen[label].update({k for w in set(_words(text)) for k in _keys(w)})
    out = {}
    for k, c in seen[1].items():
        other, both = seen[0][k], c + seen[0][k]
        ratio = math.log((c + 0.5) / (n[1] + 1) / ((other + 0.5) / (n[0] + 1)))
        if ratio >= LOG_RATIO:
            share = both / (n[0] + n[1])
            out[k] = c * math.log(c / (n[1] * share)) + (other * math.log(other / (n[0] * share)) if other else 0.0)
    return {k for k, evidence in out.items() if evidence >= EVIDENCE} or set(sorted(out, key=lambda k: (-out[k], k))[:5])


def train_chain(texts: list[str], labels: list[int], rounds: int = 50, decay: float = 2e-3) -> tuple[dict[str, float], np.ndarray, float]:
    """(weights by feature, moves, start) of the chain that is likeliest for the token labels of some texts."""
    marked = toxic_words(texts, labels)
    types: dict[str, int] = {}
    ids, sizes, truth, budget = [], [], [], {0: SAMPLE_WORDS // 2, 1: SAMPLE_WORDS // 2}
    for text, label in zip(texts, labels, strict=True):
        for words in _split_words(text):
            if budget[label] <= 0:
                break
            budget[label] -= len(words)
            for at in range(0, len(words), CHAIN):
                part = words[at : at + CHAIN]
                sizes.append(len(part))
                ids += [types.setdefault(w, len(types)) for w in part]
                truth += [int(label and any(k in marked for k in _keys(w))) for w in part]
    names: dict[str, int] = {"": 0}
    support = Counter(f for w in types for f in features(w))
    pairs = [(i, names.setdefault(f, len(names))) for w, i in types.items() for f in ["", *features(w)] if not f or support[f] > 1 or f[0] == "="]
    of_type, of_name = np.array(pairs).T
    ids, sizes, truth = np.array(ids), np.array(sizes), np.array(truth)
    firsts = np.cumsum(sizes) - sizes
    at = np.minimum(firsts[:, None] + np.arange(CHAIN), len(ids) - 1)
    inside = np.arange(CHAIN) < sizes[:, None]
    y = np.where(inside, truth[at], 0)
    goal_moves = np.zeros((2, 2))
    np.add.at(goal_moves, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)
    goal_types = np.bincount(ids, truth, len(types))
    theta = np.zeros(len(names) + 5)
    theta[0] = -3.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        emit = np.bincount(of_type, theta[of_name], len(types))
        moves, start = theta[-5:-1].reshape(2, 2), theta[-1]
        p, expected = forward_backward(np.where(inside, emit[ids[at]], 0.0), sizes, moves, start)
        slack = goal_types - np.bincount(ids[at][inside], p[inside], len(types))
        gradient = np.concatenate([np.bincount(of_name, slack[of_type], len(names)), (goal_moves - expected).ravel(), [(y[:, 0] - p[:, 0]).sum()]])
        gradient = gradient - decay * len(sizes) ** 0.5 * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2  # Adam's steps
        theta = theta + 0.25 * (1 - k / (rounds + 10)) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-6)
    weights = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 0.01}
    return weights, theta[-5:-1].reshape(2, 2).copy(), float(theta[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients of a logistic regression (first column: ones), by Newton's method; only the others are held small."""
    w, hold = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    hold[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
    return w


def train(texts: list[str], labels: list[int]) -> Model | None:
    """A model from labelled texts, in an order that has nothing to do with them; None unless both labels occur."""
    if not labels or len(set(labels)) < 2:
        return None
    held = {i for label in (0, 1) for i in [k for k, x in enumerate(labels) if x == label][2::3]}  # a third, to fit the aggregation
    a = [i for i in range(len(texts)) if i not in held]
    model = Model(*train_chain([texts[i] for i in a], [labels[i] for i in a]), np.zeros(4))
    b = sorted(held) or a
    x, y = np.concatenate([model.measures([texts[i]])[0] for i in b]), np.array([labels[i] for i in b], float)
    model.fit = _logistic(x, y) if len(set(y)) == 2 else np.array([-1.0, 2.0, 1.0, 1.0])
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Model | None:
    """A model from at most `sample` documents of each label, DOC_CHARS characters of each. docs (doc_id, text), labels
    (doc_id, toxic 0 or 1); of several labels for a document the largest counts, and of several texts the least; null
    labels and texts are left out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda v: known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = pick(0).union(pick(1)).select(F.col("doc_id").alias("chosen_id"), "toxic")
    texts = docs.where("text is not null").select("doc_id", F.substring("text", 1, DOC_CHARS).alias("text"))
    some = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))
    rows = some.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "toxic", "text", F.xxhash64("doc_id").alias("h")).collect()
    rows = sorted((r["h"], r["doc_id"], r["toxic"], r["text"]) for r in rows)
    return train([r[3] for r in rows], [r[2] for r in rows])


# ---- scoring --------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted, spans array<struct<start, stop, word>>) of each row of docs (doc_id, text), by text alone.

    Spans are the character offsets of words that are likelier toxic than not. Null and empty texts have the score of a
    text without words. Without a model (no labels to learn from) every score is 0. Repeated rows each get a row, other
    columns are not read, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("word", pa.string())]))

    def run(batches):
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                if model is None:
                    values, spans = np.zeros(len(texts)), [[]] * len(texts)
                else:
                    values, p, sizes = model.scores(texts)
                    spans, first = [], 0
                    for text, n in zip(texts, sizes.tolist(), strict=True):
                        hot = set(np.flatnonzero(p[first : first + n] > 0.5).tolist())
                        spans.append([{"start": m.start(), "stop": m.end(), "word": m.group()} for i, m in enumerate(_RUN.finditer(text)) if i in hot] if hot else [])
                        first += n
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array((values >= THRESHOLD).astype(np.int32)), pa.array(spans, span)], ["doc_id", "score", "predicted", "spans"])
        if model is not None:
            model.known.clear()  # the process goes on to other tasks, of other stages too

    schema = "doc_id long, score double, predicted int, spans array<struct<start: long, stop: long, word: string>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def clean(batches):
        model = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                if model is not None:
                    batch = batch.filter(pa.array(model.scores([x or "" for x in batch.column(at).to_pylist()])[0] < threshold))
                yield batch
        if model is not None:
            model.known.clear()

    return docs.mapInArrow(clean, docs.schema)


def fold_of(column: str = "doc_id", folds: int = 3):
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def held_out_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans): learned from the labels of rows whose crc32(doc_id) mod `folds` is not `held`.
    A row without an id is in no fold: it is scored, but neither learned from nor held out."""
    model = learn(docs, labels.where(fold_of("doc_id", folds) != held))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", "predicted", "spans")
