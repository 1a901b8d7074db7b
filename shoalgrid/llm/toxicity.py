"""Toxicity by weak supervision.

Voters: a small fixed lexicon, surface patterns, and words and word beginnings,
once or repeated, that the labelled rows favour. A generative label model (naive
Bayes with Bernoulli votes, fitted by expectation maximisation over rows with and
without a label) estimates how often each voter speaks in either class; voters
that stay correlated within the classes share their weight. A linear classifier
is then trained on the model's posterior labels and scores every whole text.

Only doc_id (for the join and the split), text and the toxic label are read in
training, only the text in scoring. Where a row has a label, that is one voter
more, whose error rates are estimated like the others'; most voters are words of
invented languages that no other source knows. Models are fitted on at most
``SAMPLE`` labelled and ``UNLABELLED`` other rows and hold at most ``FEATURES``
weights; none of these grows with the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches, pieces, stored

#: Labelled rows for training, and rows that the label model sees without their labels, chosen by hash of doc_id.
SAMPLE, UNLABELLED = 20_000, 4_000
#: Words, word beginnings and patterns with a weight.
FEATURES = 512
#: Features among which the voters are chosen.
CANDIDATES = 4096
#: Rows that a feature needs among those labelled toxic.
SUPPORT = 5
#: Score from which a text counts as toxic.
THRESHOLD = 0.3

#: A general lexicon of hostile words.
LEXICON = "idiot moron stupid dumb loser trash scum filth worthless pathetic disgusting clown garbage vermin imbecile bastard bitch asshole fuck shit whore slut retard freak coward hate kill die".split()

_WORD = re.compile(r"\w+")
_PATTERNS = {
    "address": re.compile(r"\byou(?:'re| are| r)?\s+(?:all\s+)?(?:a|an|such|so|just|nothing)\b", re.I),
    "shout": re.compile(r"\b[A-Z]{4,}(?:\W+[A-Z]{4,}){2,}"),
    "bang": re.compile(r"!{3,}|[?!]{4,}"),
    "mask": re.compile(r"\b[A-Za-z]+[*@#$]{2,}[A-Za-z]*\b"),
}
_LEXICON = frozenset(LEXICON)


def features(text: str) -> set[str]:
    """Names of all features that a whole text has."""
    words = _WORD.findall(text.lower())
    kinds = set(words)
    found = {f"w {w}" for w in kinds}
    for size in (4, 5):
        for x, n in Counter([w[:size] for w in words if len(w) > size]).items():
            found.update(f"{size} {x}" + f" x{k}" * (k > 1) for k in range(1, min(n, 3) + 1))
    hits = len(kinds & _LEXICON)
    found.update(f"lexicon {k}" for k in range(1, min(hits, 3) + 1)) if hits else found.add("lexicon 0")
    found |= {f"pattern {k}" for k, p in _PATTERNS.items() if p.search(text)}
    return found


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    cache: dict[int, dict[str, list[float]]] = field(default_factory=dict)

    def score(self, text: str) -> float:
        w, total = self.weights, self.bias
        words = _WORD.findall(text.lower())
        kinds = set(words)
        total += sum(w.get(f"w {x}", 0.0) for x in kinds)
        for size in (4, 5):
            known = self._beginnings(size)
            for x, n in Counter([y for x in words if len(x) > size and (y := x[:size]) in known]).items():
                total += sum(known[x][:n])
        hits = len(kinds & _LEXICON)
        total += sum(w.get(f"lexicon {k}", 0.0) for k in range(1, min(hits, 3) + 1)) if hits else w.get("lexicon 0", 0.0)
        total += sum(w.get(f"pattern {k}", 0.0) for k, p in _PATTERNS.items() if f"pattern {k}" in w and p.search(text))
        return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))

    def _beginnings(self, size: int) -> dict[str, list[float]]:
        """Weights of each beginning of that many letters for its first, second and third occurrence."""
        if size not in self.cache:
            names = {f.split(" ")[1] for f in self.weights if f.startswith(f"{size} ")}
            self.cache[size] = {x: [self.weights.get(f"{size} {x}" + f" x{k}" * (k > 1), 0.0) for k in (1, 2, 3)] for x in names}
        return self.cache[size]


def split_column() -> F.Column:
    """True for rows that labels must not be learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows outside the held-out part.

    The labels are cut to the sample before the join, so its broadcast side has
    ``sample`` rows at most; the texts aren't shuffled. Null ids and labels
    other than 0 and 1 are left out; of repeated labels of an id the largest
    counts, of repeated rows of an id the smallest text.
    """
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.where(~split_column()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return rows.select("text", F.col("toxic").cast("int").alias("toxic"))


def other_rows(docs: DataFrame, count: int = UNLABELLED) -> DataFrame:
    """(text, toxic null) of ``count`` rows of ``docs``, chosen by hash of doc_id, their labels not looked at."""
    chosen = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64(F.lit("others"), "doc_id"), "doc_id").limit(count)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows.select("text", F.lit(None).cast("int").alias("toxic"))


def sketch(text: str) -> int:
    """Smallest hash of the five-word shingles (of all words, if fewer): near copies mostly share it."""
    words = text.lower().split()
    grams = map(" ".join, zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else [" ".join(words)]
    return min(zlib.crc32(g.encode()) for g in grams)


def distinct_rows(rows: DataFrame) -> DataFrame:
    """One row for each sketch and label, so that a copied text does not teach its own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keys = [sketch(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["text", "toxic", "sketch"])

    return map_batches(rows, run, "text string, toxic int, sketch long").groupBy("sketch", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _select(rows: DataFrame, limit: int) -> tuple[list[str], int, int]:
    """Features that favour either class, from counts over all training rows; and the rows of each class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())
        for batch in pieces(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by[toxic].update(features(text or ""))
                by[toxic][""] += 1
        names = list(by[0].keys() | by[1].keys())
        for at in range(0, len(names), 1 << 16):
            part = names[at : at + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"name": pa.array(part, pa.string()), "neg": pa.array([by[0][x] for x in part], pa.int64()), "pos": pa.array([by[1][x] for x in part], pa.int64())})

    counts = map_batches(rows, count, "name string, neg long, pos long").groupBy("name").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counts = stored(counts.where((F.col("pos") >= SUPPORT) | F.col("name").rlike("^(lexicon|pattern)|^$")), "toxicity-counts")
    total = [r for r in counts.where("name = ''").collect()]
    neg, pos = (total[0].neg, total[0].pos) if total else (0, 0)
    odds = F.log((F.col("pos") + 0.5) / (F.lit(pos) - F.col("pos") + 0.5)) - F.log((F.col("neg") + 0.5) / (F.lit(neg) - F.col("neg") + 0.5))
    ranked = counts.where("name <> ''").withColumn("odds", odds).where((F.col("odds") > 2) | F.col("name").rlike("^(lexicon|pattern)"))
    top = ranked.orderBy(F.col("name").rlike("^(lexicon|pattern)").desc(), (F.col("pos") * F.col("odds")).desc(), "name").limit(limit).select("name").collect()
    return [r.name for r in top], neg, pos


def label_model(votes: np.ndarray, gold: np.ndarray, polarity: np.ndarray | None = None, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """Posterior P(toxic) of each row from its votes, and what was estimated.

    ``votes``: rows x voters, 0/1. ``gold``: 1, 0, or -1 for none; it is one more
    voter whose error rates are estimated like the others'.
    ``polarity``: -1 for voters that speak against toxicity (the start of the fit
    for rows without gold).
    """
    leaning = votes @ (np.ones(votes.shape[1]) if polarity is None else polarity)
    x = votes.astype(np.float64)
    n, m = x.shape
    weight, rho = np.ones(m), np.zeros((m, m))
    yes, no = (gold == 1).astype(np.float64), (gold == 0).astype(np.float64)
    q = np.where(gold == 1, 0.9, np.where(gold == 0, 0.1, 1 / (1 + np.exp(1.5 - np.clip(leaning, -3, 3)))))
    for k in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        p1, p0 = (q @ x + 0.5) / (q.sum() + 1), ((1 - q) @ x + 0.5) / ((1 - q).sum() + 1)
        if k in (2, 10, 20):  # correlations within the classes, from the posterior so far
            rho = np.zeros((m, m))
            for r, p in ((q, p1), (1 - q, p0)):
                c = x - p
                cov = (c * r[:, None]).T @ c / max(r.sum(), 1e-9)
                d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                rho = np.maximum(rho, np.abs(cov / np.outer(d, d)))
            np.fill_diagonal(rho, 0)
            rho[rho < 0.3] = 0
            weight = 1 / (1 + rho.sum(axis=1))
        p1, p0 = np.clip(p1, 1e-4, 1 - 1e-4), np.clip(p0, 1e-4, 1 - 1e-4)
        on, off = weight * np.log(p1 / p0), weight * np.log((1 - p1) / (1 - p0))
        logit = np.log(prior / (1 - prior)) + x @ (on - off) + off.sum()
        # the label as a voter: how often it is right in either class, twenty right rows as prior
        right1 = np.clip((q @ yes + 19) / (q @ (yes + no) + 20), 0.55, 0.999)
        right0 = np.clip(((1 - q) @ no + 19) / ((1 - q) @ (yes + no) + 20), 0.55, 0.999)
        logit += yes * np.log(right1 / (1 - right0)) + no * np.log((1 - right1) / right0)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q, {"prior": float(q.mean()), "accuracy": p1 / (p1 + p0), "weight": weight, "correlation": rho, "label": (right1, right0)}


def choose(votes: np.ndarray, toxic: np.ndarray, fixed: int, limit: int, cover: int = 3) -> list[int]:
    """Voters by sequential covering: each next one speaks in most toxic rows that fewer than ``cover`` voters speak in.

    The first ``fixed`` columns (lexicon and patterns) are kept in any case.
    """
    chosen = list(range(fixed))
    positive = votes[toxic == 1].astype(np.float32)
    wrong = votes[toxic == 0].sum(axis=0, dtype=np.float32)
    missing = np.full(len(positive), cover, np.float32)
    while len(chosen) < min(limit, votes.shape[1]):
        gain = (missing > 0).astype(np.float32) @ positive - 3 * wrong
        gain[chosen] = -np.inf
        best = int(gain.argmax())
        if gain[best] < 2:
            break
        chosen.append(best)
        missing -= positive[:, best]
    return chosen


def fit_linear(x: np.ndarray, q: np.ndarray, rounds: int = 12, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    w[-1] = np.log((q.mean() + 1e-3) / (1 - q.mean() + 1e-3))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(h, x.T @ (p - q) + penalty * w)
        w -= move * min(1.0, 4 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def fallback() -> Model:
    """Without labelled rows of both classes: the fixed lexicon alone."""
    return Model(-3.0, {"lexicon 1": 3.0, "lexicon 2": 2.0})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: int = FEATURES) -> Model:
    """Fit a model on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    rows = stored(distinct_rows(training_rows(docs, labels, sample)), "toxicity-training")
    names, neg, pos = _select(rows, CANDIDATES)
    if not neg or not pos or not names:
        return fallback()
    index = {x: i for i, x in enumerate(names)}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = [sorted(index[f] for f in features(t or "") if f in index) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(1), "ids": pa.array(ids, pa.list_(pa.int32()))})

    # ``sample`` + ``UNLABELLED`` rows of ``CANDIDATES`` numbers at most
    got = map_batches(rows.unionByName(other_rows(docs)), vote, "toxic int, ids array<int>").toArrow()
    gold = got.column("toxic").fill_null(-1).to_numpy()
    votes = np.zeros((len(gold), len(names)), np.uint8)
    lists = got.column("ids").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    lengths = np.diff(lists.offsets.to_numpy())
    votes[np.repeat(np.arange(len(gold)), lengths), lists.flatten().to_numpy()] = 1
    fixed = sum(x.startswith(("lexicon", "pattern")) for x in names)
    chosen = choose(votes, gold, fixed, limit)
    votes, names = votes[:, chosen], [names[i] for i in chosen]
    order = np.lexsort([*votes[:, : min(8, len(names))].T, votes.sum(axis=1), gold])  # the same fit for any order of the rows
    votes, gold = votes[order], gold[order]
    q, _ = label_model(votes, gold, np.array([-1.0 if x == "lexicon 0" else 1.0 for x in names]))
    sure = gold >= 0  # rows without a label teach the label model only: what no voter knows isn't known to be clean
    w, b = fit_linear(votes[sure], q[sure])
    return Model(b, {x: float(v) for x, v in zip(names, w) if abs(v) > 1e-4})


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: P(toxic) of the whole text, 0 to 1; null counts as empty. No shuffle."""
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out])
    schema = source.withColumn(out, F.lit(0.0)).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = pa.array([model.score(t or "") for t in batch.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names)

    return map_batches(source, run, schema)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; a null doc_id is not held out and not learnt from."""
    model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", split_column().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, columns unchanged."""
    name = fresh(docs, "_toxicity")
    return score(docs, train(docs, labels), out=name).where(F.col(name) < THRESHOLD).drop(name)
