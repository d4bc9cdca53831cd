"""Toxicity by weak supervision.

Voters.  A lexicon voter says 1 where a text holds one of its words, and abstains elsewhere; a pattern voter
does the same for a pattern around lexicon words; the silence voter says 0 where no lexicon has a word.  Beside a
fixed lexicon of English insults, lexicons of whole words and of word beginnings are mined from labelled
training rows by the likelihood ratio of their document counts.

Label model.  The vote patterns of all documents are counted by Spark.  A generative model of a hidden label
with a prior, and for each voter its chance of each vote under either label, is fitted by expectation
maximisation.  Voters whose votes still agree beyond what the labels explain are correlated; each voter's
evidence is divided by the weight of the voters it goes along with, and the model is fitted again.

Classifier.  A logistic regression on the presence of lexicon words and beginnings is trained on the posterior
labels of training documents and scores every text: a linear score, never a label, lang, source or doc_id.

Bounds.  Lexicons are mined from an expected 20,000 labelled rows (``labelled(sample=)``).  Mined entries (``most``), vote patterns (a voter has two votes at most) and the classifier's ``sample``
patterns are the only things that reach the driver; counts and patterns cover all documents.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import bounded_batches, crc32_remainder, documents, id_text, map_rows, shared_checkpoint

# English words that insult or demean a person.
INSULTS = [
    "idiot", "idiots", "moron", "morons", "stupid", "imbecile", "loser", "losers", "scum", "clown", "trash",
    "worthless", "pathetic", "disgusting", "bastard", "bitch", "asshole", "dumbass", "jerk", "creep", "freak",
    "retard", "filth", "vermin", "slut", "whore", "pig", "scumbag", "degenerate", "subhuman",
]
BEGINNINGS = (4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"!{2,}|[?!]{3,}")
_SECOND = re.compile(r"\b(?:you|your|you're|ur)\b")
VOTERS = ["insults", "mined words a", "mined words b", "mined words c", *(f"beginnings {n}" for n in BEGINNINGS), "repeated", "dense", "second person", "shouted", "silence"]


@dataclass
class Lexicons:
    """Entries with the voter that owns each; also the classifier's features, in this order."""

    words: dict[str, int] = field(default_factory=dict)
    beginnings: dict[str, int] = field(default_factory=dict)

    def features(self) -> list[str]:
        return [*self.words, *(b + "*" for b in self.beginnings)]

    def find(self, text: str):
        """(feature numbers present, votes, number of words) of a text."""
        lower = text.lower()
        words = _WORD.findall(lower)
        distinct = set(words)
        index = self._index
        hits = [index[w] for w in distinct & self.words.keys()]
        long = [w for w in distinct if len(w) > BEGINNINGS[0]]
        stems = {w[:n] for w in long for n in BEGINNINGS if len(w) > n} & self.beginnings.keys() if self.beginnings else set()
        hits += [index[b + "*"] for b in stems]
        return sorted(hits), words, distinct, stems, lower

    @property
    def _index(self) -> dict[str, int]:
        if "_index" not in self.__dict__:
            self.__dict__["_index"] = {f: k for k, f in enumerate(self.features())}
        return self.__dict__["_index"]

    def votes(self, text: str):
        """(feature numbers, votes); a vote is 0 (abstains), 1 (toxic) or 2 (clean)."""
        hits, words, distinct, stems, lower = self.find(text)
        votes = [0] * len(VOTERS)
        bad = {w for w in distinct if w in self.words or any(w[:n] in stems for n in BEGINNINGS if len(w) > n)} if hits else set()
        for w in distinct & self.words.keys():
            votes[self.words[w]] = 1
        for b in stems:
            votes[self.beginnings[b]] = 1
        if bad:
            n = sum(w in bad for w in words)
            votes[VOTERS.index("repeated")] = int(n >= 3)
            votes[VOTERS.index("dense")] = int(n * 50 >= len(words))
            votes[VOTERS.index("second person")] = int(bool(_SECOND.search(lower)))
            votes[VOTERS.index("shouted")] = int(bool(_SHOUT.search(text)))
        else:
            votes[VOTERS.index("silence")] = 2
        return hits, votes


def labelled(docs: DataFrame, labels: DataFrame, sample: int = 20_000, modulus: int = 3, held: int = 1) -> DataFrame:
    """text and toxic (0 or 1) of labelled rows that may be learned from; one row for each document and label.

    sample: the expected number of labels used, chosen by a hash of doc_id; so they can be broadcast and no text moves.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc32_remainder(F.col("doc_id"), modulus) != held))
    rate = min(1.0, sample / max(1, marks.count()))
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity sample")), F.lit(1 << 30)) / float(1 << 30)
    return id_text(docs).join(F.broadcast(marks.filter(unit < rate).distinct()), "doc_id").select("text", "toxic")


def mine(rows: DataFrame, most: int = 3000) -> Lexicons:
    """Words and beginnings that go with label 1 by a likelihood ratio no chance entry reaches (see least)."""
    known = set(INSULTS)
    lexicons = Lexicons({w: VOTERS.index("insults") for w in INSULTS}, {})

    def entries(texts: list[str], toxic: list[int]) -> dict:
        counts: dict[str, list[int]] = {}
        for text, label in zip(texts, toxic):
            distinct = set(_WORD.findall(text.lower()))
            for e in distinct | {w[:n] + "*" for w in distinct - known for n in BEGINNINGS if len(w) > n}:
                counts.setdefault(e, [0, 0])[label] += 1
        return {"entry": list(counts), "n0": [c[0] for c in counts.values()], "n1": [c[1] for c in counts.values()]}

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return lexicons
    counted = map_rows(rows, ["text", "toxic"], entries, "entry string, n0 long, n1 long").groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    k0, k1 = F.col("n0"), F.col("n1")
    kept = counted.filter((k1 >= 4) & (k1 * float(n0) > k0 * (100.0 * n1)))
    expected = (k0 + k1) * (n1 / (n0 + n1))
    other = (k0 + k1) * (n0 / (n0 + n1))
    ratio = 2 * (k1 * F.ln(k1 / expected) + F.when(k0 > 0, k0 * F.ln(k0 / other)).otherwise(0.0))
    # entries grow with the labelled rows; the least ratio grows so that about as few pass by chance
    least = 22.0 + 2 * math.log(max(1.0, (n0 + n1) / 400))
    for r in kept.withColumn("ratio", ratio).filter(F.col("ratio") >= least).orderBy(F.desc("ratio"), "entry").limit(most).collect():
        e = r["entry"]
        if e.endswith("*"):
            lexicons.beginnings[e[:-1]] = VOTERS.index(f"beginnings {len(e) - 1}")
        elif e not in lexicons.words:
            lexicons.words[e] = VOTERS.index("mined words " + "abc"[sum(map(ord, e)) % 3])
    return lexicons


@dataclass
class LabelModel:
    """Chances of votes: votes[y, voter, vote], the prior of label 1, and each voter's weight."""

    prior: float
    chances: np.ndarray
    weights: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = np.arange(votes.shape[1])
        logs = np.log(self.chances)
        evidence = ((logs[1][at, votes] - logs[0][at, votes]) * self.weights).sum(axis=1) + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 50) -> LabelModel:
    """Expectation maximisation over distinct vote patterns, with weights for correlated voters."""
    m = votes.shape[1]
    prior = min(max(prior, 1e-4), 0.5)
    one_hot = np.eye(3)[votes]  # pattern x voter x vote
    model = LabelModel(prior, np.tile(np.array([[0.9, 0.02, 0.08], [0.6, 0.38, 0.02]])[:, None, :], (1, m, 1)), np.ones(m))
    for stage in range(2):
        for _ in range(rounds):
            p = model.posterior(votes)
            mass = np.stack([(1 - p) * counts, p * counts])
            # a voter is taken to be better than chance: pseudo-counts keep its meaning
            pseudo = np.array([[0.9, 0.02, 0.08], [0.6, 0.38, 0.02]]) * 5
            chances = np.einsum("yp,pvk->yvk", mass, one_hot) + pseudo[:, None, :]
            model.chances = chances / chances.sum(axis=2, keepdims=True)
        if stage == 0:
            fires = (votes == 1).astype(float)
            p = model.posterior(votes)
            mass = np.stack([(1 - p) * counts, p * counts])
            means = np.stack([mass[y] @ fires / max(mass[y].sum(), 1e-9) for y in (0, 1)])
            cov = sum((fires - means[y]).T @ ((fires - means[y]) * mass[y][:, None]) for y in (0, 1)) / max(counts.sum(), 1e-9)
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            correlation = np.clip(cov / spread[:, None] / spread[None, :], 0, 1)
            np.fill_diagonal(correlation, 0)
            model.weights = 1 / (1 + np.where(np.diag(cov) > 1e-9, 1, 0) * correlation.sum(axis=1))
    return model


def fit_logistic(features: list[list[int]], targets: np.ndarray, counts: np.ndarray, n: int, steps: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent with momentum on sparse presence features; counts weigh the rows."""
    w, bias, vw, vb = np.zeros(n), -3.0, np.zeros(n), 0.0
    if not len(features):
        return w, bias
    lengths = np.array([len(f) for f in features])
    row, col = np.repeat(np.arange(len(features)), lengths), np.array([k for f in features for k in f], dtype=np.int64)
    seen = np.maximum(np.bincount(col, counts[row], n), 1)
    for _ in range(steps):
        z = np.bincount(row, w[col], len(features)) + bias
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets
        g *= counts
        vw = 0.9 * vw - 2.0 * (np.bincount(col, g[row], n) / seen + ridge * w)  # each feature by its own rate
        vb = 0.9 * vb - 0.5 * g.sum() / counts.sum()
        w, bias = np.clip(w + vw, -12, 12), bias + vb
    return w, float(bias)


@dataclass
class ToxicityModel:
    lexicons: Lexicons
    weights: np.ndarray
    bias: float
    label_model: LabelModel

    def score(self, text: str) -> float:
        hits = self.lexicons.find(text)[0]
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(self.weights[hits].sum()))))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> ToxicityModel:
    """Learn voters, label model and classifier.  sample: the most patterns of features, the commonest first, that
    the classifier is trained on, each weighed by its documents.

    Without labelled rows the fixed lexicon alone votes; without documents the classifier answers its bias.
    """
    rows = labelled(docs, labels)
    lexicons = mine(rows)
    share = rows.agg(F.avg("toxic")).first()[0]

    def vote(ids: list[int], texts: list[str]) -> dict:
        got = [lexicons.votes(t) for t in texts]
        return {"learn": [i for i in ids], "hits": [g[0] for g in got], "votes": ["".join(map(str, g[1])) for g in got]}

    source = id_text(docs).select(F.coalesce(crc32_remainder(F.col("doc_id"), 3) != 1, F.lit(False)).cast("int").alias("learn"), "text")
    cast = map_rows(source, ["learn", "text"], vote, "learn int, hits array<int>, votes string")
    # a pattern of votes and features, how often, and how often among rows that may be learned from
    grouped = shared_checkpoint(cast.groupBy("votes", "hits").agg(F.count(F.lit(1)).alias("n"), F.sum("learn").alias("learn")))
    patterns = grouped.groupBy("votes").agg(F.sum("n").alias("n")).collect()
    shape = (len(patterns), len(VOTERS))
    votes = np.array([[int(c) for c in r["votes"]] for r in patterns], dtype=np.int64).reshape(shape)
    model = fit_label_model(votes, np.array([r["n"] for r in patterns], dtype=float), 0.1 if share is None else float(share))
    posterior = dict(zip([r["votes"] for r in patterns], model.posterior(votes).tolist()))
    seen = grouped.filter("learn > 0").orderBy(F.desc("learn"), F.xxhash64("votes", "hits")).limit(sample).select("votes", "hits", "learn").collect()
    targets = np.array([posterior.get(r["votes"], 0.0) for r in seen])
    weights, bias = fit_logistic([list(r["hits"]) for r in seen], targets, np.array([r["learn"] for r in seen], dtype=float), len(lexicons.features()))
    return ToxicityModel(lexicons, weights, bias, model)


def score(text: Column, model: ToxicityModel) -> Column:
    """The classifier's score of a text column; null is the empty text."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(model.score).astype("float64")

    return run(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold) of each row; a null text is empty; repeated rows
    each give a row; an empty table gives none; other columns are ignored."""
    bounded_batches(docs.sparkSession)
    scored = id_text(docs).select("doc_id", score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, documents(spark, sf_dir, "labels"))
    held = F.coalesce(crc32_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
