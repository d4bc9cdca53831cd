"""Language identification with mixed-language spans.

The letters' script narrows each word's candidate languages.  A word's score for a candidate is a naive Bayes
sum over its character n-grams, learned from labelled documents, and Viterbi over a document's words, with a
penalty for each switch of language, labels spans.

Learning: the n-gram counts come from a sample of expected ``sample_docs`` documents for each language, chosen
by a hash of doc_id; counts are aggregated by Spark into ``2 ** bits`` hashed features, so what reaches the
driver, and the table sent to the executors, is bounded by that parameter times the number of languages.

Scoring is one pass without a shuffle.  Word scores of an Arrow batch are computed at once.  For most documents
a bound proves that no switch can pay, and the best single language is Viterbi's own answer; only the others
run the recursion.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import crc32_remainder, documents, id_text, map_rows

# First code points of the ranges of scripts, and the script from there on ("" for none or others).
SCRIPT_RANGES = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, ""), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, ""), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, ""), (0x0E00, "thai"), (0x0E80, ""), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, ""), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0xA000, ""),
    (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, ""), (0x20000, "han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_STARTS = np.array([0, *(start for start, _ in SCRIPT_RANGES)], dtype=np.uint32)
_SCRIPT_OF = np.array([SCRIPTS.index(""), *(SCRIPTS.index(name) for _, name in SCRIPT_RANGES)])
# letters, and numerals that are no decimal digits: a class of the letters alone would be a long list, gone through for each sign
_RUN = re.compile(r"[^\W\d_]+")
_NGRAMS = (1, 2, 3, 4)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters (Unicode category L), in lower case."""
    runs = _RUN.findall(text.lower())
    if text.isascii() or "".join(runs).isalpha():
        return runs
    return [word for run in runs for word in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def _letters(words: list[str]):
    """Code points of all words, each between two zeros, and where each word (with its first zero) starts."""
    joined = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    return joined, lengths, starts


def ngram_features(words: list[str], bits: int):
    """(word index, feature) of every n-gram of the words, the zeros at both ends counting as letters."""
    codes, lengths, starts = _letters(words)
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    out_word, out_feature = [], []
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(_NGRAMS) + 1):
        m = len(codes) - n + 1
        rolled = (rolled[:m] + mixed[n - 1 : n - 1 + m]) * np.uint64(0xBF58476D1CE4E5B9)
        rolled ^= rolled >> np.uint64(29)
        first = np.arange(m)
        inside = first[: m][(first < len(owner)) if m > len(owner) else slice(None)]
        w = owner[inside]
        fits = inside + n - 1 <= starts[w] + lengths[w] + 1
        if n == 1:
            fits &= codes[inside] != 0
        keep = inside[fits]
        out_word.append(owner[keep])
        out_feature.append((rolled[keep] >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out_word), np.concatenate(out_feature)


def word_scripts(words: list[str]) -> np.ndarray:
    """The script of each word's first letter, as an index into SCRIPTS."""
    first = np.fromiter((ord(w[0]) for w in words), dtype=np.uint32, count=len(words))
    return _SCRIPT_OF[np.searchsorted(_STARTS, first, side="right") - 1]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # feature x language: centred log probabilities
    allowed: np.ndarray  # script x language
    bits: int
    switch: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        """word x language.  A script that no learned language uses gives no evidence."""
        k = len(self.languages)
        word, feature = ngram_features(words, self.bits)
        scores = np.stack([np.bincount(word, self.weights[feature, j], len(words)) for j in range(k)], axis=1)
        # n-grams overlap, so their evidence is damped to about one n-gram for each letter
        scores = np.clip(scores / len(_NGRAMS), -12, 12)
        ok = self.allowed[word_scripts(words)]
        return np.where(ok, scores, np.where(ok.any(axis=1, keepdims=True), -12.0, 0.0))

    def path(self, s: np.ndarray) -> np.ndarray:
        """Viterbi's best language of each word (ties: the earlier language, and rather no switch)."""
        best = int(np.argmax(s.sum(axis=0)))
        gain = np.cumsum(s - s[:, best : best + 1], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros(s.shape[1]), gain[:-1]]), axis=0)
        # m switches leave at most 2 m stretches off the best language; if each gains under half a penalty, none pays
        if (gain - low).max() <= self.switch / 2:
            return np.full(len(s), best)
        k = s.shape[1]
        back = np.empty((len(s), k), dtype=np.int32)
        v = s[0].copy()
        stay = np.arange(k)
        for t in range(1, len(s)):
            top = int(np.argmax(v))
            moved = v[top] - self.switch > v
            back[t] = np.where(moved, top, stay)
            v = np.where(moved, v[top] - self.switch, v) + s[t]
        out = np.empty(len(s), dtype=np.int64)
        out[-1] = int(np.argmax(v))
        for t in range(len(s) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def label(self, text_words: list[list[str]]):
        """For each text (language, score, spans): the language of most letters; spans are (language, first word, words)."""
        index: dict[str, int] = {}
        rows = [[index.setdefault(w, len(index)) for w in words] for words in text_words]
        if not index or not self.languages:
            return [("und", 0.0, [])] * len(rows)
        vocabulary = list(index)
        scores = self.word_scores(vocabulary)
        lengths = np.fromiter(map(len, vocabulary), dtype=np.float64, count=len(vocabulary))
        out = []
        for row in rows:
            if not row:
                out.append(("und", 0.0, []))
                continue
            at = np.array(row)
            s, n = scores[at], lengths[at]
            path = self.path(s)
            share = np.bincount(path, n, len(self.languages))
            top = int(np.argmax(share))
            total = s.sum(axis=0)
            sure = 1 / np.exp(np.clip(total - total[top], -50, 50)).sum()
            edges = np.flatnonzero(np.diff(path)) + 1
            firsts = [0, *edges.tolist()]
            spans = [(self.languages[path[a]], a, b - a) for a, b in zip(firsts, [*firsts[1:], len(path)])]
            out.append((self.languages[top], float(min(1.0, max(0.0, share[top] / share.sum() * (0.5 + 0.5 * sure)))), spans))
        return out


def fit(docs: DataFrame, holdout: int = 5, sample_docs: int = 3000, bits: int = 16, switch: float = 12.0) -> LanguageModel:
    """Learn from rows with text and lang whose crc32(doc_id) mod holdout is not 0.

    A table without such rows gives a model without languages, which answers "und" everywhere.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.coalesce(crc32_remainder(F.col("doc_id"), holdout), F.lit(0)) != 0))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1 << bits, 0)), np.zeros((len(SCRIPTS), 0), bool), bits, switch)
    rates = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_docs / sizes[lang]))])
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(unit < F.element_at(rates, F.col("lang"))).select("lang", "text")

    def count(langs: list[str], texts: list[str]) -> dict:
        out: dict[str, list] = {"lang": [], "feature": [], "n": []}
        by: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts):
            by.setdefault(lang, []).extend(words_of(text))
        for lang, words in by.items():
            if not words:
                continue
            n = np.bincount(ngram_features(words, bits)[1], minlength=1 << bits)
            scripts = np.bincount(word_scripts(words), minlength=len(SCRIPTS))
            for base, counts in ((0, n), (1 << bits, scripts)):
                at = np.flatnonzero(counts)
                out["lang"] += [lang] * len(at)
                out["feature"] += (at + base).tolist()
                out["n"] += counts[at].tolist()
        return out

    counted = map_rows(sample, ["lang", "text"], count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(((1 << bits) + len(SCRIPTS), len(languages)))
    counts[counted["feature"], [languages.index(x) for x in counted["lang"]]] = counted["n"]
    grams, scripts = counts[: 1 << bits], counts[1 << bits :]
    weights = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * len(grams)))
    return LanguageModel(languages, weights - weights.mean(axis=1, keepdims=True), scripts >= np.maximum(1, 0.01 * scripts.sum(axis=0)), bits, switch)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and spans (language, first word, words) of each row.

    A text that is null or has no letter is "und" with score 0 and no spans.  Repeated rows each give a row; an
    empty table gives none; other columns are ignored.
    """

    def label(ids: list[int], texts: list[str]) -> dict:
        got = model.label([words_of(t) for t in texts])
        return {"doc_id": ids, "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "spans": [[{"lang": a, "first": b, "words": c} for a, b, c in g[2]] for g in got]}

    return map_rows(id_text(docs), ["doc_id", "text"], label, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first:long,words:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(crc32_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return identify(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
