"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases.

Texts are folded before matching: A-Z and homoglyphs (Cyrillic, Greek, full-width and accented look-alikes) to plain letters, digits and signs inside words to
the letters they stand for, zero-width characters away, and combining marks too. The lexicon is learned from labelled rows: words and beginnings of words that are clearly more frequent in toxic texts (lower bound of their log odds) are chosen by a sparse logistic regression; that log odds is the weight.
Exception phrases are learned from the same rows: a word next to a lexicon word with which it hardly ever is toxic. Matches inside an
exception do not count. The score is a logistic function of the summed weight and of the weight per sqrt of the length, fitted on the same rows.

Training uses at most SAMPLE labelled rows (the documented bound; chosen by hash, so alike at every size); the lexicon then fits in a few kilobytes. All
texts are scored whole.

Defined cases: a null or empty text has no match and gets the score of an empty text. A null id counts as the
text '' (crc32 0), so it is not held out, but no label names it. Of different labels of one id the largest counts, of different texts of one id the
smallest (training only). With no usable labels (no toxic or no clean row) the built-in seed weights are used. Repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornloom.llm._shared import slices

#: Production parameters.
SAMPLE, MIN_TOXIC, MIN_SHARE, MIN_ODDS, MIN_RATIO, MIN_TERM, MAX_START, MAX_TERMS, L1, LEAST_WEIGHT, CUT = 5_000, 5, 0.02, 3.0, 1, 3, 8, 600, 0.001, 0.3, 0.7

#: Look-alikes of letters, signs and digits that stand for letters inside words, and characters without width.
HOMOGLYPHS = {
    "а": "a", "в": "b", "г": "r", "е": "e", "ё": "e", "з": "e", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ø": "o", "ł": "l", "đ": "d", "ɑ": "a", "ɡ": "g", "ʏ": "y",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l", "+": "t"}
NO_WIDTH = "­​‌‍⁠﻿"
#: Seed weights for tables without labels, and phrases that are never toxic.
SEED = {"idiot": 4.0, "moron": 4.0, "scum": 4.0, "stupid": 3.0, "loser": 3.0, "pathetic": 3.0, "worthless": 3.0, "disgusting": 3.0, "trash": 2.5, "clown": 2.5}
PHRASES = ("trash can", "trash bin", "trash collection", "take out the trash", "clown fish", "circus clown", "rodeo clown", "sore loser", "worthless check", "idiot proof", "idiot light")

_WORD = re.compile(r"\w+(?:'\w+)*")
#: A run of word characters and masking signs that holds a digit or a sign; tried at the start of runs only, so linear.
_MASKED = re.compile(r"(?<![\w@$!|€£+])(?=\w*[0-9@$!|€£+])[\w@$!|€£+]+")


def _plain_letters() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(c): None for c in NO_WIDTH} | dict.fromkeys(range(0x300, 0x370))
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B), *range(0x1D400, 0x1D7CB), *range(0x24B6, 0x24EA)]:
        base = unicodedata.normalize("NFKD", chr(code))[:1].lower()
        if "a" <= base <= "z":
            table[code] = base
    for c, to in HOMOGLYPHS.items():
        table[ord(c)] = to
        if len(c.upper()) == 1:
            table.setdefault(ord(c.upper()), to)
    return table


_LETTERS = _plain_letters()
_LEET = str.maketrans(LEET)


def _unmask(m: re.Match) -> str:
    word = m[0]
    core = word.rstrip("!|+$")  # closing marks are punctuation
    if not any(c.isalpha() for c in core):
        return word
    return core.translate(_LEET) + " " * (len(word) - len(core))


def fold(text: str | None) -> str:
    """The text in plain lower-case letters."""
    if not text:
        return ""
    low = text.lower() if text.isascii() else text.lower().translate(_LETTERS)
    return _MASKED.sub(_unmask, low)


@dataclass(frozen=True)
class Model:
    """weights: by term; "=word" matches the whole word, "^start" every word that starts so."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    bias: float
    total: float
    density: float


_SEED_MODEL = Model({f"={w}": v for w, v in SEED.items()}, PHRASES, -5.0, 1.5, 5.0)


def build(model: Model) -> ahocorasick.Automaton | None:
    """The automaton over all terms and exception phrases: string -> (length, weight as a whole word, weight as a start, is an exception)."""
    entries: dict[str, list] = {}
    for term, weight in model.weights.items():
        entries.setdefault(term[1:], [len(term) - 1, None, None, False])[1 if term[0] == "=" else 2] = weight
    for phrase in model.exceptions:
        entries.setdefault(phrase, [len(phrase), None, None, False])[3] = True
    if not entries:
        return None
    a = ahocorasick.Automaton()
    for text, entry in entries.items():
        a.add_word(text, (text, *entry))
    a.make_automaton()
    return a


def _inner(c: str) -> bool:
    return c.isalnum() or c == "_"


def matches(automaton: ahocorasick.Automaton | None, folded: str) -> list[tuple[str, float]]:
    """(term, weight) of each match that is not inside an exception phrase."""
    if automaton is None:
        return []
    found, covered, n = [], [], len(folded)
    for end, (text, size, whole, start_weight, phrase) in automaton.iter(folded):
        start = end - size + 1
        if start and _inner(folded[start - 1]):
            continue
        closed = end + 1 >= n or not _inner(folded[end + 1])
        if phrase and closed:
            covered.append((start, end))
        if whole is not None and closed:
            found.append((start, end, "=" + text, whole))
        if start_weight is not None:
            found.append((start, end, "^" + text, start_weight))
    if covered:
        # Matches and phrases both end in ascending order; a phrase covers a match if it starts no later and ends no earlier.
        hidden, last, i = set(), None, len(covered) - 1
        for k in range(len(found) - 1, -1, -1):
            while i >= 0 and covered[i][1] >= found[k][1]:
                last = covered[i][0] if last is None else min(last, covered[i][0])
                i -= 1
            if last is not None and last <= found[k][0]:
                hidden.add(k)
        found = [f for k, f in enumerate(found) if k not in hidden]
    return [(term, weight) for _, _, term, weight in found]


def _features(found: list[tuple[str, float]], folded: str) -> tuple[float, float]:
    """The weight of the distinct terms, and the weight of all matches normalised by length."""
    return min(sum(dict(found).values()), 12.0), min(sum(w for _, w in found) / math.sqrt(25 + folded.count(" ")), 12.0)


def _terms(folded: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(folded)):
        if len(w) >= MIN_TERM and not w.isdigit():
            out.add("=" + w)
            out.update("^" + w[:k] for k in range(MIN_TERM, min(len(w), MAX_START) + 1))
    return out


def _candidates(texts: list[tuple[str, int]]) -> dict[str, float]:
    """Terms that are clearly more frequent in toxic texts: by the log odds ratio less two standard errors."""
    n1 = sum(y for _, y in texts)
    n0 = len(texts) - n1
    toxic: Counter = Counter()
    for t, y in texts:
        if y:
            toxic.update(_terms(t))
    toxic = Counter({w: a for w, a in toxic.items() if a >= max(MIN_TOXIC, MIN_SHARE * n1)})
    automaton = build(Model(dict.fromkeys(toxic, 1.0), (), 0, 0, 0))
    clean: Counter = Counter()
    for t, y in texts:
        if not y:
            clean.update({term for term, _ in matches(automaton, t)})
    sure = {}
    for w, a in toxic.items():
        b = clean[w]
        low = math.log(((a + 0.5) * (n0 - b + 0.5)) / ((b + 0.5) * (n1 - a + 0.5))) - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - a + 0.5) + 1 / (n0 - b + 0.5))
        if low >= math.log(MIN_ODDS):
            sure[w] = low
    dropped = set()
    # Of starts with the same counts the longest stands for all, and a whole word for its starts.
    for w in sorted(sure, key=lambda w: (-len(w), w[0] == "^")):
        shorter = "^" + w[1:] if w[0] == "=" else w[:-1]
        if shorter in sure and (toxic[shorter], clean[shorter]) == (toxic[w], clean[w]):
            dropped.add(shorter)
    return {w: sure[w] for w in sorted(sure.keys() - dropped, key=lambda w: (-sure[w], w))[:MAX_TERMS]}


def _selected(terms: dict[str, float], texts: list[tuple[str, int]]) -> dict[str, float]:
    """The terms, with their log odds as weights, that get a weight in a logistic regression on presence with an L1 penalty.

    None is negative there, so terms that only keep company with others explain nothing beyond them and go.
    """
    place = {w: i for i, w in enumerate(terms)}
    automaton = build(Model(terms, (), 0, 0, 0))
    x = np.zeros((len(texts), len(terms)), np.float32)
    for r, (t, _) in enumerate(texts):
        for w, _ in matches(automaton, t):
            x[r, place[w]] = 1
    y = np.array([y for _, y in texts], np.float32)
    n, w, bias = len(y), np.zeros(len(terms), np.float32), float(np.log(y.mean() / (1 - y.mean())))
    v, v_bias, momentum = w, bias, 1.0
    rate = 4 / (float(np.linalg.eigvalsh((x.T @ x) / n).max(initial=0)) + 1)
    for _ in range(600):
        gap = 1 / (1 + np.exp(-np.clip(x @ v + v_bias, -30, 30))) - y
        new, new_bias = np.maximum(0, v - rate * (x.T @ gap / n + L1)), v_bias - rate * float(gap.mean())
        faster = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        v, v_bias = new + (momentum - 1) / faster * (new - w), new_bias + (momentum - 1) / faster * (new_bias - bias)
        w, bias, momentum = new, new_bias, faster
    return {t: round(terms[t], 4) for t, c in zip(terms, w, strict=True) if c >= LEAST_WEIGHT}


def train(rows: list[tuple[str | None, int]]) -> Model:
    """A model of (text, label) rows; plain Python over a bounded sample."""
    texts = [(fold(t), int(y)) for t, y in rows]
    if len({y for _, y in texts}) < 2:
        return _SEED_MODEL
    weights = _selected(_candidates(texts), texts)
    if not weights:
        return _SEED_MODEL
    automaton = build(Model(weights, (), 0, 0, 0))
    around: Counter = Counter()
    toxic: Counter = Counter()
    for t, y in texts:
        if not matches(automaton, t):
            continue
        ws = _WORD.findall(t)
        for a, b in zip(ws, ws[1:], strict=False):
            if matches(automaton, a) or matches(automaton, b):
                around[f"{a} {b}"] += 1
                toxic[f"{a} {b}"] += y
    learned = sorted(p for p, n in around.items() if n >= 8 and toxic[p] <= 0.1 * n)
    exceptions = tuple(dict.fromkeys([*PHRASES, *learned]))
    # Outside the exceptions a term must be toxic by far more often than not.
    automaton = build(Model(weights, exceptions, 0, 0, 0))
    clean: Counter = Counter()
    toxic = Counter()
    for t, y in texts:
        (toxic if y else clean).update({term for term, _ in matches(automaton, t)})
    weights = {w: v for w, v in weights.items() if toxic[w] >= MIN_RATIO * clean[w] and toxic[w]}
    if not weights:
        return _SEED_MODEL
    automaton = build(Model(weights, exceptions, 0, 0, 0))
    x = np.array([[1.0, *_features(matches(automaton, t), t)] for t, _ in texts])
    y = np.array([y for _, y in texts], float)
    beta, ridge = np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -2, 2)
    return Model(weights, exceptions, *(float(b) for b in beta))


def _score(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = build(model)
        for f in slices(frames):
            out = []
            for t in f["text"]:
                folded = fold(t if isinstance(t, str) else None)
                total, density = _features(matches(automaton, folded), folded)
                z = model.bias + model.total * total + model.density * density
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield f.drop(columns=["text"]).assign(score=out)

    return run


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Trains on the labelled rows that are not held out, at most `sample` of them by the order of a hash of the id."""
    chosen = labels.where(~held_out(F.col(key)) & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("_y"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(sample)  # `sample` ids at most: bounded, so broadcast
    # Of rows with one id the smallest text is taken, so repeated ids don't exceed the bound.
    texts = docs.select(key, F.col(text).alias("_t")).join(F.broadcast(chosen), key).groupBy(key).agg(F.min("_t").alias("_t"), F.first("_y").alias("_y"))
    # `sample` texts at most reach the driver.
    return train(sorted(((r["_t"], r["_y"]) for r in texts.select("_t", "_y").collect()), key=lambda r: (r[1], r[0] or "")))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """key, held_out, score, predicted for each row."""
    kind = docs.schema[key].dataType.simpleString()
    s = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(_score(model), f"key {kind}, score double")
    return s.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    return score(docs, fit(docs, labels, **names))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the cut; only the text travels to Python."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in _score(model)(pd.DataFrame({"text": b}) for b in batches):
            yield frame["score"]

    return docs.where(scores(F.col(text)) < cut)
