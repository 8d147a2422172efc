"""Toxicity by a chain of linear classifiers (operator 5).

Categories are predicted one after the other: each logistic model sees the words of a text and the probabilities of the
categories before it. In training those probabilities are out-of-fold predictions, so a later model learns from what an earlier one says about
texts it has not seen. Features are words, their first letters and traits of the
whole text (marks, repetition, capitals), chosen per category by their association with the label.

Scale: the models are fitted in one task on a bounded sample of labelled documents (``SAMPLE`` rows, chosen by a hash of
the id); this is the only bound. Scoring is a narrow map over all whole texts by set intersection with the chosen features, without a
shuffle. The sample's ids are broadcast, which its size bounds; the model is a few hundred weights per category.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

#: The most labelled documents that a model is fitted on.
SAMPLE = 12_000
#: Features per category, their least number of documents (and part of the sample), and the least association (p = 0.001).
FEATURES, LEAST_DOCS, LEAST_SHARE, LEAST_G2 = 256, 3, 0.0005, 10.83
FOLDS = 5
PENALTY = 0.03
#: Of the documents without the label a category may reject this part out of fold; the limit lies between these bounds.
FALSE_SHARE, LOWEST, HIGHEST = 0.002, 0.05, 0.5
LETTERS = 4

_EDGES = ",.;:!?\"'()[]{}"
#: Traits of a whole text, with the shares that they must exceed.
MARKS, TRAITS = "#*$%&|<>", {"marks": (0.01, 0.05), "echoes": (0.1, 0.3), "repeats": (0.45, 0.6, 0.8), "capitals": (0.1, 0.3), "lines": (0.2, 0.5)}


class Link(NamedTuple):
    """One model of the chain: weights of features, of the earlier probabilities, the constant, and the limit of rejection."""

    category: str
    features: dict[str, float]
    earlier: list[float]
    constant: float
    limit: float


def features_of(text: str | None) -> set[str]:
    """The different words of a text, lower-cased and without punctuation around them, ``^`` with their first letters, and ``~`` with the text's traits."""
    spoken = (text or "").split()
    words = {w.lower().strip(_EDGES) for w in set(spoken)}
    words.discard("")
    return words | {"^" + w[:LETTERS] for w in words if len(w) > LETTERS} | traits_of(text or "", spoken)


def traits_of(text: str, words: list[str]) -> set[str]:
    """Which limits of ``TRAITS`` a text exceeds: marks among its characters, words equal to the one before, words and lines seen before, words in capitals."""
    if not words:
        return set()
    n, lines = len(words), text.split("\n")
    shares = {"marks": sum(map(text.count, MARKS)) / len(text), "echoes": sum(map(eq, words, words[1:])) / n, "repeats": 1 - len(set(words)) / n,
              "capitals": sum(map(str.isupper, words)) / n, "lines": 1 - len(set(lines)) / len(lines)}
    return {f"~{trait}{k}" for trait, limits in TRAITS.items() for k, limit in enumerate(limits) if shares[trait] > limit}


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _entropy_part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)


def choose(docs: list[set[str]], label: np.ndarray) -> list[str]:
    """The features most associated with the label by the likelihood ratio; ties go to the smaller text."""
    total, inside = Counter(), Counter()
    for words, y in zip(docs, label):
        total.update(words)
        if y:
            inside.update(words)
    n, n1 = len(docs), float(label.sum())
    least = max(LEAST_DOCS, int(LEAST_SHARE * n))
    names = sorted(f for f, k in total.items() if k >= least)
    t, a = np.array([total[f] for f in names], float), np.array([inside[f] for f in names], float)
    if not names or n1 in (0, n):
        return []
    n0 = n - n1
    g2 = 2 * (_entropy_part(a, t * n1 / n) + _entropy_part(t - a, t * n0 / n)
              + _entropy_part(n1 - a, (n - t) * n1 / n) + _entropy_part(n0 - t + a, (n - t) * n0 / n))
    best = np.argsort(-g2, kind="stable")[:FEATURES]
    return [names[k] for k in best if g2[k] >= LEAST_G2]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.full(x.shape[1], PENALTY)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _logistic(x @ w)
        grade = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty), grade)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def train_chain(docs: list[set[str]], labels: dict[str, np.ndarray], folds: np.ndarray) -> list[Link]:
    """The models of the categories in the order of ``labels``. Without both classes a model gives the base rate."""
    earlier = np.empty((len(docs), 0))
    chain = []
    for category, y in labels.items():
        y = y.astype(float)

        def fitted(rows: np.ndarray) -> tuple[list[str], np.ndarray]:
            chosen = choose([docs[k] for k in rows], y[rows])
            return chosen, fit(_matrix([docs[k] for k in rows], chosen, earlier[rows]), y[rows])

        every = np.arange(len(docs))
        chosen, w = fitted(every)
        unseen = np.zeros(len(docs))
        for f in np.unique(folds):
            names, v = fitted(every[folds != f]) if (folds != f).any() else (chosen, w)
            out = every[folds == f]
            x = _matrix([docs[i] for i in out], names, earlier[out])
            unseen[out] = _logistic(x @ v[:-1] + v[-1])
        k = len(chosen)
        chain.append(Link(category, dict(zip(chosen, w[:k].tolist())), w[k:-1].tolist(), float(w[-1]), _limit(unseen[y == 0])))
        earlier = np.concatenate([earlier, unseen[:, None]], axis=1)
    return chain


def _limit(clean: np.ndarray) -> float:
    """The probability that at most ``FALSE_SHARE`` of the clean documents exceed."""
    allowed = int(FALSE_SHARE * len(clean))
    return float(np.clip(np.sort(clean)[::-1][allowed], LOWEST, HIGHEST)) if len(clean) else HIGHEST


def _matrix(docs: list[set[str]], chosen: list[str], earlier: np.ndarray) -> np.ndarray:
    place = {f: k for k, f in enumerate(chosen)}
    x = np.zeros((len(docs), len(chosen)))
    known = set(chosen)
    for row, words in zip(x, docs):
        for f in known & words:
            row[place[f]] = 1.0
    return np.concatenate([x, earlier], axis=1)


def predict(chain: list[Link], text: str | None) -> list[float]:
    """The probability of each category."""
    words, out = features_of(text), []
    for link in chain:
        z = link.constant + sum(link.features[f] for f in sorted(link.features.keys() & words))
        z += sum(w * p for w, p in zip(link.earlier, out))
        out.append(float(_logistic(np.float64(z))))
    return out


def _trainer(categories: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        # in a fixed order, copies of a text once
        sample = sample.sort_values(["key", *categories], kind="stable").drop_duplicates("key")
        docs = [features_of(t) for t in sample["text"]]
        chain = train_chain(docs, {c: sample[c].to_numpy() for c in categories}, (sample["key"].to_numpy() % FOLDS))
        rows = [(k, f, w) for k, link in enumerate(chain) for f, w in
                [*((" " + f, w) for f, w in link.features.items()), *((f"p{j}", w) for j, w in enumerate(link.earlier)), ("c", link.constant), ("l", link.limit)]]
        return pd.DataFrame(rows, columns=["link", "name", "weight"])
    return run


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE) -> list[Link]:
    """A chain for the categories, given as 0/1 expressions over ``labels`` (doc_id, ...).

    Labelled ids are sampled by hash, so a repeated call gives the same chain. Rows with a NULL id or label are left out; with
    no rows the chain is empty.
    """
    names = list(categories)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[e.cast("int").alias(c) for c, e in categories.items()])
    known = known.dropna().dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    rows = text.join(F.broadcast(known), "doc_id").select("text", F.xxhash64("text").alias("key"), *names).dropDuplicates(["key", *names])
    weights = rows.groupBy(F.lit(0).alias("all")).applyInPandas(_trainer(names), "link int, name string, weight double").collect()
    if not weights:
        return []
    chain = []
    for k, name in enumerate(names):
        own = [(r["name"], r["weight"]) for r in weights if r["link"] == k]
        earlier = sorted((int(n[1:]), w) for n, w in own if n[0] == "p")
        chain.append(Link(name, {n[1:]: w for n, w in own if n[0] == " "}, [w for _, w in earlier], dict(own)["c"],
                          dict(own)["l"]))
    return chain


def chain_probabilities(chain: list[Link], text: Column) -> Column:
    """A struct of the probabilities of all categories."""
    shape = T.StructType()
    for link in chain:
        shape.add(link.category, "double")

    @pandas_udf(shape)
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(chain, t) for t in texts], columns=[link.category for link in chain], dtype=float)

    return scored(text)


def toxicity(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """A row for each document: doc_id, a probability for each category, toxic (the last one exceeds its limit).

    NULL and empty texts have no features and get the constants. Repeated rows stay. An empty chain (no labels) finds nothing.
    """
    if not chain:
        return docs.select("doc_id", F.lit(False).alias("toxic"))
    scored = docs.select("doc_id", chain_probabilities(chain, F.col("text")).alias("p"))
    return scored.select("doc_id", *[F.round(F.col("p")[c.category], 9).alias("p_" + c.category) for c in chain],
                         (F.col("p")[chain[-1].category] > chain[-1].limit).alias("toxic"))


def drop_toxic(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """The documents that the chain's last category does not reject, with all their columns."""
    if not chain:
        return docs
    kept = docs.select(F.struct("*").alias("_row"), chain_probabilities(chain, F.col("text")).alias("_p"))
    return kept.filter(F.col("_p")[chain[-1].category] <= chain[-1].limit).select("_row.*")


def label_categories() -> dict[str, Column]:
    """The chain over the table ``labels``: junk first, then toxic."""
    return {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}
