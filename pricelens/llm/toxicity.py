"""Toxicity by a classifier chain.

Categories are predicted in a fixed order by linear (logistic) models over the
words of a text, their beginnings (which stand for inflected forms) and a few
ratios.  A later model also gets the probabilities of the earlier categories; for
training these come from out-of-fold models, so they are as uncertain as they
will be on new documents.

The models are fitted on at most ``sample_rows`` labelled documents (those with
the smallest hashes), the only part of the input that reaches the driver, as
word numbers.  Scoring is one pass over all whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.chosen_path import ngrams
from pricelens.llm.common import ALNUM_WORD, map_rows, text_bytes
from pricelens.llm.contamination import words_of
from pricelens.session import checkpoint

# Bounds of what is fitted: labelled rows, words and beginnings that are looked
# at, and those a model uses.
SAMPLE_ROWS = 8000
VOCABULARY = 40_000
MODEL_WORDS = 400
STEMS = (4, 5, 6)          # characters of a beginning
FOLDS = 5
MIN_Z = 4.0             # a word's least association with a category, in standard errors
RIDGE = 0.05
RATIOS = 4
# Rows that the driver's sums work on at a time.
BLOCK_ROWS = 500


def ratios(text: str, words: Sequence[bytes], distinct: int) -> list[float]:
    """Length, variety, and the shares of symbols and capitals."""
    n = max(1, len(text))
    return [np.log1p(len(words)) / 5, distinct / max(1, len(words)),
            min(1.0, 5 * sum(map(text.count, "#$%&*!|<>")) / n), min(1.0, 2 * sum(c.isupper() for c in text) / n)]


def read(text: bytes | None) -> tuple[set[bytes], list[float]]:
    """Words and their beginnings, and the ratios."""
    plain = (text or b"").decode("utf-8", "replace")
    words = words_of(plain.lower().encode())
    distinct = set(words)
    stems = {w.decode()[:n].encode() + b"~" for w in distinct for n in STEMS if len(w) > n}
    return distinct | stems, ratios(plain, words, len(distinct))


def copy_key(text: bytes | None) -> int:
    """The smallest hash of the n-grams: equal for near copies with the probability of their similarity."""
    grams = ngrams(text)
    return int(grams[0].astype(np.int64)) if len(grams) else 0


@dataclass
class Linear:
    """A logistic model on some words, the ratios and earlier probabilities."""

    words: np.ndarray
    weights: np.ndarray         # words, ratios, earlier probabilities, bias

    def logit(self, has: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return has @ self.weights[:len(self.words)] + dense @ self.weights[len(self.words):-1] + self.weights[-1]


def probability(logit):
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit_linear(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, n_words: int, most: int = MODEL_WORDS) -> Linear:
    """Select the words most associated with ``y``, then Newton steps with a ridge penalty."""
    n, pos = len(y), float(y.sum())
    if pos in (0.0, float(n)) or n == 0:        # one class: its smoothed share
        weights = np.zeros(dense.shape[1] + 1)
        weights[-1] = np.log((pos + 0.5) / (n - pos + 0.5))
        return Linear(np.empty(0, np.int64), weights)
    dp, dn = (document_counts([r for r, is_one in zip(rows, y) if is_one == k], n_words) for k in (1, 0))
    df = dp + dn
    # difference of a word's document share between the classes, in standard errors
    share = (df + 1) / (n + 2)
    z = (dp / pos - dn / (n - pos)) / np.sqrt(share * (1 - share) * (1 / pos + 1 / (n - pos)))
    words = np.argsort(-np.abs(z), kind="stable")[:most]
    words = np.sort(words[np.abs(z[words]) >= MIN_Z])
    x = np.column_stack((indicator(rows, words), dense.astype(np.float32), np.ones(n, np.float32)))
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = np.log(pos / (n - pos))
    for _ in range(25):
        bend, slope = np.diag(penalty + 1e-9), -penalty * w
        for a in range(0, n, BLOCK_ROWS):
            part = x[a:a + BLOCK_ROWS].astype(float)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            bend += part.T @ (part * (p * (1 - p))[:, None])
            slope += part.T @ (y[a:a + BLOCK_ROWS] - p)
        step = np.linalg.solve(bend, slope)
        w = w + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Linear(words, w)


def document_counts(rows: list[np.ndarray], n_words: int) -> np.ndarray:
    """In how many rows each word stands."""
    total = np.zeros(n_words, np.int64)
    for a in range(0, len(rows), BLOCK_ROWS):
        total += np.bincount(np.concatenate(rows[a:a + BLOCK_ROWS]), minlength=n_words)
    return total


def indicator(rows: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """0/1 matrix of the chosen words."""
    out = np.zeros((len(rows), len(words)), np.float32)
    if len(words):
        for i, r in enumerate(rows):
            at = np.searchsorted(words, r)
            at[at == len(words)] = 0
            out[i, at[words[at] == r]] = 1
    return out


def best_threshold(logit: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, in the middle of its gap; never met if nothing is positive."""
    if not y.any():
        return float("inf")
    order = np.argsort(-logit, kind="stable")
    s, hit = logit[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 1)


@dataclass
class Chain:
    categories: list[str]
    vocabulary: list[bytes]             # only words that a model uses
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def logits(self, text: bytes | None) -> list[float]:
        distinct, dense = read(text)
        index = self.index
        rows = [np.sort(np.fromiter((index[w] for w in distinct & index.keys()), np.int64))]
        out: list[float] = []
        for m in self.models:
            out.append(float(m.logit(indicator(rows, m.words), np.array([dense + [float(probability(z)) for z in out]]))[0]))
        return out

    @property
    def index(self) -> dict[bytes, int]:
        if not hasattr(self, "_index"):
            self._index = {w: i for i, w in enumerate(self.vocabulary)}
        return self._index


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, F.Column], id_col: str = "doc_id", text_col: str = "text",
              label_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> Chain:
    """Fit a chain over ``categories`` (name -> boolean column of ``labels``), in their order.

    Label rows with a null id or a null category are left out; of repeated ids
    and documents one is taken.  Without labelled documents the chain predicts
    shares of one half and rejects nothing.
    """
    names = list(categories)
    marked = labels.select(F.col(label_id).cast("long").alias("__label_id"), *(c.cast("int").alias(f"__{n}") for n, c in categories.items())).dropna()
    marked = marked.groupBy("__label_id").agg(*(F.max(f"__{n}").alias(f"__{n}") for n in names))
    marked = marked.orderBy(F.xxhash64("__label_id"), "__label_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    # at most sample_rows ids are broadcast
    sample = checkpoint(texts.join(F.broadcast(marked), F.col("__id") == F.col("__label_id")).drop("__label_id"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("__text", F.lit(""))), F.lit(ALNUM_WORD), F.lit(0)))
    stems = [F.transform(F.filter("ws", lambda w: F.octet_length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("~"))) for n in STEMS]
    known = sample.select(words.alias("ws")).select(F.explode(F.array_distinct(F.concat("ws", *stems))).alias("w")).groupBy("w").count().filter("count > 2").orderBy(F.desc("count"), "w").limit(VOCABULARY)
    vocabulary = sorted(r.w.encode() for r in known.collect())
    sent = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(sent.value)}
        for batch in batches:
            found = [read(t) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sorted(index[w] for w in d & index.keys()) for d, _ in found], pa.list_(pa.int32())),
                 pa.array([x for _, x in found], pa.list_(pa.float64())),
                 pa.array([copy_key(t) for t in text_bytes(batch.column(1))], pa.int64()), *batch.columns[2:]],
                names=["id", "words", "ratios", "copy", *names])

    schema = "id long, words array<int>, ratios array<double>, copy long, " + ", ".join(f"`{n}` int" for n in names)
    # of the sample's copies one counts, lest what a copied text happens to hold looks telling
    table = sample.mapInArrow(numbers, schema).toArrow().sort_by("id")
    _, first = np.unique(table.column("copy").to_numpy(), return_index=True)
    table = table.take(np.sort(first)).combine_chunks()
    words = table.column("words").combine_chunks()
    # views of one flat array, not a Python number for each word
    flat, ends = words.values.to_numpy(), words.offsets.to_numpy()
    rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    dense = np.array(table.column("ratios").to_pylist(), float).reshape(len(rows), RATIOS)
    fold = np.arange(len(rows)) % folds
    chain = Chain(names, vocabulary)
    for name in names:
        y = table.column(name).to_numpy().astype(float)
        out_of_fold = np.zeros(len(rows))
        for k in range(folds):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            model = fit_linear([rows[i] for i in train], dense[train], y[train], len(vocabulary))
            out_of_fold[test] = model.logit(indicator([rows[i] for i in test], model.words), dense[test])
        chain.models.append(fit_linear(rows, dense, y, len(vocabulary)))
        chain.thresholds.append(best_threshold(out_of_fold, y))
        dense = np.column_stack((dense, probability(out_of_fold)))
    used = np.unique(np.concatenate([m.words for m in chain.models] or [np.empty(0, np.int64)]))
    for m in chain.models:
        m.words = np.searchsorted(used, m.words)
    chain.vocabulary = [vocabulary[i] for i in used]
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``p_<category>`` and boolean ``is_<category>`` for each input row.

    A null text is empty and is scored like an empty one; null ids and repeated
    rows are kept, an empty table gives an empty result, other columns are
    ignored whatever their names.
    """
    names = chain.categories
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def row(doc_id, text):
        c = sent.value
        z = c.logits(text)
        return (doc_id, *(float(probability(x)) for x in z), *(x >= t for x, t in zip(z, c.thresholds)))

    arrow = pa.schema([("doc_id", pa.int64()), *((f"p_{n}", pa.float64()) for n in names), *((f"is_{n}", pa.bool_()) for n in names)])
    schema = ", ".join(["doc_id long", *(f"`p_{n}` double" for n in names), *(f"`is_{n}` boolean" for n in names)])
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), row, schema, arrow)


def remove_rejected(docs: DataFrame, chain: Chain, category: str = "toxic", text_col: str = "text") -> DataFrame:
    """The documents not in ``category``, with all their columns; rows are filtered where they are."""
    sent, k, place = docs.sparkSession.sparkContext.broadcast(chain), chain.categories.index(category), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            yield batch.filter(pa.array([c.logits(t)[k] < c.thresholds[k] for t in text_bytes(batch.column(place))], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def label_categories() -> dict[str, F.Column]:
    """The chain over the ``labels`` table: low quality first, then toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
