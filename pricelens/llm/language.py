"""Language identification by nearest centroids.

A text becomes a normalised TF-IDF vector of its character n-grams (one to three
characters; lower case, runs of other characters are one space), counted in a
fixed number of hash buckets.  Every language has several centroids, clustered
by cosine, and a text gets the language of the nearest one.  A text that is
farther from it than the language's own texts are is rejected: ``language`` is
then null, ``nearest`` still names the closest.

Document frequencies are counted over all training documents, in one pass.  The
centroids are fitted on a bounded sample, at most about ``SAMPLE_ROWS`` labelled
documents in equal shares for each language.  Prediction is one pass over all
whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import text_bytes
from pricelens.session import checkpoint

BUCKETS = 1 << 14
SIZES = (1, 2, 3)
CENTROIDS = 4
# Expected number of labelled documents that the centroids are fitted on.
SAMPLE_ROWS = 4000
ROUNDS = 10
# Share of a language's own sample that its distance bound leaves out, and how much farther is still accepted.
REJECTED_SHARE = 0.01
SLACK = 1.1
SEED = 13
UNKNOWN = "und"
# Characters whose n-grams are counted at a time.
BLOCK_CHARS = 1 << 18

_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_OF_SIZE = {n: np.uint32(n * 0x9E3779B1 % (1 << 32)) for n in SIZES}


def letters(text: str) -> np.ndarray:
    """Code points of the lower-case text, runs of anything but letters as one zero, a zero at both ends; empty without letters."""
    plain = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower().translate(_ASCII)
    plain = " ".join(plain.split())
    if not plain:
        return np.empty(0, np.uint32)
    code = np.frombuffer(f" {plain} ".encode("utf-32-le"), np.uint32).copy()
    code[code == 32] = 0
    return code


_ASCII = "".join(chr(c) if chr(c).isalpha() else " " for c in range(128))


def term_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (ascending) of the n-grams of a text, and how often each occurs."""
    code = letters((text or b"").decode("utf-8", "replace"))
    count = np.zeros(BUCKETS if len(code) else 0, np.int64)
    for a in range(0, len(code), BLOCK_CHARS):
        part = code[a:a + BLOCK_CHARS + max(SIZES) - 1]
        here = min(BLOCK_CHARS, len(code) - a)
        for n in SIZES:
            gram = np.zeros(max(0, min(here, len(part) - n + 1)), np.uint32)
            for k in range(n):
                gram = (gram ^ part[k:k + len(gram)]) * _MIX[k]
                gram ^= gram >> np.uint32(15)
            if n == 1:
                gram = gram[part[:len(gram)] > 0]
            count += np.bincount((gram + _OF_SIZE[n]) >> np.uint32(18), minlength=BUCKETS)
    term = np.flatnonzero(count)
    return term, count[term]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray             # per bucket
    centroids: np.ndarray       # buckets x centroids, unit length
    owner: np.ndarray           # the language of each centroid
    least: np.ndarray           # per language: a lower cosine is rejected

    def vector(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        term, times = term_counts(text)
        return weighted(term, times, self.idf)

    def nearest(self, text: bytes | None) -> tuple[str | None, str, float]:
        """(language or null, nearest language, cosine); a text without letters is unknown."""
        term, x = self.vector(text)
        if not len(term) or not self.languages:
            return None, UNKNOWN, 0.0
        cosine = x @ self.centroids[term]
        k = int(cosine.argmax())
        language, score = int(self.owner[k]), float(min(1.0, max(0.0, cosine[k])))
        return self.languages[language] if score >= self.least[language] else None, self.languages[language], score


def weighted(term: np.ndarray, times: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = ((1 + np.log(times)) * idf[term]).astype(np.float32) if len(term) else np.empty(0, np.float32)
    return term, x / max(1e-12, float(np.sqrt(x @ x)))


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means of unit rows; starts at the mean's nearest row and then at the farthest ones."""
    mean = x.mean(axis=0)
    seeds = [int((x @ mean).argmax())]
    cosine = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        far = int(cosine.argmin())
        if cosine[far] > 1 - 1e-6:
            break
        seeds.append(far)
        cosine = np.maximum(cosine, x @ x[far])
    centroids = x[seeds]
    own = None
    for _ in range(rounds):
        now = (x @ centroids.T).argmax(axis=1)
        if own is not None and (now == own).all():
            break
        own = now
        centroids = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids /= np.maximum(1e-12, np.linalg.norm(centroids, axis=1, keepdims=True))
    return centroids


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn the languages that ``lang_col`` names; rows without a language, a text or a letter teach nothing.

    Without such rows the model knows no language and everything is unknown.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts = np.zeros(BUCKETS, np.int64), {}
        for batch in batches:
            for text, lang in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                term, _ = term_counts(text)
                if len(term):
                    found[term] += 1
                    texts[lang] = texts.get(lang, 0) + 1
        term = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(term), pa.string()), pa.array(term), pa.array(found[term])], names=["lang", "term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.string()), pa.nulls(len(texts), pa.int64()), pa.array(list(texts.values()), pa.int64())],
                                         names=["lang", "term", "n"])
    counts = checkpoint(rows.mapInArrow(frequencies, "lang string, term long, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")))
    times = counts.filter("lang IS NOT NULL").select("lang", "n")
    known = counts.filter("term IS NOT NULL").select("term", "n").toArrow()
    total = times.agg(F.sum("n"), F.count("*")).first()
    if not total[0]:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0), np.float32), np.empty(0, np.int64), np.empty(0))
    idf = np.full(BUCKETS, np.log(1 + total[0]) + 1)
    idf[known.column("term").to_numpy()] = np.log((1 + total[0]) / (1 + known.column("n").to_numpy())) + 1

    # equal expected shares; which rows are drawn depends on the text alone
    share = sample_rows / total[1]
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "text"), F.lit(1 << 40)) < F.least(F.lit(1.0), F.lit(share) / F.col("n")) * F.lit(float(1 << 40))
    sent = spark.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [weighted(*term_counts(t), sent.value) for t in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([t for t, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32()))],
                                             names=["lang", "term", "x"])
    # one row a language
    picked = rows.join(F.broadcast(times), "lang").filter(drawn).select("text", "lang")
    table = checkpoint(picked.mapInArrow(vectors, "lang string, term array<int>, x array<float>").filter("size(term) > 0")).orderBy("lang", "term", "x")
    names, blocks, owner, least = [], [], [], []
    for r in times.orderBy("lang").collect():
        sample = table.filter(F.col("lang") == r.lang).toArrow()
        if not sample.num_rows:     # none of a rare language's few texts was drawn
            continue
        x = np.zeros((sample.num_rows, BUCKETS), np.float32)
        for i, (term, values) in enumerate(zip(sample.column("term"), sample.column("x"))):
            x[i, term.values.to_numpy()] = values.values.to_numpy()
        found = cluster(x, centroids)
        own = (x @ found.T).max(axis=1)
        least.append(1 - SLACK * (1 - np.quantile(own, REJECTED_SHARE)))
        blocks.append(found)
        owner += [len(names)] * len(found)
        names.append(r.lang)
    return Model(names, idf, np.ascontiguousarray(np.concatenate(blocks).T), np.array(owner), np.array(least))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``language`` (null if rejected), ``nearest`` and ``score`` (its cosine) for each input row.

    A null text and one without a letter are ``und`` with score 0 and no
    language.  Long texts are counted in blocks and never cut; ties go to the
    language that comes first.  Null ids and repeated rows are kept, an empty
    table gives an empty result, other columns are ignored whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.nearest(t) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*found) if found else ([], [], []), (pa.string(), pa.string(), pa.float64())))],
                                             names=["doc_id", "language", "nearest", "score"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, language string, nearest string, score double")


HELD_OUT = 2


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a document is kept from training; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def language_digest(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and names the language of all."""
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), F.col("nearest").alias("lang_pred"), "score",
                                        F.col("language").isNull().alias("rejected"))
