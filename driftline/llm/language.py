"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one space, and runs of 1 to 3 characters are hashed into a fixed
table. Document frequencies cover all training documents. The weights are learned by follow-the-regularised-leader
with an elastic net (L1 for sparsity, L2 for size) from a bounded sample: at most ``rows_per_label`` distinct texts a
label and about ``sample_chars`` characters in all, chosen by a hash of the text. A fifth of the sample is kept from training and sets the temperature that
calibrates the probabilities.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text if nothing could be learned.
Ties between labels go to the smaller label. Rows with a null label or text train nothing. Repeated texts train once.
A text is handled whole, in blocks, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import record_batch, small_batches, text_batches, tidy
from driftline.llm.words import kept

BITS = 16
BLOCK = 1 << 20
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def letters_only(text) -> "F.Column":
    """Lower case, runs of anything but letters as one space, with a space at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and how often each occurs."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    total = np.zeros(1 << BITS, np.int64)
    shift = np.uint64(64 - BITS)
    for a in range(0, len(c), BLOCK):
        x = c[a:a + BLOCK + 2].astype(np.uint64) + np.uint64(1)
        new = min(BLOCK, len(c) - a)  # grams that begin here; the overlap only completes them
        one = x * _MIX[0]
        two = one[:-1] + x[1:] * _MIX[1]
        two ^= two >> np.uint64(31)
        three = two[:-1] + x[2:] * _MIX[2]
        three ^= three >> np.uint64(29)
        for h in (one[:new], two[:new], three[:new]):
            total += np.bincount(((h * _MIX[2]) >> shift).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(n)) * idf[at]
    norm = np.sqrt((v * v).sum())
    return v / norm if norm > 0 else v


@dataclass(frozen=True)
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, letters: str) -> tuple[str, float]:
        at, n = gram_counts(letters)
        p = softmax(weigh(at, n, self.idf) @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """How many training documents hold each hashed n-gram, over all of them: each task adds up its own table first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("language", object)  # what earlier steps remembered goes
        total, docs = np.zeros(1 << BITS, np.int64), 0
        for (bodies,) in text_batches(batches, "letters"):
            for t in bodies:
                total[gram_counts(t)[0]] += 1
            docs += len(bodies)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))], names=["gram", "n"])
    rows = (train.select("letters").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas())
    table = np.zeros(1 << BITS)
    real = rows[rows.gram >= 0]
    table[real.gram.to_numpy()] = real.n.to_numpy()
    return table, int(rows.n[rows.gram < 0].sum())


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, alpha: float = 0.5, beta: float = 1.0,
               l1: float = 0.02, l2: float = 0.05, epochs: int = 4) -> np.ndarray:
    """FTRL-proximal over (class, features, values) rows; weights come out sparse."""
    z, s = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))

    def weights(at):
        zi, si = z[at], s[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(si)) / alpha + l2))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            label, at, v = rows[i]
            w = weights(at)
            p = softmax(v @ w)
            p[label] -= 1.0
            g = v[:, None] * p
            new = s[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(s[at])) / alpha * w
            s[at] = new
    return weights(np.arange(1 << BITS))


def calibrate(logits: list[np.ndarray], labels: list[int]) -> float:
    """The temperature with the least cross-entropy, by golden-section search on its logarithm.

    The targets are smoothed by one pseudo-count, as in Platt scaling: otherwise a sample without errors would call for
    certainty.
    """
    if not logits or len(logits[0]) < 2:
        return 1.0
    z, y = np.array(logits), np.array(labels)
    target = np.full(z.shape, 1.0 / (len(y) + 2) / (z.shape[1] - 1))
    target[np.arange(len(y)), y] = (len(y) + 1) / (len(y) + 2)

    def loss(t):
        q = z / np.exp(t)
        q = q - q.max(axis=1, keepdims=True)
        return float((np.log(np.exp(q).sum(axis=1)) - (target * q).sum(axis=1)).mean())
    a, b, ratio = np.log(0.02), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(train: DataFrame, rows_per_label: int = 1000, max_labels: int = 256, sample_chars: int = 40_000_000) -> LanguageModel:
    """Learn from ``train`` (columns text, lang). At most ``max_labels`` labels, the most frequent, can be learned.

    Where labels are many or texts long, fewer rows of each label are taken, so that the sample has about
    ``sample_chars`` characters: that bounds the one task that trains.
    """
    small_batches(train.sparkSession)
    train = train.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = train.withColumn("h", F.xxhash64("text"))
    found = (hashed.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("copies"), F.first(F.length("text")).alias("length"))
             .groupBy("lang").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("texts"), F.avg("length").alias("chars"))
             .orderBy(F.desc("n"), "lang").limit(max_labels).collect())
    counts = {r.lang: r.texts for r in found}
    labels = sorted(counts)
    if not labels:
        return LanguageModel([], np.zeros(1 << BITS), np.zeros((1 << BITS, 0)), 1.0)
    df, docs = document_frequencies(train.select(letters_only(F.col("text")).alias("letters")))
    idf = np.log((1.0 + docs) / (1.0 + df)) + 1.0
    rows_per_label = max(10, min(rows_per_label, int(sample_chars / sum(r.chars for r in found))))
    # shares are of distinct texts, as copies share a hash; twice the share leaves enough, and learn keeps the bound exactly
    share = F.create_map(*[x for k in labels for x in (F.lit(k), F.lit(min(1.0, 2.0 * rows_per_label / counts[k])))])
    picked = (hashed.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
              .dropDuplicates(["lang", "h"]).select("lang", "h", letters_only(F.col("text")).alias("letters")))

    def features(batches):
        for batch in batches:
            rows = [(lang, h, *gram_counts(t)) for lang, h, t in zip(*[batch.column(c).to_pylist() for c in ("lang", "h", "letters")])]
            for a in range(0, len(rows), 256):
                part = rows[a:a + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array([r[2].astype(np.int32) for r in part], pa.list_(pa.int32())),
                     pa.array([r[3].astype(np.int32) for r in part], pa.list_(pa.int32()))], names=["lang", "h", "at", "n"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="all").sort_values(["h", "lang"]).groupby("lang", sort=True).head(rows_per_label).reset_index(drop=True)
        rows = [(labels.index(lang), np.asarray(at), weigh(np.asarray(at), np.asarray(n), idf)) for lang, at, n in zip(pdf["lang"], pdf["at"], pdf["n"])]
        held = [i for i in range(len(rows)) if i % 5 == 4]
        w = train_ftrl([r for i, r in enumerate(rows) if i % 5 != 4], len(labels))
        t = calibrate([rows[i][2] @ w[rows[i][1]] for i in held], [rows[i][0] for i in held])
        f, k = np.nonzero(w)
        tidy()
        return pd.DataFrame({"f": np.append(f, -1), "k": np.append(k, 0), "w": np.append(w[f, k], t)})

    # one group on purpose: the sample is bounded by rows_per_label and max_labels, and FTRL takes its rows in turn
    rows = (picked.mapInArrow(features, "lang string, h long, at array<int>, n array<int>")
            .withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "f long, k long, w double").toPandas())
    weights = np.zeros((1 << BITS, len(labels)))
    real = rows[rows.f >= 0]
    weights[real.f.to_numpy(), real.k.to_numpy()] = real.w.to_numpy()
    return LanguageModel(labels, idf, weights, float(rows.w[rows.f < 0].iloc[0]))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every document. One pass, no shuffle. Only the text decides."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    learned = bool(model.labels)
    text = F.col(text_col).cast("string")
    has = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)) & F.lit(learned)
    work = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(has, letters_only(text)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for ids, bodies in text_batches(batches, "doc_id", "letters"):
            found = [("und", 0.0) if t is None else m.predict(t) for t in bodies]
            yield record_batch(SCHEMA, [ids, [f[0] for f in found], [f[1] for f in found]])
    return work.mapInArrow(run, "doc_id long, lang_pred string, score double")


def speaks(docs: DataFrame, model: LanguageModel, min_score: float, text_col: str = "text") -> DataFrame:
    """``docs`` whose text has a predicted language with at least ``min_score``; every column stays as it is."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col(text_col).cast("string")

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for letters in columns:
            yield letters.map(lambda t: m.predict(t)[1] if m.labels else 0.0, na_action="ignore")
        tidy()
    return docs.where(F.coalesce(text.rlike(r"\p{L}"), F.lit(False))).where(score(letters_only(text)) >= min_score)
