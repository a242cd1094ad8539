"""Secret scans: three fixed patterns and two character Markov models.

Each model is an order-1 chain over the characters secrets are written in: one of random strings, one of ordinary words
and identifiers. A long mixed run of such characters is a secret when the log-likelihood ratio of the two chains, per
character, exceeds a threshold. Both chains are trained from labelled samples: random strings are the values the fixed
patterns find in a bounded sample of documents, with seeded draws over common alphabets so that a corpus without secrets
still trains; ordinary strings are words of the sampled texts, none of them out of a long mixed run, and identifiers joined from
them. The threshold is a high quantile of held-out ordinary strings plus a margin, but no more than what 99 of 100
held-out draws exceed: a few odd strings among the words cannot lift it out of reach.

Defined cases: a null text is empty and has no spans; repeated rows give repeated results; a text is scanned whole;
ties in start are ordered by kind as listed. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import record_batch, small_batches, text_batches, texts, tidy
from driftline.llm.words import kept

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "markov"]
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
WORD = re.compile(r"[A-Za-z]{3,24}")
_INDEX = np.full(128, -1)
_INDEX[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


@dataclass(frozen=True)
class MarkovPair:
    """Log-probabilities of the two chains, first row: of the first character."""

    ratio: np.ndarray
    threshold: float

    def score(self, s: str) -> float:
        """Log-likelihood ratio per character, random against ordinary."""
        at = _INDEX[np.frombuffer(s.encode("ascii"), np.uint8)]
        before = np.concatenate([[0], at[:-1] + 1])
        return float(self.ratio[before, at].mean())

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        out = []
        for m in CANDIDATE.finditer(text):
            s = m.group()
            if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and self.score(s) > self.threshold:
                out.append((m.start(), 3, m.end()))
        return out


def chain(strings: list[str], smoothing: float = 0.5) -> np.ndarray:
    n = len(ALPHABET)
    count = np.full((n + 1, n), smoothing)
    for s in strings:
        at = _INDEX[np.frombuffer(s.encode("ascii"), np.uint8)]
        np.add.at(count, (np.concatenate([[0], at[:-1] + 1]), at), 1)
    return np.log(count / count.sum(axis=1, keepdims=True))


def fit(random_strings: list[str], ordinary: list[str], margin: float = 0.25) -> MarkovPair:
    """Train both chains; every fifth ordinary string and every fifth draw is held out for the threshold."""
    rng = random.Random(20)
    drawn = []
    for alphabet, length in (("0123456789abcdef", 32), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32), (ALPHABET[:62], 40), (ALPHABET[:64], 44)):
        drawn += ["".join(rng.choices(alphabet, k=length)) for _ in range(400)]
    joined = []
    for i in range(0, len(ordinary) - 2, 3):
        a, b, c = ordinary[i:i + 3]
        joined += ["_".join((a, b, c)).lower(), "-".join((a, b)).lower(), a.lower() + b.title() + c.title(), f"{a}{b}_{i % 100}".lower(),
                   f"{a}/{b}/{c}".lower(), f"{a}_{b}_{1990 + i % 40}".upper()]
    plain = ordinary + joined
    held = plain[::5]
    kept = [s for i, s in enumerate(plain) if i % 5]
    pair = MarkovPair(chain([*random_strings, *[s for i, s in enumerate(drawn) if i % 5]]) - chain(kept), 0.0)
    scores = [pair.score(s) for s in held if len(s) >= 20]
    high = float(np.quantile(scores, 0.999)) if scores else 0.0
    reached = float(np.quantile([pair.score(s) for s in drawn[::5]], 0.01))
    return MarkovPair(pair.ratio, max(0.0, min(max(0.0, high) + margin, reached)))


def labelled_sample(docs: DataFrame, most_docs: int = 4000, most_strings: int = 20_000) -> tuple[list[str], list[str]]:
    """Random strings (values of base spans) and ordinary words of about ``most_docs`` documents chosen by hash, at most
    ``most_strings`` of each: the bound of what training sees."""
    body = texts(docs).where(F.col("text").isNotNull())
    n = body.count()
    share = min(1.0, most_docs / max(n, 1))
    chosen = body.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("secrets", object)
        for (bodies,) in text_batches(batches, "text"):
            hard, plain = [], set()
            for t in bodies:
                spans = base_spans(t)
                for start, kind, end in spans:
                    value = ASSIGN.match(t, start).group(2) if kind == 0 else t[start:end]
                    hard.append(value.replace(".", ""))
                covered = {i for s, _, e in spans for i in range(s, e)}
                covered.update(i for m in CANDIDATE.finditer(t) for i in range(*m.span()))
                plain.update(m.group() for m in WORD.finditer(t) if m.start() not in covered)
            rows = [(True, s) for s in sorted({h for h in hard if len(h) >= 12})] + [(False, s) for s in sorted(plain)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.string())],
                                                 names=["random", "s"])

    found = chosen.select("text").mapInArrow(strings, "random boolean, s string").distinct()
    pick = lambda kind: [r.s for r in found.where(F.col("random") == kind).orderBy(F.xxhash64("s"), "s").limit(most_strings).collect()]
    return pick(True), pick(False)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                    ("n_markov", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def secrets(docs: DataFrame, model: MarkovPair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with counts and spans. One pass, no shuffle; the model is a matrix of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("secrets", object)  # what earlier steps remembered goes
        for ids, bodies in text_batches(batches, "doc_id", "text"):
            rows = []
            for doc_id, text in zip(ids, bodies):
                text = text or ""
                base = base_spans(text)
                more = model.spans(text)
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                rows.append((doc_id, *n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            if rows:
                yield record_batch(SCHEMA, list(map(list, zip(*rows))))
    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(text: str, model: MarkovPair, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in sorted(base_spans(text) + model.spans(text)):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: MarkovPair, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text_col`` replaced; a null text stays null, every other column as it is."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept("secrets", object)
        for col in columns:
            yield col.map(lambda t: redact(t, model), na_action="ignore")
        tidy()
    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
