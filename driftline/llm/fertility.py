"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback tokenises every word of a text. Three measures follow: characters per token, the
share of tokens that are single fallback bytes, and the entropy of the token distribution over the largest it could be.
Text in a language the vocabulary knows stays within a band per script; encodings gone wrong, markup, random strings and
endless repetition leave it. Beside them stand plain counts over words, symbols, lines and repeated word windows.

Defined cases: a null or wordless text has no words, every count 0 and null measures, and fails the base rules. Repeated
rows give repeated results. A text is handled whole whatever its length. Scripts without a band use ``other``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import record_batch, text_batches, texts
from driftline.llm.words import WordTokens, flattened, kept, words_of

# Bands per script as (least and most characters per token, most byte share, least entropy share).
BANDS = {
    "latin": (1.25, 12.0, 0.10, 0.45),
    "greek": (0.60, 8.0, 0.50, 0.40),
    "cyrillic": (0.90, 10.0, 0.25, 0.40),
    "arabic": (0.50, 8.0, 0.50, 0.40),
    "hebrew": (0.50, 8.0, 0.50, 0.40),
    "indic": (0.30, 8.0, 0.80, 0.30),
    "thai": (0.30, 8.0, 0.80, 0.30),
    "kana": (0.40, 6.0, 0.60, 0.35),
    "han": (0.30, 6.0, 0.80, 0.35),
    "hangul": (0.30, 6.0, 0.80, 0.35),
    "other": (0.20, 16.0, 1.00, 0.20),
}
# First code points of the ranges in which letters of a script lie; "" ends a range.
SCRIPT_RANGES = [
    (0x0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x250, "other"),
    (0x300, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
    (0x30000, ""),
]
SCRIPTS = [*BANDS, ""]
SYMBOLS = "#*$%&|<>"
WINDOW = 8

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("script", pa.string()), ("n_tokens", pa.int64()),
    ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("entropy_share", pa.float64())])


class _Measured(WordTokens):
    """Also keeps, per word, its characters, byte tokens and letters of each script."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.piece = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.piece.vocab_size())])
        self.first = np.array([a for a, _ in SCRIPT_RANGES])
        self.script = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])
        self.letters = np.zeros((0, len(SCRIPTS)), np.int32)
        super().__init__(lambda words: flattened(self.piece.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)))

    def forget(self, keep: int) -> None:
        super().forget(keep)
        self.letters = self.letters[:keep].copy()

    def learned(self, new: list[bytes]) -> None:
        points = [np.frombuffer(w.decode("utf-8", "replace").encode("utf-32-le"), "<u4") for w in new]
        at = self.script[np.searchsorted(self.first, np.concatenate(points), "right") - 1]
        word = np.repeat(np.arange(len(new)), [len(p) for p in points])
        n = len(SCRIPTS)
        self.letters = np.vstack([self.letters, np.bincount(word * n + at, minlength=len(new) * n).reshape(-1, n).astype(np.int32)])


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first occurrence included."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    ids = numbers  # double the width: pairs of equal ids get equal ids, so windows are compared exactly
    width = 1
    while width < window:
        key = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        if width == window // 2:
            break
        ids = np.unique(key, return_inverse=True)[1]
        width *= 2
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[back] > 1)
    if not len(hit):
        return 0
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def maybe_repeats(numbers: np.ndarray, window: int = WINDOW) -> bool:
    """False only if no window can occur twice: a cheap test by hash before the exact one."""
    n = len(numbers) - window + 1
    if n < 2:
        return False
    h = (numbers + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    total, factor = np.zeros(n, np.uint64), 1
    for k in range(window):
        total += h[k:k + n] * np.uint64(factor)
        factor = factor * 0xBF58476D1CE4E5B9 % (1 << 64)
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def _duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _measure(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(("fertility", zlib.crc32(model.value)), lambda: _Measured(model.value))
        for ids, bodies in text_batches(batches, "doc_id", "text"):
            rows = []
            split = [words_of(t) for t in bodies]
            for doc_id, text, words, numbers in zip(ids, bodies, split, known.numbered(split)):
                text = text or ""
                signs = sum(map(text.count, SYMBOLS))
                if not words:
                    rows.append((doc_id, 0, 0, signs, 0, 0, "", 0, None, None, None))
                    continue
                chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
                tokens = known.tokens(numbers)
                count = np.bincount(tokens)
                count = count[count > 0]
                n = len(tokens)
                entropy = float(np.log2(n) - (count * np.log2(count)).sum() / n) if n > 1 else 0.0
                # a vocabulary's useful range: beyond 1024 kinds of token a long text need not spread further
                share = entropy / np.log2(min(n, 1024)) if n > 1 else 1.0
                letters = known.letters[numbers].sum(axis=0)[:-1]
                script = SCRIPTS[int(letters.argmax())] if letters.any() else "other"
                repeats = repeated_words(numbers) if maybe_repeats(numbers) else 0
                rows.append((doc_id, len(words), chars, signs, _duplicate_lines(text), repeats, script, n,
                             chars / max(n, 1), float(known.is_byte[tokens].mean()) if n else 0.0, float(share)))
            yield record_batch(SCHEMA, list(map(list, zip(*rows))))
    return run


def fertility(docs: DataFrame, model_path: str, bands: dict = BANDS, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """One row per document: the counts, the measures, ``base_failed`` and ``kept``.

    One pass in which nothing is shuffled. The vocabulary file, half a megabyte, is read on the driver and broadcast.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    out = texts(docs, id_col, text_col).mapInArrow(_measure(model), "doc_id long, n_words long, word_chars long, n_symbols long, "
                                                   "n_dup_lines long, n_repeat_words long, script string, n_tokens long, "
                                                   "chars_per_token double, byte_share double, entropy_share double")
    within = F.lit(False)
    for script, (low, high, byte, least) in bands.items():
        within = within | ((F.col("script") == script) & F.col("chars_per_token").between(low, high)
                           & (F.col("byte_share") <= byte) & (F.col("entropy_share") >= least))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))
