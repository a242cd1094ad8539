"""Words of a text and the tokens public vocabularies give them, remembered per distinct word inside a task.

A corpus repeats its words, so a task tokenises each distinct one once and looks the rest up. When the memory holds
``limit`` words, all but the first ``KEEP`` are forgotten, since frequent words are met early: that bounds a worker's memory
and never changes a result.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property
from itertools import islice

import numpy as np

from driftline.llm.common import tidy

WORD_LIMIT = 450_000
KEEP = 200_000


_KEPT: dict = {}


def kept(key, make):
    """One object per worker process, so that its tasks share what they learned; another key takes its place."""
    if key not in _KEPT:
        _KEPT.clear()
        tidy()
        _KEPT[key] = make()
    return _KEPT[key]


class _Numbers(dict):
    """Numbers words in the order they are met."""

    def __missing__(self, word):
        n = len(self)
        self[word] = n
        return n


class WordTokens:
    """Token ids of words. ``number`` the words of some texts, ``learn`` the new ones together, then gather ``tokens``.

    ``ids_of`` maps a list of words to all their ids in one array and how many each has.
    """

    def __init__(self, ids_of, limit: int = WORD_LIMIT):
        self.ids_of, self.limit = ids_of, limit
        self.known = _Numbers()
        self.ends = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def forget(self, keep: int) -> None:
        self.known = _Numbers(islice(self.known.items(), keep))
        self.ends = self.ends[:keep + 1].copy()
        self.flat = self.flat[:self.ends[-1]].copy()

    def number(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def numbered(self, texts_words: list[list]) -> list[np.ndarray]:
        """The words of some texts as numbers, all of them learned."""
        if len(self.known) > self.limit:
            self.forget(min(KEEP, self.limit // 2))
        out = [self.number(words) for words in texts_words]
        base = len(self.ends) - 1
        if len(self.known) > base:
            new = list(islice(self.known, base, None))
            flat, lengths = self.ids_of(new)
            self.flat = np.concatenate([self.flat, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            self.learned(new)
        return out

    def learned(self, new: list) -> None:
        """For measures kept per word."""

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        first = self.ends[numbers]
        count = self.ends[numbers + 1] - first
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)
        return self.flat[at]


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths


# Lower-case text of Latin letters, digits, ASCII signs and common dashes and quotes: there the vocabulary's own rule for
# pre-tokens needs no Unicode tables.
_PLAIN = re.compile(r"[\t-\r -~\xdf-\xf6\xf8-\xff‐-‧]*")
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-/:-@\[-`{-~‐-‧]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as its Latin-1 letter where that is printable, the others as letters from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class WordEndBpe:
    """A word-end BPE vocabulary that drops white space and case, in two steps: ``split`` and ``ids_of``.

    Its pre-tokens never cross white space and each is merged alone. A plain text is cut into pre-tokens here; of other texts,
    every word that is not plain stays whole for the tokenizer.
    """

    def __init__(self, json_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
        from tokenizers import Tokenizer
        self.json_text = json_text
        parts = json.loads(json_text)
        vocabulary = parts["model"]["vocab"]
        size = max([*vocabulary.values(), *(t["id"] for t in parts["added_tokens"])]) + 1
        self.is_end = np.zeros(size, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # plain pre-tokens, cut and lower-cased here, go to the same vocabulary and merges without the text front end
        self.merges = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))

    @cached_property
    def tokenizer(self):
        """The whole tokenizer, made when a word is met that is not plain."""
        from tokenizers import Tokenizer
        return Tokenizer.from_str(self.json_text)

    def split(self, text: str | None) -> list[str]:
        low = (text or "").lower()
        if _PLAIN.fullmatch(low) and "<|" not in low:
            return _PRE.findall(low)
        out: list[str] = []
        for word in words_of(text):
            word = word.decode("utf-8", "surrogatepass")
            low = word.lower()
            out += _PRE.findall(low) if _PLAIN.fullmatch(low) and "<|" not in low else [word]
        return out

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([_PLAIN.fullmatch(w) is not None and "<|" not in w and w.lower() == w for w in words])
        lengths = np.zeros(len(words), np.int64)
        together = [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS) for w, p in zip(words, plain) if p]
        joined = np.array(self.merges.encode(together, is_pretokenized=True, add_special_tokens=False).ids if together else [], np.uint32)
        ends = np.flatnonzero(self.is_end[joined]) + 1  # each pre-token closes with a word end
        assert len(ends) == len(together)
        lengths[plain] = np.diff(np.append(0, ends))
        others = [w for w, p in zip(words, plain) if not p]
        alone, apart = flattened([e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)] if others else [])
        lengths[~plain] = apart
        flat = np.empty(int(lengths.sum()), np.uint32)
        is_plain = np.repeat(plain, lengths)
        flat[is_plain], flat[~is_plain] = joined, alone
        return flat, lengths


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (bytes.split() cuts at exactly these six)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
