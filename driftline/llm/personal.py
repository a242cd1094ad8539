"""Personal data: four fixed patterns, and a semi-Markov conditional random field for other notations of the same things.

The field segments a text into outside tokens and entities of a type, an entity having at most ``LONGEST`` tokens. A segment is
scored by features of the whole span: its shape, digits, groups, separators, checksum, whether four groups make an address,
what stands beside it. Training maximises the likelihood of whole segmentations (forward and backward sums over all
segmentations); decoding is the dynamic program over the best segmentation, which chooses boundaries and types together.

A segment can be an entity only if it holds one at-mark, or seven digits or a defanged dot and between its digits at most
five signs (``SIGNS``) in a row; outside tokens score 0. So the best
segmentation of a text is that of its islands, the stretches where such segments lie, and the words between are never
looked at: exact, and one fast pass over ordinary text. Memory follows the longest island, one entry a token.

Training data (documented bounds): entities that the fixed patterns find in about 4000 documents chosen by hash, at most
``most`` of a kind, with seeded draws beside them, rewritten in notations that the patterns miss, in the contexts of the corpus;
and seeded numbers that are none (dates, amounts, book and order numbers, card-like digits that fail their checksum).

Spans of the field that touch a span of a pattern are left out: patterns stay as they are.

Defined cases: a null text is empty and has no spans; repeated rows give repeated results; texts are scanned whole; spans are
in code points, end exclusive. An empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import text_batches, texts
from driftline.llm.words import kept

KINDS = ["email", "ip", "card", "phone"]
FOUND = ["crf-email", "crf-ip", "crf-card", "crf-phone"]

# The base patterns, with possessive repeats where what follows excludes the repeated characters.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

LONGEST = 24
SIGNS, WIDEST = frozenset(" ().-/[]{}"), 5  # between the digits of an entity without an at-mark
MARK = r"\[at\]|\(at\)|\{at\}|@"
DEFANGED_TOKENS = {"[.]", "(.)", "{.}"}
DEFANGED = re.compile(r"\[\.\]|\(\.\)|\{\.\}")
TOKEN = re.compile(r"\[(?:at|dot|\.)\]|\((?:at|dot|\.)\)|\{(?:at|dot|\.)\}|[A-Za-z]+|[0-9]+|\s+|.", re.S)
NUMBER = re.compile(r"[+(]?[0-9](?:[ ().\-/\[\]{}]{0,5}+[0-9])++")
AT = re.compile(MARK + r"|\sat\s(?=[A-Za-z0-9-]{1,63}\sdot\s)")
AT_TOKENS, DOT_TOKENS = {"[at]", "(at)", "{at}", "@"}, {"[dot]", "(dot)", "{dot}", "[.]", "(.)", "{.}", "."}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern; each at-sign is looked at once, so long runs cost no more than their length."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(out)


@dataclass
class Island:
    """Tokens of a stretch of text: where each begins (and the last ends), and the segments that may be entities."""

    begins: list[int]
    segments: list[tuple[int, int]]  # token numbers, end exclusive
    features: list[list[str]]


def stretches(text: str) -> list[tuple[int, int]]:
    """Where segments that can be entities lie, with the tokens around that they may hold."""
    spans = []
    for m in NUMBER.finditer(text):
        s = m.group()
        if len(s) >= 7 and (len(digits_of(s)) >= 7 or DEFANGED.search(s)):
            spans.append((m.start(), m.end()))
    for m in AT.finditer(text):
        a, b = m.span()
        for _ in range(LONGEST):  # a token before, a token after
            if a > 0:
                a -= 1
                same = str.isalnum if text[a].isalnum() else str.isspace if text[a].isspace() else None
                while same and a > 0 and b - a < 20 * LONGEST and same(text[a - 1]):
                    a -= 1
        for _ in range(LONGEST):
            t = TOKEN.match(text, b)
            if t and t.end() - m.end() < 20 * LONGEST:
                b = t.end()
        spans.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Tokens:
    """The tokens of a stretch of text, and the segments that may be entities."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.begins, self.words = text, [], []
        for m in TOKEN.finditer(text, start, end):
            self.begins.append(m.start())
            self.words.append(m.group())
        self.begins.append(end)
        self.kind = ["0" if w.isdecimal() and w.isascii() else "a" if w.isalpha() and w.isascii() else " " if w.isspace() else w for w in self.words]

    def segments(self, i: int) -> Iterator[tuple[int, list[str]]]:
        """(end, features) of the segments that begin at token ``i``: without an at-mark an entity holds digits and signs only,
        none holds two marks, and none crosses a line."""
        words, kind = self.words, self.kind
        if kind[i] not in ("0", "a", "+", "("):
            return
        count, marks, gap, other, defanged, digits = 0, 0, 0, kind[i] == "a", False, []
        for j in range(i, min(len(words), i + LONGEST)):
            word = words[j]
            if "\n" in word:
                return
            mark = word in AT_TOKENS or word == "at" and i < j and kind[j - 1] == " "
            marks += mark
            if marks > 1:
                return
            if kind[j] == "0":
                digits.append(word)
                count += len(word)
                other = other or gap > WIDEST
                gap = 0
                if count > 40:
                    return
            else:
                gap += len(word)
                other = other or j > i and not SIGNS.issuperset(word)
            defanged = defanged or word in DEFANGED_TOKENS
            if kind[j] in ("0", "a") and not mark and (marks or not other and (count >= 7 or defanged)):
                yield j + 1, features(self.text, words[i:j + 1], kind[i:j + 1], digits, marks, self.begins[i], self.begins[j + 1])


def island(text: str, start: int, end: int) -> Island:
    tokens = Tokens(text, start, end)
    made = Island(tokens.begins, [], [])
    for i in range(len(tokens.words)):
        for j, names in tokens.segments(i):
            made.segments.append((i, j))
            made.features.append(names)
    return made


def features(text: str, words: list[str], kind: list[str], digits: list[str], marks: int, a: int, b: int) -> list[str]:
    """Features of the span ``text[a:b]`` as a whole."""
    number = "".join(digits)
    n, groups = len(number), len(digits)
    letters = sum(k == "a" for k in kind)
    seps = "".join(sorted({w for k, w in zip(kind, words) if k not in ("0", "a")}))
    out = ["any", f"letters {min(letters, 2)} mark {marks}"]
    before, after = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    side = lambda c: "word" if c.isalnum() else "space" if c.isspace() else "dot" if c in ".," else "sign" if c in "+-/@_()[]" else "other"
    out += [f"before {side(before)} mark {marks}", f"after {side(after)} mark {marks}"]
    if before in ".-/[(" and text[a - 2:a - 1].isdigit():
        out.append("cuts a number")
    if after in ".-/])" and text[b + 1:b + 2].isdigit():
        out.append("cuts a number")
    if marks:
        at = next(i for i, w in enumerate(words) if w in AT_TOKENS or w == "at" and i)
        local, domain = words[:at], words[at + 1:]
        dots = sum(w in DOT_TOKENS or w == "dot" for w in domain)
        out += [f"dots {min(dots, 3)}", f"mark {words[at]}", f"last {kind[-1]} {min(len(words[-1]), 7)}"]
        out.append(f"spaces before {min(sum(k == ' ' for k in local), 3)}")
        # between labels of a domain only dots, written out or not, with spaces around them
        plain = re.fullmatch(r"\s?[A-Za-z0-9-]+(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\[\.\]|\sdot\s|\.)\s?[A-Za-z0-9-]+)+", "".join(domain).replace(" dot ", " \u0000 ").replace("\u0000", "dot"))
        spaced = re.fullmatch(r"\s?[A-Za-z0-9-]+(?:\sdot\s[A-Za-z0-9-]+)+", "".join(domain))
        out.append("domain" if plain or spaced else "no domain")
        out.append("local" if re.fullmatch(r"[A-Za-z0-9._%+-]+\s?", "".join(local)) else "no local")
        if before in LOCAL and before != "-":
            out.append("cuts a local part")
        if re.match(r"(?:\s?(?:\[dot\]|\(dot\)|\{dot\})|\sdot\s|\.)\s?[A-Za-z0-9]|[A-Za-z0-9-]", text[b:b + 12]):
            out.append("cuts a domain")
        return out
    shape = "".join(str(min(len(w), 9)) if k == "0" else w if k != "a" else "a" for k, w in zip(kind, words))
    out += [f"shape {shape[:40]}", f"digits {min(n, 20)}", f"groups {min(groups, 6)}", f"signs {seps[:8]}", f"digits {min(n, 20)} groups {min(groups, 6)}"]
    if words[0] in "+(":
        out.append(f"first {words[0]}")
    if ("(" in words) != (")" in words):
        out.append("one bracket")
    if 12 <= n <= 19:
        out.append(f"checksum {luhn(number)} letters {letters > 0}")
        if luhn(number) and groups == 4 and len({len(d) for d in digits}) == 1 and not letters:
            out.append("four equal groups with checksum")
    if groups == 4 and not letters and all(len(d) <= 3 and int(d) <= 255 for d in digits):
        between = "".join("," if k == "0" else w for k, w in zip(kind, words)).split(",")[1:-1]
        if all("." in x for x in between):
            out.append("four bytes")
    return out


class Field:
    """Weights per feature and type; entities score the sum of their weights, outside tokens 0."""

    def __init__(self, index: dict[str, int], weights: np.ndarray):
        self.index, self.weights = index, weights

    def scores(self, made: Island) -> np.ndarray:
        """Segments by types."""
        out = np.empty((len(made.segments), len(KINDS)))
        for i, names in enumerate(made.features):
            out[i] = self.weights[[self.index[f] for f in names if f in self.index]].sum(axis=0)
        return out

    def decode(self, tokens: Tokens) -> list[tuple[int, int, int]]:
        """(start, type, end) of the best segmentation; ties go to fewer entities, then to the one that begins first. Segments
        are scored as they come up, so only an entry a token is held."""
        n = len(tokens.words)
        best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        for i in range(n + 1):
            if i and best[i - 1] >= best[i]:
                best[i], back[i] = best[i - 1], None
            if i < n:
                for j, names in tokens.segments(i):
                    known = [self.index[f] for f in names if f in self.index]
                    score = self.weights[known].sum(axis=0)
                    kind = int(score.argmax())
                    if best[i] + score[kind] > best[j]:
                        best[j], back[j] = best[i] + float(score[kind]), (i, kind)
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((tokens.begins[i], kind, tokens.begins[j]))
                j = i
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        out = []
        for a, b in stretches(text):
            out += self.decode(Tokens(text, a, b))
        return out


def likelihood(made: Island, scores: np.ndarray, gold: list[tuple[int, int]]) -> tuple[float, np.ndarray]:
    """Log-likelihood of the gold segments (segment number, type) and the chance of each segment and type."""
    n = len(made.begins) - 1
    begin = np.array([i for i, _ in made.segments], int)
    end = np.array([j for _, j in made.segments], int)
    whole = np.logaddexp.reduce(scores, axis=1)
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    ending = [np.flatnonzero(end == j) for j in range(n + 1)]
    starting = [np.flatnonzero(begin == i) for i in range(n + 1)]
    for j in range(1, n + 1):
        s = ending[j]
        ahead[j] = np.logaddexp.reduce(np.append(ahead[begin[s]] + whole[s], ahead[j - 1]))
    for i in range(n - 1, -1, -1):
        s = starting[i]
        behind[i] = np.logaddexp.reduce(np.append(behind[end[s]] + whole[s], behind[i + 1]))
    chance = np.exp(ahead[begin][:, None] + scores + behind[end][:, None] - ahead[n])
    return sum(scores[s, k] for s, k in gold) - ahead[n], chance


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Maximise the likelihood of the examples (text, its (start, type, end)) by adaptive gradient steps in fixed order."""
    made = []
    index: dict[str, int] = {}
    for text, spans in examples:
        for a, b in stretches(text):
            land = island(text, a, b)
            where = {(land.begins[i], land.begins[j]): s for s, (i, j) in enumerate(land.segments)}
            gold = [(where[x, y], k) for x, k, y in spans if (x, y) in where]
            if land.segments:
                ids = [[index.setdefault(f, len(index)) for f in names] for names in land.features]
                flat = np.concatenate([np.array(i, int) for i in ids])
                made.append((land, flat, np.cumsum([0, *map(len, ids)])[:-1], np.repeat(np.arange(len(ids)), [len(i) for i in ids]), gold))
    weights = np.zeros((len(index), len(KINDS)))
    squares = np.full_like(weights, 1e-6)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for e in order.permutation(len(made)):
            land, flat, starts, owner, gold = made[e]
            scores = np.add.reduceat(weights[flat], starts)
            _, chance = likelihood(land, scores, gold)
            push = -chance
            for s, k in gold:
                push[s, k] += 1
            rows, inverse = np.unique(flat, return_inverse=True)
            step = np.zeros((len(rows), len(KINDS)))
            np.add.at(step, inverse, push[owner])
            step -= decay * weights[rows]
            squares[rows] += step ** 2
            weights[rows] += rate * step / np.sqrt(squares[rows])
    return Field(index, weights)


def rewritten(kind: int, value: str, rng: random.Random) -> str:
    """An entity in a notation that the patterns miss."""
    if kind == 0:
        local, domain = value.rsplit("@", 1)
        labels = domain.split(".")
        at, dot = rng.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), (" @ ", "."), ("{at}", "{dot}"), ("[at]", ".")])
        return local + at + dot.join(labels)
    digits = digits_of(value)
    if kind == 1:
        return rng.choice(["[.]", "(.)", " . ", "{.}", "[.]"]).join(value.split("."))
    if kind == 2:
        groups = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return rng.choice([".", "/", "  ", " - ", "--", " . "]).join(groups)
    area, first, last = digits[-10:-7] or "487", digits[-7:-4], digits[-4:]
    return rng.choice([f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"1-{area}-{first}-{last}", f"0{area} {first} {last}",
                       f"00{rng.randrange(1, 99)} {area} {first} {last}", f"({area}){first}-{last}", f"0{area}/{first}{last}", f"({area}) {first} {last}"])


def drawn(kind: int, rng: random.Random) -> str:
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    if kind == 0:
        word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
        return f"{word()}{rng.choice(['', '.', '_'])}{rng.choice(['', number(2), word()])}@{word()}{rng.choice(['', '.' + word()])}.{rng.choice(['com', 'org', 'net', 'io', 'de', 'fr', 'info'])}".replace(".@", "@").replace("_@", "@")
    if kind == 1:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        head = rng.choice("3456") + number(14)
        return next(head + c for c in "0123456789" if luhn(head + c))
    return f"+{rng.randrange(1, 99)} {rng.randrange(200, 999)} {number(3)} {number(4)}"


def harmless(rng: random.Random) -> str:
    """Numbers and marks that are nobody's."""
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    year, month, day = rng.randrange(1900, 2040), rng.randrange(1, 13), rng.randrange(1, 29)
    bad = number(16)
    while luhn(bad):
        bad = number(16)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 8)))
    return rng.choice([
        f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{month}/{day}/{year}", f"{year}{month:02d}{day:02d}", f"{year}-{year + rng.randrange(60)}",
        f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"{number(1)}.{number(rng.randrange(6, 12))}", f"{rng.randrange(1, 999)}.{number(3)}.{number(3)}", f"{rng.randrange(1, 999)}.{number(3)}.{number(3)}.{number(3)}",
        number(rng.randrange(7, 20)), f"{bad[:4]}.{bad[4:8]}.{bad[8:12]}.{bad[12:]}", f"{bad[:4]}/{bad[4:8]}/{bad[8:12]}/{bad[12:]}", f"{bad[:4]} - {bad[4:8]} - {bad[8:12]} - {bad[12:]}", f"{bad[:4]}  {bad[4:8]}  {bad[8:12]}  {bad[12:]}",
        f"{rng.randrange(300, 999)}[.]{rng.randrange(300, 999)}[.]{number(2)}[.]{number(1)}", f"{number(2)} {number(3)} {number(2)}", f"{number(5)} - {number(5)}", f"({number(4)}) {number(4)}", f"{number(4)} {number(4)}",
        f"{day:02d}.{month:02d}.{year} - {day:02d}.{month:02d}.{year + 1}", f"{year}/{month:02d}/{day:02d}", f"{number(6)}/{number(2)}", f"{number(3)}.{number(2)}.{number(4)}", f"{number(2)} {number(2)} {number(2)} {number(2)} {number(2)} {number(2)}",
        f"@{word()}", f"{word()} @ {word()}", f"{word()} at {word()} dot dot dot", f"{word()} (at) {word()} {word()}", f"{word()}@{word()}", f"[at] {word()} {word()}."])


def examples(entities: list[tuple[int, str]], contexts: list[str], each: int = 90, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Training texts: ``each`` rewritten entities of a kind and three times as many harmless numbers, in ``contexts``."""
    rng = random.Random(seed)
    contexts = contexts or ["some words before it here | and others after it there"]
    by_kind = [[v for k, v in entities if k == kind] for kind in range(len(KINDS))]
    out = []

    def place(value: str, kind: int | None) -> None:
        left, _, right = rng.choice(contexts).partition("|")
        left, right = left.rstrip() + rng.choice([" ", " ", ": ", "\n", " ("]), rng.choice([" ", " ", ". ", ", ", "\n", ") "]) + right.lstrip()
        text = left + value + right
        out.append((text, [] if kind is None else [(len(left), kind, len(left) + len(value))]))

    for kind in range(len(KINDS)):
        for n in range(each):
            known = by_kind[kind]
            place(rewritten(kind, rng.choice(known) if known and n % 2 else drawn(kind, rng), rng), kind)
            if n % 3 == 0:
                place(drawn(kind, rng), kind)
    for _ in range(3 * each):
        place(harmless(rng), None)
    return out


def labelled_sample(docs: DataFrame, most_docs: int = 4000, most: int = 200) -> tuple[list[tuple[int, str]], list[str]]:
    """Entities that the patterns find, and contexts (words before and after a place, of at most 48 characters each), from
    about ``most_docs`` documents chosen by hash; at most ``most`` entities a kind and contexts."""
    body = texts(docs).where(F.col("text").isNotNull())
    n = body.count()
    share = min(1.0, most_docs / max(n, 1))
    chosen = body.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("personal", object)
        for (bodies,) in text_batches(batches, "text"):
            rows = set()
            for t in bodies:
                rows.update((k, t[a:b]) for a, k, b in base_spans(t) if b - a <= 80)
                middle = t.find(" ", len(t) // 2)
                if middle > 0 and not re.search(r"[0-9@|]", part := t[max(0, middle - 48):middle + 48]):
                    rows.add((-1, part[:min(48, middle)] + "|" + part[min(48, middle):]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "s"])

    found = chosen.select("text").mapInArrow(look, "kind int, s string").distinct()
    pick = lambda kind: [r.s for r in found.where(F.col("kind") == kind).orderBy(F.xxhash64("s"), "s").limit(most).collect()]
    return [(k, s) for k in range(len(KINDS)) for s in pick(k)], pick(-1)


def fit(docs: DataFrame) -> Field:
    return train(examples(*labelled_sample(docs)))


def apart(found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of ``found`` that touch none of ``base``; both by start, spans of ``found`` apart from each other."""
    out, at, reach = [], 0, -1
    for a, k, b in found:
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= a:
            out.append((a, k, b))
    return out


SPANS = "array<struct<kind string, start long, end long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def personal_spans(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and more: the spans of the patterns and those the field adds, by start, then kind. One pass, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("base", _SPAN), ("more", _SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("personal", object)
        for ids, bodies in text_batches(batches, "doc_id", "text"):
            if not ids:
                continue
            base = [base_spans(t or "") for t in bodies]
            more = [apart(model.spans(t or ""), b) for t, b in zip(bodies, base)]
            struct = lambda spans, names: [{"kind": names[k], "start": a, "end": b} for a, k, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([struct(s, KINDS) for s in base], _SPAN),
                                              pa.array([struct(s, FOUND) for s in more], _SPAN)], schema=schema)
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {SPANS}, more {SPANS}")


def span_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans as text, from the spans of ``personal_spans``."""
    place = {k: i for i, k in enumerate(KINDS + FOUND)}
    rank = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    all_spans = F.transform(
        F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.withColumn("all_spans", all_spans).select(
        "doc_id", *map(count, KINDS), F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("all_spans").alias("spans"), F.size("more").cast("long").alias("n_added"))
