"""Personal data: the patterns against plain searches, the field against all segmentations, finite differences and held-out
notations."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import personal as P
from driftline.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


def plain_base(text):
    text = text or ""
    number = lambda s: re.sub("[^0-9]", "", s)

    def passes(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            d = int(c) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(number(m.group())) <= 19 and passes(number(m.group()))]
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(number(m.group())) <= 15]
    return sorted(spans)


@pytest.fixture(scope="module")
def field():
    return P.train(P.examples([], []))


def test_patterns():
    rng = random.Random(4)
    alphabet = "aB1234567890..@@-- +()%_é\n"
    for _ in range(20_000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(40)))
        assert P.base_spans(text) == plain_base(text), text
    text = "00255.1.2.3 1.2.3.4.5.6.7.8 256.1.1.1 a@b.c@d.e 4111 1111-1111 1111 +1 (487) 555-7209..."
    assert P.base_spans(text) == plain_base(text)
    assert P.base_spans("a" * 500_000 + "@ " + "1" * 300_000 + " +" + "(" * 300_000) == []  # runs without a match cost no more than their length


def test_decoding_against_all_segmentations(field):
    rng = random.Random(9)
    for _ in range(60):
        text = "x " + rng.choice(["", "(", "+"]) + "".join(rng.choice(["12", "345", "4111", "9", " ", ".", "-", " at ", "ab", "[.]", "@", "8888888"]) for _ in range(9))
        made = P.island(text, 0, len(text))
        scores = field.scores(made)
        chosen = [s for s in range(len(made.segments))]
        best, n = 0.0, len(made.begins) - 1

        def go(at, value):
            nonlocal best
            if at >= n:
                best = max(best, value)
                return
            go(at + 1, value)
            for s in chosen:
                if made.segments[s][0] == at:
                    go(made.segments[s][1], value + scores[s].max())
        go(0, 0.0)
        got = field.decode(P.Tokens(text, 0, len(text)))
        where = {(made.begins[i], made.begins[j]): s for s, (i, j) in enumerate(made.segments)}
        assert sum(scores[where[a, b], k] for a, k, b in got) == pytest.approx(best)
        assert got == field.spans(text)  # the islands of the text lose nothing


def test_likelihood_and_gradient():
    text = "call 487-555-7209 or 12.34.5678 9"
    made = P.island(text, 0, len(text))
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(len(made.segments), len(P.KINDS)))
    gold = [(2, 3)]
    n = len(made.begins) - 1
    total = 0.0

    def go(at, value):  # every segmentation
        nonlocal total
        if at >= n:
            total += np.exp(value)
            return
        go(at + 1, value)
        for s, (i, j) in enumerate(made.segments):
            if i == at:
                for k in range(len(P.KINDS)):
                    go(j, value + scores[s, k])
    go(0, 0.0)
    value, chance = P.likelihood(made, scores, gold)
    assert value == pytest.approx(scores[2, 3] - np.log(total))
    for s, k in [(0, 0), (2, 3), (len(scores) - 1, 1)]:
        moved = scores.copy()
        moved[s, k] += 1e-5
        slope = (P.likelihood(made, moved, gold)[0] - value) / 1e-5
        assert slope == pytest.approx(((s, k) in gold) - chance[s, k], abs=1e-4)


def test_held_out_notations(field):
    held = P.examples([], ["ein anderer text mit worten | davor und danach", "vorher | nachher"], each=60, seed=99)
    right = [field.spans(text) == gold for text, gold in held]
    assert np.mean(right) > 0.97
    clean = [ok for ok, (_, gold) in zip(right, held) if not gold]
    assert np.mean(clean) > 0.99


def test_apart():
    found = [(0, 1, 3), (5, 1, 8), (8, 1, 9), (20, 1, 22)]
    assert P.apart(found, [(2, 0, 6), (9, 0, 21)]) == [(8, 1, 9)]
    assert P.apart(found, []) == found and P.apart([], [(0, 0, 1)]) == []


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = LLM_QUERIES["op12_personal_data"].run(spark, SF).collect()
    assert len(got) == len(docs)
    name = lambda spans: ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    added = 0
    for r in got:
        base = plain_base(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(name(base).encode()).hexdigest()
        kept = [s for s in r.spans.split(",") if s and not s.startswith("crf-")]
        assert ",".join(kept) == name(base)
        added += r.n_added
    assert added <= 2  # clean documents stay alone


def test_defined_cases(spark, field):
    long = "words and more " * 100_000 + "call (487) 555-7209 now"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "mail ann [at] example [dot] org, or bob@example.org"), (4, "mail ann [at] example [dot] org, or bob@example.org"),
            (None, "+1 487 555 7209"), (5, long), (6, "é 83[.]229[.]25[.]121")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("base", "more", "kind", "start", "end", "spans", "n"):
        df = df.withColumn(c, F.lit("x"))
    got = P.digests(P.personal_spans(df, field)).collect()
    at = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    nothing = hashlib.sha256(b"").hexdigest()
    assert all((at[i].spans, at[i].base_sha256, at[i].n_added) == ("", nothing, 0) for i in (1, 2, 3))
    assert at[4].spans == "crf-email:5:31,email:36:51" and at[None].spans == "phone:0:15"
    assert at[5].spans == f"crf-phone:{len(long) - 18}:{len(long) - 4}" and at[6].spans == "crf-ip:2:21"
    empty = df.limit(0)
    assert P.digests(P.personal_spans(empty, P.fit(empty))).count() == 0
