"""Every pipeline stage over the small table against a plain restatement of its decision, each on its own input."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from brute import WORD, base_secrets, jaccard_components
from driftline.llm.queries import vocabulary
from driftline.session import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
        seen.append(docs.collect())
        if len(seen) < 6:
            assert docs.columns == corpus_pipeline.COLUMNS
    return seen


def test_language_id_keeps_documents_with_a_language(stages):
    kept = {r.doc_id for r in stages[1]}
    assert all(r in stages[0] for r in stages[1])
    assert all(re.search(r"[^\W\d_]", r.text or "") for r in stages[1])
    lost = [r for r in stages[0] if r.doc_id not in kept and len(WORD.findall(r.text or "")) >= 5]
    assert lost == []


def test_one_document_of_each_group_stays(stages):
    want = {i for i, (_, c) in jaccard_components([(r.doc_id, r.text) for r in stages[1]]).items() if i == c}
    assert sorted(r.doc_id for r in stages[2]) == sorted(want)


def test_secrets_are_replaced_and_clean_texts_stay(stages):
    after = {r.doc_id: r for r in stages[3]}
    assert len(stages[3]) == len(stages[2])
    for r in stages[2]:
        n = sum(base_secrets(r.text)[:3])
        assert sum(base_secrets(after[r.doc_id].text)[:3]) == 0
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
        if not n and not re.search(r"[A-Za-z0-9+/_=-]{20,}", r.text):
            assert after[r.doc_id] == r


def test_mix(stages):
    docs = [(r.doc_id, r.source, len(WORD.findall(r.text)), len(re.findall(r"[#*$%&|<>]", r.text))) for r in stages[3]]
    size = Counter()
    for _, s, n, _ in docs:
        size[s] += n
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size))}
    total, capped = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in size if s not in capped and weight[s] * level > 3 * size[s]}
        if not more:
            break
        capped |= more
    want = Counter()
    for s in size:
        goal = math.floor((3 * size[s] if s in capped else weight[s] * level) + 0.5)
        epochs, room = goal // size[s], goal % size[s]

        def key(d):
            u = (int(hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            return -math.log(u) / ((d[2] + 1) / (d[2] + d[3] + 1))
        for d in sorted((d for d in docs if d[1] == s), key=key):
            want[d[0]] += epochs + (room > 0 and 2 * room >= d[2])
            room -= d[2]
    assert Counter(r.doc_id for r in stages[4]) == +want


def test_packing_keeps_every_token(stages):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {r.doc_id: np.array(t.encode(r.text, add_special_tokens=False).ids + [1]) for r in stages[4]}
    copies = Counter(r.doc_id for r in stages[4])
    covered = {i: np.zeros(len(x), int) for i, x in ids.items()}
    size = Counter()
    for r in stages[5]:
        covered[r.doc_id][r.start:r.start + r.length] += 1
        size[r.sequence_id] += r.length
    assert all((c == copies[i]).all() for i, c in covered.items())
    assert all(n <= 2048 and n & (n - 1) == 0 for n in size.values())
