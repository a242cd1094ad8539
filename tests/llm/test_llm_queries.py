"""The registered queries over whole small tables: against SQL, brute force, round trips or held-out accuracy."""

import re
import zlib

import numpy as np
import pytest

import oracle
from brute import base_quality, base_secrets, jaccard_components, license_words, removed_bytes
from driftline.llm import licenses
from driftline.llm.queries import LLM_QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name):
    return LLM_QUERIES[name].run(spark, SF).collect()


def test_all_operators():
    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in LLM_QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(n for n, e in LLM_QUERIES.items() if e.sql))
def test_matches_sql(spark, name):
    assert oracle.differences(spark, SF, LLM_QUERIES[name]) is None


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = rows(spark, "op1_token_counts")
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in docs)


def test_language(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows(spark, "op2_language_id")
    assert {r.doc_id for r in got} == set(langs) and len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_licenses(spark, docs):
    sets = [(label, set(licenses._tokens(t))) for label, t in licenses.TEMPLATES]
    want = []
    for i, text in docs:
        w = license_words(text)
        at, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            here = [k for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
            at += here
            base |= {label} if here else set()
        more = {label for label, s in sets for k in range(0, len(w), 32) if len(set(w[k:k + 64]) & s) >= 0.9 * len(s) - 1e-9}
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more))))
    got = [tuple(r)[:7] for r in rows(spark, "op3_license_scans")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_neighbours(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    got = rows(spark, "op4_nearest_neighbours")
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]])
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in mine] == list(range(1, 11))
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits, total = hits + len(best & {r[1] for r in mine}), total + 10
    assert hits / total >= 0.9


def test_fertility(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op5_tokeniser_fertility")}
    for i, text in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_quality(text)
        assert not (r.kept and r.base_failed)


def test_jaccard(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op7_ngram_jaccard")}
    assert got == jaccard_components(docs)


def test_packing_is_a_round_trip(spark, docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x in docs}
    at, sequences = dict.fromkeys(ids, 0), {}
    for r in sorted(rows(spark, "op8_packing"), key=lambda r: (r.doc_id, r.start)):
        assert at[r.doc_id] == r.start and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert zlib.crc32(ids[r.doc_id][r.start:at[r.doc_id]].tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for pieces in sequences.values():
        size = 0
        for offset, length in sorted(pieces):
            assert offset == size
            size += length
        assert size <= 2048 and size & (size - 1) == 0  # full, or a power of two: no padding at all


def test_secrets(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op9_secret_scans")}
    for i, text in docs:
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == base_secrets(text)
        for span in filter(None, r.spans.split(",")):
            kind, a, b = span.split(":")
            assert kind != "markov" or re.search(r"\d", text[int(a):int(b)])


def test_suffixes(spark, docs):
    got = sorted((tuple(r) for r in rows(spark, "op10_suffix_dedup")), key=str)
    assert got == removed_bytes(docs)
