import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuadra.llm import packing, token_files
from cuadra.llm.tokens import END, encoder, vocabulary_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x0b\x1c  a's1é!<|endoftext|>"), st.characters(codec="utf-8")), max_size=40))
def test_encoder_is_the_tokenizer(plain, text):
    assert encoder(vocabulary_path()).encode([text])[0].tolist() == plain(text)


def test_encoder_keeps_known_words(plain):
    texts = ["the cat  sat\n\n on", None, "", "the cat", "a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b c", "<|endoftext|"] * 3
    assert plain("a <|endoftext|> b") == [64, 220, 50256, 275]
    assert [x.tolist() for x in encoder(vocabulary_path()).encode(texts)] == [plain(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_patterns_use_every_length_once(histogram):
    used = {}
    for lengths, times in packing.patterns(histogram, 64):
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == histogram


def test_fullest_is_fullest():
    for order in packing.ORDERS:
        assert sum(packing.fullest({40: 1, 30: 1, 24: 1, 7: 3}, 64, order)) == 64
        assert sorted(packing.fullest({50: 2, 9: 1, 8: 1}, 64, order)) == [9, 50]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 3), min_size=1, max_size=7), st.integers(24, 40))
def test_fullest_by_brute_force(histogram, capacity):
    from itertools import product

    rest = {n: c - (n == max(histogram)) for n, c in histogram.items()}
    sums = {sum(n * k for n, k in zip(rest, ks, strict=True)) + max(histogram) for ks in product(*(range(c + 1) for c in rest.values()))}
    for order in packing.ORDERS:
        assert sum(packing.fullest(histogram, capacity, order)) == max(s for s in sums if s <= capacity)


def test_few_bins():
    from collections import Counter

    import duckdb

    for sf in ("sf0.01", "sf0.1"):
        lengths = Counter()
        texts = [r[0] for r in duckdb.sql(f"select text from '/root/testdata/{sf}/documents.parquet'").fetchall()]
        for ids in encoder(vocabulary_path()).encode(texts):
            full, rest = divmod(len(ids) + 1, 1024)
            lengths[1024] += full
            lengths[rest] += rest > 0
        bins = packing.number(packing.patterns(+lengths, 1024))
        assert bins <= 1.005 * -(-sum(n * c for n, c in lengths.items()) // 1024)


def test_packing(spark, documents, odd_rows, plain):
    rows = odd_rows + [(100 + i, "wort " * (i * 7 % 900)) for i in range(80)]
    got = packing.pack(documents(rows)).collect()
    want = []
    for d, t in rows:
        ids = np.array(plain(t) + [END], "<u4")
        ends = range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)
        for k, b in enumerate(ends):
            a = max(0, b - 1024)
            want.append((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(bins) <= 1.03 * total / 1024 + 2
    assert packing.pack(documents([])).count() == 0


def test_token_files_round_trip(spark, documents, odd_rows, plain, tmp_path):
    to = str(tmp_path / "tokens")
    token_files.write_token_files(documents(odd_rows), to, file_tokens=1000)
    assert spark.read.parquet(to).count() > 3
    got = sorted(token_files.read_token_files(spark, to).collect(), key=lambda r: r.start)
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for r, (d, t) in zip(got, order, strict=True):
        ids = np.array(plain(t) + [END], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_files.write_token_files(documents([]), to + "0")
    assert token_files.read_token_files(spark, to + "0").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=90), max_size=6))
def test_codes_give_random_access(lists):
    ids = np.array([x for part in lists for x in part], np.uint32)
    offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
    codes = token_files.Codes(token_files.write_codes(ids, offsets))
    assert codes.between(0, len(ids)).tolist() == ids.tolist()
    assert codes.at(np.arange(len(ids))).tolist() == ids.tolist()
    assert [codes[i] for i in range(len(ids))] == ids.tolist()
    assert [codes.document(k).tolist() for k in range(len(lists))] == lists
    with pytest.raises(IndexError):
        codes[len(ids)]
