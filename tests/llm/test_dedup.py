import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cuadra.llm import near_dedup, substring_dedup


def _texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    shared = [" ".join(word() for _ in range(n)) for n in (34, 35, 36, 60, 120)]
    out = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(50)))]
        if k % 2:
            parts += [rng.choice(shared), " ".join(word() for _ in range(rng.randrange(20)))]
        out.append(" ".join(parts))
    return out + ["da da " * 60, "da da " * 20, out[0]]


def _check(rows, got):
    want = substring_dedup.brute_force([t for _, t in rows])
    have = sorted(((r.doc_id is None, r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=str)
    assert have == sorted(((d is None, d, *w) for (d, _), w in zip(rows, want, strict=True)), key=str)


def test_repeats_match_brute_force(spark, documents):
    for hot in (1, 100):  # every minimizer hot, and hardly any
        rows = list(enumerate(_texts()))
        got = substring_dedup.remove_repeats(documents(rows), hot=hot, index_words=500).collect()
        _check(rows, got)
        assert sum(r.n_removed for r in got) > 500


def test_repeats_of_odd_rows(spark, documents, odd_rows):
    _check(odd_rows, substring_dedup.remove_repeats(documents(odd_rows)).collect())
    assert substring_dedup.remove_repeats(documents([])).count() == 0


def test_repeats_with_nul_words(spark, documents):
    rng = random.Random(9)
    part = [rng.choice(["\x00", "\x00\x00", "a\x00b", "c", "d", "e"]) for _ in range(90)]
    other = [rng.choice("xyz\x00") for _ in range(50)]
    rows = [(1, " ".join(part)), (2, " ".join(other + part[10:80] + ["\x00"])), (3, "\x00 " * 80), (4, "\x00"), (5, " ".join(part[:34]))]
    for hot in (1, 100):
        got = substring_dedup.remove_repeats(documents(rows), hot=hot).collect()
        _check(rows, got)
        assert {r.doc_id for r in got if r.n_removed} == {1, 2, 3}


def test_hot_phrase_is_dealt_out_again(spark, documents):
    rng = random.Random(4)
    phrase = [f"p{i}" for i in range(8)]
    passages = [[f"w{rng.randrange(10**6)}" for _ in range(30)] + phrase + [f"w{rng.randrange(10**6)}" for _ in range(30)] for _ in range(40)]
    rows = [(k, " ".join(passages[k % 40])) for k in range(80)]
    for fine in (8, 24, 35):
        _check(rows, substring_dedup.remove_repeats(documents(rows), hot=10, index_words=200, fine=fine).collect())


def test_index_counts():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 400)
    index = substring_dedup.WaveletIndex(text)
    for n in (1, 3, 7):
        pattern = text[50 : 50 + n]
        lo, hi = np.zeros(1, np.int64), np.full(1, index.n)
        for c in pattern[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        count = sum((text[i : i + n] == pattern).all() for i in range(len(text) - n + 1))
        assert hi[0] - lo[0] == count


def _near(seed=5, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, k = [], 0
    for _ in range(6):
        base = [word() for _ in range(150)]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = word()
            rows.append((k, " ".join(w)))
            k += 1
    return rows


def test_near_duplicates_match_brute_force(spark, documents):
    rows = _near()
    for block in (8, 128):
        got = sorted(tuple(r) for r in near_dedup.near_duplicates(documents(rows), block=block).collect())
        assert got == sorted(near_dedup.brute_force(rows))


def test_pipeline_links_from_80_percent(spark, documents):
    import corpus_pipeline

    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):  # a copy with 4 words changed apart from each other: 176 of 216 shingles, 0.815
        one = [f"{w}k{k}" for w in base]
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join("x" if i in (30, 70, 110, 150) else w for i, w in enumerate(one)))]
    got = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, documents(rows), "").collect()}
    assert got == {d for d, _, _, keep in near_dedup.brute_force(rows, percent=80) if keep} == set(range(0, 24, 2))
    assert len([d for d, _, _, keep in near_dedup.brute_force(rows) if keep]) == 24
    assert (1 - 0.8 ** near_dedup.banding(80)[1]) ** near_dedup.banding(80)[0] < 2e-7 and near_dedup.banding(85) == (32, 6)
    for percent in range(1, 101):
        bands, band_rows = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** band_rows) ** bands < 4e-7


def test_near_duplicates_of_odd_rows(spark, documents, odd_rows):
    got = near_dedup.near_duplicates(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    label = {r.doc_id: r.component_id for r in got}
    assert label[5] == label[6] == label[7] == 5  # case aside
    assert label[8] == label[9] == 8
    assert [label[k] for k in (1, 2, 3, 4)] == [1, 2, 3, 4] and label[None] is None
    assert near_dedup.near_duplicates(documents([])).count() == 0


def test_texts_of_one_id_are_one_node(spark, documents):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    label = {r.component_id for r in near_dedup.near_duplicates(documents([(1, a), (2, a), (2, b), (3, b)])).collect()}
    assert label == {1}


def test_texts_of_one_id_lose_no_links(spark, documents):
    rng = random.Random(8)
    rows = []
    for k in range(0, 160, 4):  # texts a and b under one id; near copies of each under ids of their own
        a, b = ([f"{c}{rng.randrange(10**6)}" for _ in range(130)] for c in "ab")
        near = lambda w: " ".join([*w[:60], "other", *w[61:]])
        rows += [(k, " ".join(a)), (k, " ".join(b)), (k + 1, near(a)), (k + 2, near(b)), (k + 3, None), (k + 2, "")]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(documents(rows)).collect())
    assert got == sorted(near_dedup.brute_force(rows))
    assert {c for _, _, c, _ in got} == {k + j for k in range(0, 160, 4) for j in (0, 3)}
    # Judged by their texts alone, the two texts of an id both stay.
    kept = near_dedup.drop_near_duplicates(documents(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k + j for k in range(0, 160, 4) for j in (0, 0, 2, 3))
    assert kept.columns == documents([]).columns


def test_classes_below_the_threshold_that_share_bands(spark, documents):
    # Half of each text is common: classes share bands, few are links, so that blocks of bands must meet.
    rng = random.Random(6)
    common = [f"c{i}" for i in range(100)]
    own = [[f"o{rng.randrange(10**6)}" for _ in range(30 + k % 7)] for k in range(60)]
    rows = [(k, " ".join(common + own[k % 60] + (["end"] if k >= 60 else []))) for k in range(90)]
    for block in (4, 128):
        got = sorted(tuple(r) for r in near_dedup.near_duplicates(documents(rows), block=block).collect())
        assert got == sorted(near_dedup.brute_force(rows))


def test_connected_copies_meet_no_more():
    rng = np.random.default_rng(3)
    sketch = [rng.bytes(64) for _ in range(50)]
    group = pd.DataFrame({"band": 1, "c": 0, "i": 0, "d": 0, "j": 0, "side": 0, "node": range(50), "label": 7, "n": 100, "sketch": sketch})
    assert not list(near_dedup._survivors(85, 192)(iter([group])))
    group.loc[:, "sketch"] = [sketch[0]] * 50
    assert not list(near_dedup._survivors(85, 192)(iter([group])))
    group.loc[3, "label"] = 8
    assert len(pd.concat(near_dedup._survivors(85, 192)(iter([group[:20], group[20:]])))) == 50


def test_pairs_meet_in_the_first_band_that_they_share():
    sketch = np.random.default_rng(3).bytes(64)
    group = pd.DataFrame({"band": 1, "c": 0, "i": 0, "d": 0, "j": 0, "side": 0, "node": range(4), "label": range(4), "n": 100, "sketch": [sketch] * 4})
    group["at"], group["bands"] = 2, [np.array(b) for b in ([5, 8, 1], [6, 8, 1], [6, 9, 1], [6, 9, 1])]
    assert [r[:2] for r in near_dedup._pairs_of_blocks(group, 85, 192).tolist()] == [[0, 2], [0, 3]]
    assert list(pd.concat(near_dedup._survivors(85, 192)(iter([group]))).node) == [0, 2, 3]
    assert len(near_dedup._pairs_of_blocks(group.assign(at=0), 85, 192)) == 6


def test_small_sets_share_large_blocks(spark):
    rows = spark.range(300).selectExpr("1L band", "id node", "id label", "cast('' as binary) sketch", "0 at", "array(1L) bands")
    of_size = lambda n: near_dedup._blocks(rows.withColumn("n", F.lit(n).cast("long")), 80, 128).count()
    assert of_size(100) == 300 and of_size(100_000) == 900


def test_drop_near_duplicates_of_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()))
    want = [(d is None, d or 0, t or "") for d, t in odd_rows if d not in (6, 7, 9)]
    want.remove((False, 5, odd_rows[5][1]))  # repeated row
    assert got == sorted(want)
    assert near_dedup.drop_near_duplicates(documents([])).count() == 0


def test_sketches_estimate():
    from cuadra.llm.common import MinHash

    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 1000, np.uint64)
    y = np.r_[x[:900], rng.integers(0, 2**63, 100, np.uint64)]
    hashes = MinHash(192)
    a, b = (np.frombuffer(near_dedup.odd_sketch(hashes.samples(s)), np.uint64) for s in (x, y))
    about = near_dedup.sketch_similarity(np.array([np.bitwise_count(a ^ b).sum()]), 192)[0]
    assert abs(about - 900 / 1100) < 0.12
