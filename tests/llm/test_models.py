import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuadra.llm import decontaminate, fingerprints, near_dedup, quality, toxicity
from cuadra.llm.common import by_length, connected, range_buckets, shingle_set, token_codes
from cuadra.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels():
    import duckdb

    return {d: (q, t) for d, q, t in duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall()}


def _held_out(rows, labels, place, mod, out):
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    return [(r.predicted, labels[r.doc_id][place]) for r in rows if r.held_out and r.doc_id in labels]


def test_quality_held_out(spark, labels):
    pairs = _held_out(QUERIES["op5_quality"](spark, SF).collect(), labels, 0, 4, 2)
    assert np.mean([a == b for a, b in pairs]) > 0.95


def test_toxicity_held_out(spark, labels):
    pairs = _held_out(QUERIES["op6_toxicity"](spark, SF).collect(), labels, 1, 3, 1)
    assert np.mean([a == b for a, b in pairs]) > 0.9
    assert np.mean([a for a, b in pairs if not b]) < 0.05


def test_toxicity_recall(spark, labels):
    """A few toxic labels are noise: their texts hold no word that tells toxic rows from others. All the rest must be found."""
    import duckdb

    texts = {d: set(re.findall(r"\w+", (t or "").lower())) for d, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()}
    learnt = [d for d in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    seen = [Counter(w for d in learnt if labels[d][1] == c for w in texts[d]) for c in (0, 1)]
    telling = {w for w, n in seen[1].items() if n >= 5 and not seen[0][w]}
    judged = [r for r in QUERIES["op6_toxicity"](spark, SF).collect() if r.held_out and r.doc_id in labels]
    toxic = [r for r in judged if labels[r.doc_id][1]]
    rows = [r for r in toxic if texts[r.doc_id] & telling]
    assert len(rows) >= 14 and np.mean([r.predicted for r in rows]) >= 0.9
    # Of all toxic rows, no more can be found than those with such words, but for chance.
    ceiling = len(rows) / len(toxic)
    assert 0.7 <= ceiling and np.mean([r.predicted for r in toxic]) >= 0.95 * ceiling
    assert sum(r.predicted for r in judged if not labels[r.doc_id][1]) <= 2


def test_pairwise_identity():
    rng = np.random.default_rng(4)
    m = quality.FactorisationMachine(30, 3)
    m.w, m.v = rng.normal(size=30).astype(np.float32), rng.normal(size=(30, 3)).astype(np.float32)
    at, x = np.array([2, 5, 20, 29]), rng.normal(size=4).astype(np.float32)
    plain = m.w[at] @ x + sum((m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(m.raw(at, x, np.array([0]))[0] - plain) < 1e-4


def test_classifiers_take_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    some = spark.createDataFrame([(d, d % 2) for d in range(4, 12)] + [(4, None), (None, 1)], "doc_id long, label int")
    for labels in (some, some.limit(0), some.where("label = 1")):
        for module in (quality, toxicity):
            got = module.score(docs, module.train(docs, labels)).collect()
            assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    model = quality.train(docs, some)
    assert quality.score(documents([]), model).count() == 0
    kept = quality.filter_by_score(docs, model, 0.0)
    assert kept.count() == len(odd_rows) and kept.columns == docs.columns
    assert toxicity.score(documents([]), toxicity.train(documents([]), some)).count() == 0


def _plain_kneser_ney(texts, labels, every):
    """Probabilities (class, v, w), after v and alone, by dictionaries."""
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    documents = Counter(w for t in every for w in set(split(t)))
    total = sum(documents.values())
    classes = []
    for c in (1, 0):
        n = Counter()
        for t, y in zip(texts, labels, strict=True):
            if y == c:
                n.update(zip([toxicity.BEGIN, *split(t)], split(t)))  # noqa: B905
        before = Counter(w for _, w in n)
        classes.append((n, before))

    def taken(counts):
        r = [max(1, sum(x == k for x in counts.values())) for k in (1, 2, 3, 4)]
        y = r[0] / (r[0] + 2 * r[1])
        d = [min(max(k - (k + 1) * y * r[k] / r[k - 1], 0.1), k) for k in (1, 2, 3)]
        return {g: d[min(x, 3) - 1] for g, x in counts.items()}

    def p(c, v, w):
        n, before = classes[0 if c else 1]
        below = taken(before)
        pairs = max(1, sum(before.values()))
        unseen = sum(below.values()) / pairs if before else 1
        alone = (before[w] - below.get(w, 0)) / pairs + unseen * documents[w] / total
        context = sum(x for (a, _), x in n.items() if a == v)
        if not context:
            return alone, alone
        own = taken(n)
        return (n[v, w] - own.get((v, w), 0)) / context + sum(d for (a, _), d in own.items() if a == v) / context * alone, alone

    return p, documents


def test_kneser_ney_by_brute_force(spark, documents):
    rng = np.random.default_rng(7)
    rows = [(d, " ".join(rng.choice(["Ab", "cd", "ef", "Über", "x"] + [f"w{k}" for k in range(40)], 30))) for d in range(16)]
    labels = spark.createDataFrame([(d, d % 2) for d in range(12)], "doc_id long, label int")
    model = toxicity.train(documents(rows), labels).model
    p, known = _plain_kneser_ney([t for d, t in rows if d < 12], [d % 2 for d in range(12)], [t for _, t in rows])
    words = sorted(known)
    for c in (1, 0):
        for v in (toxicity.BEGIN, "ab", "über", "w7", "never"):
            each = [p(c, v, w) for w in words]
            assert abs(sum(a for a, _ in each) - 1) < 1e-9 and abs(sum(b for _, b in each) - 1) < 1e-9
    for text in [t for _, t in rows] + ["ab never heard of Über", "never", "w1"]:
        found = re.findall(r"\w+", text.lower())
        after, alone = model.ratios(*toxicity.sequences([text]))
        for k, (v, w) in enumerate(zip([toxicity.BEGIN, *found], found)):  # noqa: B905
            if w in known:
                (a, b), (c, d) = p(1, v, w), p(0, v, w)
                assert abs(after[k] - np.log(a / c)) < 1e-9 and abs(alone[k] - np.log(b / d)) < 1e-9
        # A word that no document has: both classes back off to the same.
        assert np.isfinite(after).all()


def test_shared_counts_are_of_all_documents(spark, documents, odd_rows):
    rows = odd_rows + [(50, "a b a"), (51, "b c")]
    got = documents(rows).select("text").mapInPandas(toxicity._vocabulary, "word string, hash long, documents long").groupBy("word").agg(F.sum("documents").alias("n"))
    want = Counter(w for _, t in rows for w in set(re.findall(r"\w+", (t or "").lower())))
    assert {r.word: r.n for r in got.collect()} == want


def test_samples_are_bounded(spark, documents):
    rows = [(d, f"t{d} " * 20) for d in range(40)] + [(1, "again"), (2, "x" * 5000), (3, None)]
    labels = spark.createDataFrame([(d, d % 2) for d in range(40)], "doc_id long, label int")
    got = toxicity.labelled_sample(documents(rows), labels, 12, 600).collect()
    assert len({r.doc_id for r in got}) == len(got) and {r.label for r in got} == {0, 1}
    for c in (0, 1):
        assert sum(r.label == c for r in got) <= 12 and sum(len(r.text) for r in got if r.label == c) <= 600
    whole = toxicity.labelled_sample(documents(rows), labels, 100, 80_000).collect()
    assert {r.doc_id for r in whole} == set(range(40))
    assert quality.train(documents([(1, f"text {k}") for k in range(500)] + [(2, "y")]), labels).bias == quality.train(documents([(1, "text 99"), (2, "y")]), labels).bias


def test_tokens_are_those_of_plain_splitting():
    texts = [None, "", " \n ", "one", "  b  A\x1cC ", "Ünï ΣΑΣ a-b,c\u00a0d d", "x" * 40 + "\ty"]
    codes, bounds, tokens = token_codes(texts)
    for k, t in enumerate(texts):
        own = [tokens[i] for i in codes[bounds[k] : bounds[k + 1]]]
        assert own == [x.decode() for x in (t or "").encode().split()]
        plain = re.findall(r"\w+", (t or "").lower())
        assert [w for x in toxicity._words(own) for w in x] == plain
        words, said, at = toxicity.sequences([t, "b c", None, t])
        assert [words[i] for i in said] == [*plain, "b", "c", *plain] and at.tolist() == [0, len(plain), len(plain) + 2, len(plain) + 2, 2 * len(plain) + 2]
    pieces = list(by_length(iter([pd.DataFrame({"text": texts})]), 10))
    assert [t for p in pieces for t in p.text] == texts and len(pieces) > 1


def test_fingerprints(spark, documents, odd_rows):
    rows = odd_rows + [(1000 + k, " ".join(f"t{k}w{i}" for i in range(k % 40))) for k in range(1200)]
    got = fingerprints.compare_with_edits(documents(rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] if r[0] is not None else -(1 << 63), (r[1] or "").encode()), reverse=True)
    want = []
    for k, (d, t) in enumerate(order):
        text = fingerprints.edited(t or "", order[(k + 1) % len(order)][1] or "")
        want.append((d, len(t or ""), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (5, 6, 7)}) == 1
    plain = {(r.doc_id, r.fingerprint) for r in fingerprints.fingerprints(documents(rows)).collect()}
    assert plain == {(r.doc_id, r.fingerprint) for r in got}
    assert fingerprints.compare_with_edits(documents([])).count() == 0
    one = fingerprints.compare_with_edits(documents([(1, "a b c d e f")])).first()
    assert one.near_next == 1.0 == one.jaccard_next
    least = -(1 << 63)
    got = fingerprints.compare_with_edits(documents([(least, "a"), (None, "b"), (5, "c")])).collect()
    assert sorted(map(str, [(r.doc_id, r.n_chars) for r in got])) == sorted(map(str, [(least, 1), (None, 1), (5, 1)]))


def test_likenesses_of_the_query_match_true_similarities(spark):
    """Whole documents: every estimate is within five standard deviations, every similarity of 0.8 is verified, and so is no wrong one."""
    got = sorted(QUERIES["op10_fingerprints"](spark, SF).collect(), key=lambda r: -r.doc_id)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    assert [r.doc_id for r in got] == order
    sets = {d: set(shingle_set(t).tolist()) for d, t in texts.items()}
    true = lambda x, y: len(x & y) / max(1, len(x | y))
    found = 0
    for k, r in enumerate(got):
        after = order[(k + 1) % len(order)]
        for x, near, exact in ((set(shingle_set(fingerprints.edited(texts[r.doc_id], texts[after])).tolist()), r.near_edited, r.jaccard_edited), (sets[after], r.near_next, r.jaccard_next)):
            j = true(sets[r.doc_id], x)
            if sets[r.doc_id] or x:
                assert abs(near - j) <= 5 * (j * (1 - j) / fingerprints.K) ** 0.5 + 2 / fingerprints.K
            assert exact is None or abs(exact - j) < 1e-12
            if j >= 0.8 and x:
                assert exact is not None
                found += 1
    assert found and sum(r.jaccard_edited is not None for r in got) > 300


def test_crowded_bands_are_dealt_out(spark, documents):
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([*base, f"x{k}"])) for k in range(60)] + [(100, None), (None, " ".join(base))]
    docs = documents(rows)
    got = {(r.query_id, r.doc_id) for r in fingerprints.similar_to(docs.where("doc_id % 20 = 0"), docs, crowd=7).collect()}
    assert got == {(q, d) for q in (0, 20, 40) for d in range(60)}
    assert fingerprints.similar_to(documents([]), docs).count() == 0 == fingerprints.similar_to(docs, documents([])).count()


def test_quality_sample_is_bounded_by_features(spark, documents):
    long = " ".join(f"v{i}" for i in range(30_000))
    docs = documents([(k, long + f" y{k}") for k in range(12)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, label int")
    none, few = quality.train(docs, labels, pairs=100), quality.train(docs, labels, pairs=100_000)
    assert none.bias == 0 and not none.v.any()
    assert 0 < (few.w != 0).sum() and quality.score(docs, few).count() == 12


def test_similar_to_verifies(spark, documents):
    base = " ".join(f"w{i}" for i in range(200))
    docs = documents([(1, base), (2, base + " x"), (3, " ".join(f"v{i}" for i in range(200))), (4, None), (5, base)])
    got = {(r.query_id, r.doc_id): r.jaccard for r in fingerprints.similar_to(docs.where("doc_id = 2"), docs).collect()}
    assert set(got) == {(2, 1), (2, 2)} and abs(got[2, 1] - 196 / 197) < 1e-9


def test_similar_pairs_of_all_copies(spark, documents, odd_rows):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join([*base, "x"]), " ".join(w + "v" for w in base)]
    rows = [(20 + k, texts[k % 3]) for k in range(15)] + [(40, texts[0].upper()), *odd_rows]
    docs = documents(rows)
    queries = docs.where("doc_id % 2 = 0")
    pairs = fingerprints.similar_to(queries, docs).select(F.col("query_id").alias("q"), F.col("doc_id").alias("d"))
    of_queries = fingerprints.membership(queries).select(F.col("doc_id").alias("query_id"), F.col("representative").alias("q"))
    of_docs = fingerprints.membership(docs).select("doc_id", F.col("representative").alias("d"))
    got = {(r.query_id, r.doc_id) for r in pairs.join(of_queries, "q").join(of_docs, "d").collect()}
    sets = {d: set(shingle_set(t).tolist()) for d, t in rows if d is not None}
    assert got == {(q, d) for q in sets for d in sets if q % 2 == 0 and sets[q] and len(sets[q] & sets[d]) >= 0.8 * len(sets[q] | sets[d])}
    assert fingerprints.membership(documents([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict(tuple(r) for r in connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, **{k: 100 for k in range(100, 140)}}


def test_buckets_are_ranges(spark):
    df, n = range_buckets(spark.range(5000).withColumnRenamed("id", "k"), "k", 300)
    rows = sorted((r.bucket, r.k) for r in df.collect())
    assert [k for _, k in rows] == list(range(5000)) and rows[-1][0] == n - 1 and n > 10


def test_stages_take_odd_rows(spark, documents, odd_rows):
    by_name = dict(corpus_pipeline.STAGES)
    for rows in (odd_rows, []):
        docs = documents(rows).withColumns({c: F.lit(c) for c in ("row", "secrets", "hit", "id", "n", "_id", "_th", "key", "node", "words")})
        for name in ("quality_classifier", "near_dedup", "decontamination", "secret_scan"):
            out = by_name[name](spark, docs, "/root/testdata/sf0.001")
            assert out.columns == docs.columns
            n = out.count()
            assert (n == len(rows)) if name == "secret_scan" else n <= len(rows)
        packed = by_name["packing"](spark, docs, "/root/testdata/sf0.001").collect()
        assert sorted(str(r.doc_id) for r in packed if r.piece == 0) == sorted(str(d) for d, _ in rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_dedup", "decontamination", "secret_scan", "packing"]
    ids, texts = {}, {}
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        if name != "packing":
            assert out.columns == docs.columns
            out = corpus_pipeline.spill(out)
            rows = out.select("doc_id", "text").collect()
            ids[name], texts[name] = {r.doc_id for r in rows}, {r.doc_id: r.text for r in rows}
    every = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(ids["quality_classifier"]) > 0.8 * len(every)
    kept = near_dedup.brute_force(sorted(texts["quality_classifier"].items()), percent=80)
    assert ids["near_dedup"] == {d for d, _, _, keep in kept if keep}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.report(decontaminate.find_hits(docs, bench)).where("contaminated").collect()}
    assert ids["decontamination"] == ids["near_dedup"] - hit == ids["secret_scan"]
    assert any("[SECRET]" in t for t in texts["secret_scan"].values())
    packed = out.collect()
    assert {r.doc_id for r in packed} == ids["secret_scan"]
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
