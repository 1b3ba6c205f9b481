import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuadra.llm import hard_negatives, periodic_runs, url_filter

VECTORS = "vec_id long, embedding array<double>, label int, rid string, score string, place string, q string"


def _mined(rows, positives=5, negatives=3):
    """Brute force over (id, vector, label), every 50th id an anchor."""
    sound = [(k, i, [math.floor(256 * x) for x in v], g) for k, (i, v, g) in enumerate(rows) if g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    by = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for k, i, v, g in sound:
        if i is None or i % 50:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=True))  # noqa: E731, B023
        others = [(score(w), j, h) for m, j, w, h in sound if m != k and len(w) == len(v)]
        for p, j, _ in sorted((t for t in others if t[2] == g), key=by)[:positives]:
            fits = sorted((t for t in others if t[2] != g and 50 * p <= 100 * t[0] <= 95 * p), key=by)[:negatives]
            out += [(i, j, r, m, p, s) for r, (s, m, _) in enumerate(fits, 1)]
    return Counter(out)


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS)


def _random_vectors(n, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0.2, 0.5, dim).round(2).tolist(), int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 40])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = _random_vectors(420)
    rows += [(50, rows[50][1], rows[50][2]), (50, rows[7][1], 2), (3, rows[3][1], 0), (None, rows[9][1], 1), (None, rows[9][1], 2), *[(1000 + k % 3, rows[100][1], k % 2) for k in range(30)]]
    rows += [(500, None, 1), (550, rows[1][1], None), (600, [None] * 6, 1), (650, [float("nan")] * 6, 1), (700, [float("inf")] + [0.0] * 5, 1), (750, [], 1), (800, [], 2), (850, [0.0] * 6, 1), (900, [0.5, 0.5], 0), (901, [0.5, 0.5], 0), (902, [0.3, 0.5], 1)]
    got = hard_negatives.mine(_vectors(spark, rows), F.col("vec_id") % 50 == 0)
    want = _mined(rows)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 50


def test_hard_negatives_empty_and_large(spark):
    assert hard_negatives.mine(_vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(_vectors(spark, [(1, [1.0], 1)]), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(Exception, match="2\\^53"):
        hard_negatives.mine(_vectors(spark, [(0, [4e6] * 9, 1), (1, [4e6] * 9, 1)]), F.col("vec_id") == 0).count()


def _runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _digests(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and n:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def _texts():
    rng = random.Random(5)
    out = ["", None, " \n", "a " * 11, "a " * 12, "a b " * 6, "a b " * 6 + "a", "x " + "a b c d e f " * 2, "a b c d e f " * 2 + "a b", "a " * 2000]
    for k in range(150):
        words = [rng.choice("ab"[: 1 + k % 2] + "cdef"[: k % 4]) for _ in range(rng.randrange(200))]
        if k % 3 == 0:
            part = words[: rng.randrange(1, 30)]
            words = words[:50] + part * rng.randrange(2, 9) + words[50:]
        out.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(words))
    fib = ["a", "ab"]
    while len(fib) < 14:
        fib.append(fib[-1] + fib[-2])
    thue = "".join(str(bin(k).count("1") % 2) for k in range(1024))
    return [*out, " ".join(fib[-1]), " ".join(thue), " ".join(thue * 2)]


def test_periodic_runs(spark, documents, odd_rows):
    rows = [*enumerate(_texts(), -3), *[(d, t) for d, t in odd_rows if d != 8 and d != 9], (None, "a " * 20), (7, "a " * 20)]
    df = documents(rows)
    found = periodic_runs.collapse_runs(df)
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs))) for r in found.collect()) == Counter((d, len(w), tuple(_runs(w))) for d, t in rows for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "")])
    assert periodic_runs.collapse_runs(documents([])).count() == 0


@pytest.mark.parametrize("points", [1 << 20, 7])
def test_runs_of_many_texts_at_once(monkeypatch, points):
    monkeypatch.setattr(periodic_runs, "POINTS", points)
    texts = [t or "" for t in _texts()[: 60 if points == 7 else None]]
    codes, bounds, words = periodic_runs.token_codes(texts)
    got = periodic_runs.find_runs(codes, bounds)
    assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in _runs(t.split())]


def test_runs_survive_false_hashes(monkeypatch):
    """Hashes that agree everywhere make wrong runs, which are found out and mended word by word."""
    real = periodic_runs._Prefixes.extension
    monkeypatch.setattr(periodic_runs._Prefixes, "extension", lambda self, i, q, most, forwards: np.where(q > 3, most, real(self, i, q, most, forwards)))
    texts = [t or "" for t in _texts()[:80]]
    codes, bounds, _ = periodic_runs.token_codes(texts)
    assert [tuple(r) for r in periodic_runs.find_runs(codes, bounds).tolist()] == [(k, *r) for k, t in enumerate(texts) for r in _runs(t.split())]


def test_op12_on_a_fixture(spark, documents, tmp_path, odd_rows):
    rows = [*enumerate(_texts()), (None, "b " * 30), *[(d, t) for d, t in odd_rows if d not in (8, 9)], *[(k, " ".join(f"w{j % 17}" for j in range(k))) for k in range(300, 340)]]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, periodic_runs.op12(spark, str(tmp_path)).collect()))
    assert got == Counter(_digests(d, t) for d, t in rows)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 10


def _runs_by_period(words):
    """As _runs, with an array for each period, for long texts."""
    codes = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.empty(0, int)
    found = {}
    for q in range(1, len(codes) // 2 + 1):
        edge = np.diff(np.r_[0, (codes[:-q] == codes[q:]).astype(int), 0])
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + q).tolist(), strict=True):
            if e - s >= max(12, 2 * q):
                found.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_op12_on_the_documents(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    monkeypatch.setitem(globals(), "_runs", _runs_by_period)
    got = Counter(map(tuple, periodic_runs.op12(spark, sf_dir).collect()))
    assert got == Counter(_digests(r.doc_id, r.text) for r in rows) and sum(r[1] > 0 for r in got) > 10


def test_long_text_with_long_periods(spark, documents):
    part = " ".join(f"w{k % 1009}" for k in range(70_000))
    got = periodic_runs.collapse_runs(documents([(1, f"{part} {part} tail"), (2, "a " * 300_000)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in got[0].runs][0][0] == 0 and got[1].text == "a" and [tuple(r) for r in got[1].runs] == [(0, 300_000, 1)]


URLS = [
    None, "", "no scheme", "http://", "://", "http://a.com", "http://a.com/", "http://A.CoM/x", "http://com/x", "http://xcom/x", "http://example.com/en/a", "http://example.com/en", "http://example.com/EN/a", "https://www.example.com/en/b?x=/en/", "https://www.example.com/de/",
    "http://sub.www.example.com/en/z", "http://b.net/es/", "http://b.net/es", "http://b.net/fr/1#x", "http://b.net?x/es/", "http://b.net#/es/", "x://y://example.com/en/", "http://a.com:80/", "http://a.com./", "http://.com/", "http://é.com/\n/x", "http://com/a/b/c", "http://a\nb.com/en/",
    "http://" + "a." * 20_000 + "com/" + "b/" * 20_000,
]
PAGES = "page_id long, url string, host string, path string, rule string, verdict string, rid string, digest string, html string"


def _pages(spark, urls):
    return spark.createDataFrame([(k // 2 if k else None, u, *"xxxxxxx") for k, u in enumerate(urls)], PAGES)


def _judged(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p or ""), len(h), v == "block", h.lower() + (p or ""), v) for h, p, v in rules if h and v in ("allow", "block") and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("broadcast", [True, False])
def test_url_filter(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(url_filter, "SHORT", 1)  # short hashes of different expressions meet
    more = [*url_filter.RULES, ("COM", None, "block"), ("example.com", "/e", "allow"), ("b.net", "/es", "allow"), ("a.com.", "", "block"), (None, "/", "block"), ("", "/", "block"), ("net", "/", None), ("net", "/", "odd"), ("net", "es/", "block"), ("b.net", "/fr", "block"), ("net", "/fr/", "block")]
    more += [(f"h{k}.org", f"/{k}/", "block") for k in range(200)]
    urls = [*URLS, *[f"https://www.h{k}.org/{k % 7}/x" for k in range(20)]]
    for rules in (url_filter.RULES, more, []):
        book = spark.createDataFrame([(*r, "x", 1) for r in rules], "host string, path string, verdict string, short string, labels int")
        got = url_filter.judge(_pages(spark, urls), book, default="block")
        assert Counter(map(tuple, got.collect())) == Counter((k // 2 if k else None, *_judged(u, rules, "block")) for k, u in enumerate(urls))
        kept = url_filter.allowed(_pages(spark, urls), book)
        assert Counter(r.url for r in kept.collect()) == Counter(u for u in urls if _judged(u, rules)[3] == "allow") and kept.columns == _pages(spark, urls).columns
    assert url_filter.judge(_pages(spark, []), url_filter.local_rules(spark, url_filter.RULES)).count() == 0


def test_url_filter_is_native(spark, sf_dir):
    plan = url_filter.op13(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow")) and "ReadSchema: struct<page_id:bigint,url:string>" in plan
