import random
import re

import pytest
from pyspark.sql import functions as F

from cuadra.operators import classify
from cuadra.operators.matching import Matcher, needed_literals


def test_needed_literals():
    assert needed_literals(r"GRAVAMEN LEY 25413|IMP\.DB/CR") == ["GRAVAMEN LEY 25413", "IMP.DB/CR"]
    assert needed_literals(r"ING\.? ?BRUT|^COM\b|RET\.?IIBB") == ["BRUT", "COM", "IIBB"]
    assert needed_literals(r"RG ?2408") == ["2408"] and needed_literals(r"ab{2,3}c\d+xyz") == ["XYZ"] and needed_literals("ab+c") == ["AB"]
    for pattern in ("(a|b)c", "[ab]c", "", "a|", "x?", ".*", r"\d+", "é|a", "a{2"):
        assert needed_literals(pattern) is None


def test_matcher_is_the_first_rule_in_order():
    rng = random.Random(4)
    letters = "AB .1É"
    entries = []
    for _ in range(400):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 4)))
        mode = rng.choice(["contains", "regex"])
        if mode == "regex":
            word = word or "B"
            word = re.escape(word) + rng.choice(["", "?", "|B1", "+", r"\b", "[A1]", "$"])
        entries.append((rng.choice(["x", "y", None]), mode, word, f"C{len(entries)}"))
    entries = entries[:1] + [e for e in entries[1:] if e[2] not in ("", "?") or rng.random() < 0.02]
    for part in (entries, [e for e in entries if e[1] == "regex"], [e for e in entries if e[2]]):
        m = Matcher(part)
        for _ in range(300):
            text = "".join(rng.choice(letters + "ab") for _ in range(rng.randrange(0, 9)))
            for bank in ("x", "y", None, "z"):
                want = next(((k, c) for k, (b, mode, p, c) in enumerate(part) if b == bank and (re.search(p, text, re.I) if mode == "regex" else p in text)), None)
                assert m.first(bank, text, text) == want
    assert Matcher([]).first("x", "a", "a") is None and Matcher(entries).first("x", None, None) is None


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_book_and_join_agree(spark, monkeypatch, most):
    """A book that is too large to be sent is joined, with the same result."""
    monkeypatch.setattr(classify, "BOOK_BYTES", most)
    rows = spark.createDataFrame([(k, b, t) for k, (b, t) in enumerate([("BNA", "Comisión  mant."), ("BNA", "comision mant"), ("BPAT", "Débito  visa"), ("BNA", "debito VISA"), ("BNA", None), (None, "comision"), ("BNA", "IVA percepción"), ("BNA", "IVA BASE"), ("BNA", "")])], "k int, bank string, concept string")
    rules = classify.rule_book(spark, [("BNA", "contains", "Comisión", "A"), ("BNA", "regex", r"^comis|iva ", "B"), ("BPAT", "regex", "visa$", "C"), ("BPAT", None, "deb", None), ("BNA", "contains", " ", "Z")])
    got = {r.k: r.category for r in classify.first_match_join(rows, "concept", rules, "bank").collect()}
    assert got == {0: "A", 1: "A", 2: "C", 3: None, 4: None, 5: None, 6: "RET_IVA", 7: "B", 8: None}
    kept = classify.without_excluded(rows, "concept", spark.createDataFrame([("BNA", " visa"), ("BPAT", "nada")], "bank string, pattern string"), "bank")
    assert sorted(r.k for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 7, 8]
    every = classify.first_match_join(rows, "concept", rules.where("mode = 'contains'"))
    assert {r.k: r.category for r in every.collect()}[2] == "OTROS"
    if most:
        plan = every._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


def test_asks_by_page(spark):
    got = spark.range(1, 5).select(classify.asks_by_page(F.col("id"), "invoice").alias("i"), classify.asks_by_page(F.col("id"), "settlement").alias("s")).collect()
    assert [(r.i, r.s) for r in got] == [(False, False), (True, False), (True, True), (True, True)]
