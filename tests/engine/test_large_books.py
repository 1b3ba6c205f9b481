"""Books that are too large for the tasks are joined by equal parts, without comparing every text with every pattern."""

from cuadra.operators import classify


def test_large_books_need_no_comparison_of_all_with_all(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "Comisión  mant."), ("a", "otra cosa"), ("b", "comision"), ("a", ""), ("a", "x"), (None, "comision")], "bank string, c string")
    rules = classify.rule_book(spark, [("a", "contains", "sion mant", "LATE"), ("a", "contains", "comisión", "GASTO"), ("a", "contains", "COMISION", "NEVER"), ("b", "contains", "x", "X"), ("b", "regex", "^com", "R"), ("a", "contains", "cosa", "COSA")])
    out = spark.createDataFrame([("a", "otra"), ("b", "mant")], "bank string, pattern string")
    small = [(sorted(map(str, classify.first_match_join(rows, "c", rules, "bank").collect()))), sorted(map(str, classify.without_excluded(rows, "c", out, "bank").collect()))]
    monkeypatch.setattr(classify, "BOOK_BYTES", 0)
    large = [classify.first_match_join(rows, "c", rules, "bank"), classify.without_excluded(rows, "c", out, "bank")]
    assert [sorted(map(str, df.collect())) for df in large] == small
    plain = classify.first_match_join(rows, "c", rules.where("mode = 'contains'"), "bank")
    for df in (plain, large[1]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
