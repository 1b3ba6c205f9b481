"""Normalization and grouping look at a text once, in whole batches."""

import re
import unicodedata

from pyspark.sql import functions as F

from cuadra.functions import text


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


TEXTS = ["", " ", "  Débito \t\x0b\r\n\f b ", "a\x1c b\x85c  d e", "straße  Ærø", "ﬁ ẹ́ x", "привет й  Ё", "각 がぎ", "́", "À́  ⃐b", None, "plain  ascii"]


def _expected(t):
    kept = "".join(c for c in unicodedata.normalize("NFD", t or "") if unicodedata.category(c) != "Mn")
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", kept).strip(" ").upper()


def test_spaces_are_collapsed_with_the_accents_and_not_by_a_regex_of_each_cell(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string").coalesce(1)
    df = rows.select("k", text.norm_text(F.col("t")).alias("n"), text.norm_cells(F.array("t", F.lit("é  x"), "t")).alias("c"))
    assert "regexp_replace" not in _plan(df)
    for r in df.collect():
        assert (r.n, r.c) == (_expected(TEXTS[r.k]), [_expected(TEXTS[r.k]), "E X", _expected(TEXTS[r.k])])
    kept = rows.select("k", text.strip_accents(F.col("t")).alias("s")).collect()
    assert {r.k: r.s for r in kept if r.k in (2, 10, 11)} == {2: "  Debito \t\x0b\r\n\f b ", 10: None, 11: "plain  ascii"}


NAMES = ["FAC ACME SA 01-02 0001-00012345.pdf", "ACME_SA  01/02/2024 0001/00012345 (2).PDF", "foto1.jpg", "ab 01-02 12345678", "ACME 12345678.pdf", "ACME 01-02-2024", "ñandú & co 5_6_24 20123456789", ".pdf", "x"]


def test_names_are_searched_once_for_each_token(spark):
    from cuadra.operators import ingest

    files = spark.createDataFrame([(n, k) for k, n in enumerate([*NAMES, NAMES[0].lower()])], "name string, modificationTime int")
    grouped = ingest.group_documents(files)
    assert _plan(grouped).count("regexp_") <= 12
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.col("name"), r"\.[^.]*$", ""), r"\s+", " "))
    both = text.with_name_tokens(files, stem).select("_provider", text.provider_key(stem).alias("p"), "_date", text.date_token(stem).alias("d"), "_voucher", text.voucher_token(stem).alias("v"))
    for r in both.collect():
        assert (r._provider, r._date, r._voucher) == (r.p, r.d, r.v)
    got = {r.document: ([m.modified for m in r.members], r.n) for r in grouped.collect()}
    assert got["ACME SA|01-02|0001-00012345"] == ([0, 9], 2) and got["file:foto1.jpg"] == ([2], 1) and sum(n for _, n in got.values()) == len(NAMES) + 1
