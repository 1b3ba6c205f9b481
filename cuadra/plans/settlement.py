"""Card settlements to ledgers: deterministic extraction of page texts, which overrides a model's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import block_date, page_period, period_to_date
from ..functions.numbers import MONEY, once, parse_zero, vat_or_theory
from ..functions.text import after, ar_amounts, clean_label, is_noise, last_number, section_label, split_pipe
from ..operators.classify import CARD_CATEGORIES, LEDGER_ORDER, NET, SALES, SHEET_ORDER, card_of_name, card_of_text, card_phrase, classify_concept, is_generic_card, is_nacion, is_patagonia, line_label, paying_bank, positional_category
from ..operators.frames import block_amounts, carry_forward, crop, drop_covered, keep_first
from ..operators.ledger import complete_or_all, control_sheet, document_header, filled_categories, honour_net, last_per_category, two_largest, with_residual
from ..sources.scratch import written

#: Fixed: amounts on a page, by name; each pattern's capture is one amount.
PAGE_SUMS = {
    "sales": r"(?i)VENTAS\s*C[/ ]DESCUENTO\s*CONTADO\+?\s*\$?\s*([0-9\.\,]+)",
    "fees": r"(?i)ARANCEL-?\s*\$?\s*([0-9\.\,]+)",
    "vat": r"(?i)IVA\s*CRED[^0-9]*\$?\s*([0-9\.\,]+)",
    "ret_iibb": r"(?i)RETENCION\s*ING[^0-9]*\$?\s*([0-9\.\,]+)",
    "ret_iva": r"(?i)(?:PERCEPCION|RETENCION)\s*IVA[^0-9]*\$?\s*([0-9\.\,]+)",
    "ret_gan": r"(?i)RETENCION\s*GANANCIAS[^0-9]*\$?\s*([0-9\.\,]+)",
    "net": r"(?i)IMPORTE\s*NETO\s*DE\s*PAGOS\s*\$?\s*([0-9\.\,]+)",
}
SALES_LINE, NET_LINE = r"(?i)VENTAS\s*C[/ ]DESCUENTO\s*CONTADO", r"(?i)IMPORTE\s*NETO\s*DE\s*PAGOS"


def sum_matches(text: Column, pattern: str) -> Column:
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0.0), lambda a, x: a + parse_zero(x))


def header_amounts(text: Column) -> Column:
    """Positive amounts near the labels of a header."""
    near = [F.coalesce(ar_amounts(after(text, label, 220)), F.array().cast("array<string>")) for label in ("Total presentado", "Neto de pagos")]
    return F.filter(F.transform(F.concat(*near), parse_zero), lambda x: x > 0)


def _three(amounts: Column) -> Column:
    positive = F.filter(F.transform(F.coalesce(amounts, F.array().cast("array<string>")), parse_zero), lambda x: x > 0)
    return F.when(F.size(positive) >= 3, F.slice(positive, 1, 3))


def patagonia_header(text: Column) -> Column:
    """[total, discount, balance] of a Patagonia header: by its three titles, near the total, else by lines, else by section."""
    titles = r"(?i)TOTAL\s+PRESENTADO\s*\$\s*([0-9.,]+)\s*[\r\n ]+TOTAL\s+DESCUENTO\s*\$\s*([0-9.,]+)\s*[\r\n ]+SALDO\s*\$\s*([0-9.,]+)"
    named = F.when(text.rlike(titles), F.array(*[parse_zero(F.regexp_extract(text, titles, k)) for k in (1, 2, 3)]))
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(r"(?i)TOTAL\s+PRESENTADO\s*\$")), F.lit(True)).cast("int")
    by_lines = F.when(at > 0, ar_amounts(F.array_join(F.slice(lines, F.greatest(at, F.lit(1)), F.lit(12)), "\n")))
    return F.coalesce(named, _three(ar_amounts(after(text, "TOTAL PRESENTADO", 500))), _three(by_lines), _three(ar_amounts(after(text, "RIO NEGRO", 500, "FECHA DE PAGO"))))


def document_facts(pages: DataFrame) -> DataFrame:
    """One row per doc: bank flags and name, card, period, header amounts and sums over pages. ``pages``: doc, file, page_no, text.

    Flags, names and header amounts are those of the first page that has one.
    """
    two = two_largest(header_amounts(F.col("text")))
    seen = Window.partitionBy("doc").orderBy("file", "page_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.select("doc", "file", "page_no", "text", F.max(is_patagonia(F.col("text"))).over(seen).alias("pat"), is_nacion(F.col("text")).alias("nac"), F.struct("file", "page_no").alias("o"), two.alias("two"))
    rows = rows.withColumn("three", F.when(F.col("pat"), patagonia_header(F.col("text"))))
    brand = F.coalesce(card_of_text(F.col("text")), card_of_name(F.col("file")))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("o")))
    sums = [F.sum(sum_matches(F.col("text"), p)).cast(MONEY).cast("double").alias(n) for n, p in PAGE_SUMS.items()]
    facts = rows.groupBy("doc").agg(
        F.max("nac").alias("nacion"), F.max("pat").alias("patagonia"),
        first(paying_bank(F.col("text"))).alias("_bank"), first(card_phrase(F.col("text"))).alias("_phrase"), first(brand).alias("_brand"), first(page_period(F.col("text"))).alias("period"),
        first(F.get("two", 0)).alias("_t"), first(F.get("two", 1)).alias("net_header"), first(F.get("three", 0)).alias("_p"), first(F.get("three", 2)).alias("balance"), *sums,
    )
    card = F.when(F.col("_phrase").isNull() | is_generic_card(F.col("_phrase")), F.coalesce("_brand", "_phrase")).otherwise(F.col("_phrase"))
    bank = F.coalesce("_bank", F.when(F.col("patagonia"), "BANCO PATAGONIA S.A."), F.when(F.col("nacion"), "BANCO DE LA NACION ARGENTINA"))
    daily = sum((F.col(n) for n in list(PAGE_SUMS)[1:]), F.col("sales")) > 0
    return facts.select("doc", "nacion", "patagonia", bank.alias("bank_name"), card.alias("card_name"), "period", F.coalesce("_t", "_p").alias("total_header"), "net_header", "balance", daily.alias("has_daily"), *PAGE_SUMS)


#: Pages that one task puts in order.
PAGES = 50_000


def dealt_by_doc(pages: DataFrame) -> DataFrame:
    """``pages`` by doc, in as many partitions as their number asks for, so that what a task sorts doesn't grow with the input."""
    shuffled = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(max(shuffled, -(-pages.count() // PAGES)), "doc")


def labelled_lines(lines: Column) -> Column:
    """k (from 0), label and amount of the lines that have a label and a positive amount."""
    named = F.filter(F.transform(lines, lambda x, k: F.struct(k.alias("k"), x.alias("line"), line_label(x).alias("label"))), lambda x: x["label"].isNotNull())
    amounts = F.transform(named, lambda x: F.struct(x["k"].alias("k"), x["label"].alias("label"), parse_zero(last_number(x["line"])).alias("amount")))
    return F.filter(amounts, lambda x: x["amount"] > 0)


def sequential_blocks(pages: DataFrame) -> DataFrame:
    """doc, block, label, amount: lines in sequence over all pages, a block ends at its net amount."""
    lines = dealt_by_doc(pages).select("doc", "file", "page_no", F.explode_outer(labelled_lines(F.split("text", r"\r?\n"))).alias("x")).where("x is not null")
    lines = lines.select("doc", F.struct("file", "page_no", F.col("x.k").alias("line_no")).alias("pos"), "x.label", "x.amount")
    return block_amounts(lines, ["doc"], "pos", "label", "amount", NET)


def anchored_blocks(pages: DataFrame) -> DataFrame:
    """doc, block_key, date, label, amount: windows of lines around net and sales lines, cropped and without repeats.

    Windows reach into the first 800 characters of the next page; equal blocks of a document count once.
    """
    head = F.lead(F.left("text", F.lit(800))).over(Window.partitionBy("doc", "file").orderBy("page_no"))
    both = dealt_by_doc(pages).select("doc", "file", "page_no", F.split(F.concat_ws("\n", "text", head), r"\r?\n").alias("lines"))
    # A page's windows are made and read within its row; only blocks that have amounts become rows.
    numbered = F.filter(F.transform("lines", lambda x, k: F.struct(k.alias("line_no"), x.alias("line"))), lambda x: F.trim(x["line"]) != "")
    both = both.select("doc", "file", "page_no", numbered.alias("lines")).select("*", F.transform("lines", lambda x: x["line"]).alias("texts"))

    def windows(kind: int, anchor: str, before: int, after_: int) -> Column:
        around = lambda i: F.slice("texts", F.greatest(i + 1 - before, F.lit(1)), F.least(i, F.lit(before)) + 1 + after_)
        window = lambda x, i: once(around(i), lambda w: F.struct(F.lit(kind).alias("kind"), x["line_no"].alias("line_no"), w.alias("window"), F.array_join(w, "\n").alias("block")))
        return F.filter(F.transform("lines", lambda x, i: F.when(x["line"].rlike(anchor), window(x, i))), lambda w: w.isNotNull())

    found = both.select("doc", "file", "page_no", F.concat(windows(0, NET_LINE, 12, 2), windows(1, SALES_LINE, 2, 9)).alias("w"))
    found = found.select("*", F.transform("w", lambda w: F.left(w["block"], F.lit(200))).alias("starts"))
    first = F.filter("w", lambda w, i: F.array_position("starts", F.left(w["block"], F.lit(200))) == i + 1)

    def concepts(window: Column) -> Column:
        cut = crop(F.transform(window, lambda x: F.trim(x)), SALES_LINE, NET_LINE)
        amounts = labelled_lines(F.filter(cut, lambda x: F.contains(x, F.lit("$"))))
        last = once(amounts, lambda every: F.filter(every, lambda x, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda y: y["label"] == x["label"])))
        return F.array_sort(F.transform(last, lambda x: F.struct(x["label"].alias("label"), x["amount"].alias("amount"))))

    blocks = F.transform(first, lambda w: F.struct(w["kind"].alias("kind"), w["line_no"].alias("line_no"), block_date(w["block"]).alias("date"), concepts(w["window"]).alias("concepts")))
    blocks = found.select("doc", "file", "page_no", F.explode_outer(F.filter(blocks, lambda x: F.size(x["concepts"]) > 0)).alias("b")).where("b is not null")
    blocks = blocks.select("doc", F.struct("file", "page_no", "b.line_no").alias("pos"), "b.kind", "b.date", "b.concepts")
    one = keep_first(blocks, ["doc", "concepts"], ["pos", "kind"])
    return one.select("doc", F.xxhash64("concepts").alias("block_key"), "date", F.explode("concepts").alias("c")).select("doc", "block_key", "date", "c.label", "c.amount")


def patagonia_breakdown(pages: DataFrame) -> DataFrame:
    """doc, k, label, amount of the discounts section; a line that only says ``%`` bears the last section's label."""
    text = pages.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "page_no", "text"))), lambda p: p["text"]), "\n").alias("text"))
    section = text.select("doc", after(F.col("text"), "DESGLOSE DE DESCUENTOS", 2000, "____").alias("section")).where("section is not null")
    lines = section.select("doc", F.posexplode(F.split("section", r"\r?\n")).alias("k", "line"))
    title = section_label(F.col("line"))
    lines = carry_forward(lines, ["doc"], ["k"], F.when(~F.contains("line", F.lit("$")) & (title != "") & ~title.startswith("DESGLOSE"), title), "pending")
    rows = lines.where(F.contains("line", F.lit("$")) & ~F.contains(F.upper("line"), F.lit("U$S"))).withColumn("amount", parse_zero(last_number(F.col("line")))).where("amount > 0")
    own = clean_label(F.col("line"))
    pending = F.coalesce("pending", F.lit(""))
    label = F.when(own.isin("%", "TASA %") & (pending != ""), pending).when(own.startswith("TASA") & (pending != ""), F.concat_ws(" - ", "pending", own)).otherwise(own)
    rows = rows.select("doc", "k", label.alias("label"), "amount").where("label not in ('', '%', 'TASA %')")
    covered = F.contains("label", F.lit("ARANCEL TJ.C")) | F.contains("label", F.lit("ARANCEL TJ.D")) | F.contains("label", F.lit("CARGO POR SERVICIO"))
    return drop_covered(rows, ["doc"], F.contains("label", F.lit("BASE IMPONIBLE IVA")), covered)


def answer_categories(answers: DataFrame) -> DataFrame:
    """doc, category, amount of a model's CONCEPTO|IMPORTE lines; a later line of a category replaces an earlier one."""
    lines = answers.select("doc", F.posexplode(F.split("text", r"\r?\n")).alias("k", "line")).where(~is_noise(F.col("line")))
    rows = lines.withColumn("p", split_pipe(F.col("line"))).where("p is not null and upper(p.concept) not in ('CONCEPTO', 'TIPO', 'TIPOCONCEPTOIA') and upper(p.total) not in ('TOTAL', 'IMPORTE')")
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("doc").orderBy("k")))
    rows = rows.select("doc", "k", "row", "p", classify_concept(F.col("p.concept")).alias("own"))
    category = positional_category(F.col("own"), F.col("p.concept"), F.col("row"))
    return last_per_category(rows.select("doc", "k", category.alias("category"), parse_zero(F.col("p.total")).alias("amount")), ["doc"], "category", "amount", "k")


def ledger(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """doc, ord, category (or label), amount.

    Patagonia's breakdown comes first, then Nación's blocks, then page sums and header amounts over the model's categories; these
    close to zero through OTROS. What several branches use is written once, below the shared folder, so that the plan doesn't repeat it.
    """
    facts, _ = written(document_facts(pages), "facts")
    own_pages = lambda flag: pages.join(facts.where(flag).select("doc"), "doc", "left_semi")
    breakdown, _ = written(patagonia_breakdown(own_pages("patagonia")).join(facts.where("patagonia").select("doc", "total_header", "balance"), "doc"), "breakdown")
    ends = breakdown.groupBy("doc").agg(F.first("total_header").alias("t"), F.first("balance").alias("b"))
    first = ends.where("t is not null").select("doc", F.lit(-1).alias("ord"), F.lit("TOTAL PRESENTADO").alias("category"), F.col("t").cast(MONEY).alias("amount"))
    last = ends.where("b is not null").select("doc", F.lit(1 << 20).alias("ord"), F.lit("SALDO").alias("category"), (-F.abs("b")).cast(MONEY).alias("amount"))
    patagonia = breakdown.select("doc", F.col("k").alias("ord"), F.col("label").alias("category"), (-F.abs("amount")).cast(MONEY).alias("amount")).unionByName(first).unionByName(last)
    done = ends.select("doc")

    blocks = sequential_blocks(own_pages("nacion")).join(facts.where("nacion").select("doc", "total_header", "net_header"), "doc").join(done, "doc", "left_anti")
    w = Window.partitionBy("doc", "block")
    of = lambda label: F.max(F.when(F.col("label") == label, F.col("amount"))).over(w)
    lead = F.row_number().over(w.orderBy("label")) == 1
    wide = blocks.withColumn("s", of(SALES)).withColumn("n", of(NET)).withColumn("_lead", lead)
    wide = wide.withColumn("s1", F.when(F.col("_lead"), F.col("s"))).withColumn("n1", F.when(F.col("_lead"), F.col("n")))
    heads = complete_or_all(wide.where("_lead"), ["doc"], "s", "n", "total_header", "net_header").select("doc", "block")
    labels = wide.join(heads, ["doc", "block"], "left_semi").groupBy("doc", "label").agg(F.sum(F.col("amount").cast(MONEY)).cast(MONEY).alias("amount"), F.first("net_header").alias("net_header"))
    labels, _ = written(honour_net(labels, ["doc"], "net_header"), "labels")
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEDGER_ORDER)), F.col("label")), F.lit(0)), F.lit(999))
    nacion = labels.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy(place, "label")).alias("ord"), F.col("label").alias("category"), F.when(F.contains("label", F.lit("VENTAS")), F.abs("amount")).otherwise(-F.abs("amount")).cast(MONEY).alias("amount"))
    done = done.unionByName(labels.select("doc").distinct())

    rest = facts.join(done, "doc", "left_anti").withColumn("vat", F.when(F.col("has_daily"), vat_or_theory(F.col("fees"), F.col("vat"))).otherwise(F.col("vat")))
    charges = F.col("fees") + F.col("vat") + F.col("ret_iva") + F.col("ret_iibb") + F.col("ret_gan")
    found = {
        "TARJETA": F.coalesce(F.when(F.col("sales") > 0, F.col("sales")), F.col("total_header")),
        "BANCO": F.coalesce(F.when(F.col("net") > 0, F.col("net")), F.when((F.col("sales") > 0) & (charges > 0), F.col("sales") - charges), F.col("net_header")),
        **{c: F.when(F.col(n) > 0, F.col(n)) for c, n in (("GASTO", "fees"), ("IVA_CREDITO", "vat"), ("RET_IVA", "ret_iva"), ("RET_IIBB", "ret_iibb"), ("RET_GAN", "ret_gan"))},
    }
    own = rest.select("doc", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), v.alias("found")) for c, v in found.items()])).alias("x")).select("doc", "x.category", "x.found")
    model = answer_categories(answers)
    both = own.join(model, ["doc", "category"], "left").select("doc", "category", F.coalesce("found", "amount", F.lit(0.0)).alias("amount"))
    signs = both.select("doc", "category", F.when(F.col("category") == "TARJETA", F.abs("amount")).otherwise(-F.abs("amount")).cast(MONEY).alias("amount"))
    closed = filled_categories(with_residual(signs, ["doc"]), ["doc"], CARD_CATEGORIES)
    return patagonia.unionByName(nacion).unionByName(closed.select("doc", "ord", "category", "amount"))


def header_lines(facts: DataFrame) -> DataFrame:
    """doc and header: bank, card, period as a date, and the concept of the ledger."""
    bank, card = F.coalesce("bank_name", F.lit("")), F.trim(F.coalesce("card_name", F.lit("")))
    short_bank = F.when(bank.rlike(r"(?i)BANCO\s+DE\s+LA\s+NACION\s+ARGENTINA"), "BANCO NACION").otherwise(F.trim(bank))
    short_card = F.coalesce(F.nullif(F.trim(F.replace(card, F.lit("TARJETA DE "), F.lit(""))), F.lit("")), card)
    period = F.coalesce(period_to_date(F.col("period")), F.lit(""))
    return facts.select("doc", document_header("LIQ", bank, card, period, short_bank, short_card).alias("header"))


def daily_sheet(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """The control sheet of documents of Banco Nación: a row for each block, and a TOTAL row of each doc (``block`` null), with
    SHEET_ORDER's columns, the sum of charges and the check."""
    blocks = sequential_blocks(pages).join(facts.where("nacion").select("doc"), "doc", "left_semi")
    return control_sheet(blocks, ["doc", "block"], "label", "amount", SHEET_ORDER, by=["doc"])
