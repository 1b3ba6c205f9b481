"""Classification: rule books, the fixed concept classifier, labels, banks and cards."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import once
from ..functions.text import fold_header, norm_text, norm_upper
from .matching import first_category

#: Fixed: categories of the two ledgers, in the order they are printed.
BANK_CATEGORIES = ["BANCO", "GASTO", "NETO GRAVADO POR AJUSTE IVA", "IDC_A_COMPUTAR", "IVA_CREDITO", "RET_IVA", "RET_IIBB", "RET_GAN", "OTROS"]
CARD_CATEGORIES = ["TARJETA", "BANCO", "GASTO", "IVA_CREDITO", "RET_IVA", "RET_IIBB", "RET_GAN", "OTROS"]

#: Fixed: the default rule book, (pattern, category) in order, and the concepts that are left out, by bank.
DEFAULT_RULES = [
    (r"GRAVAMEN LEY 25413|IMP\.DB/CR", "IDC_A_COMPUTAR"),
    (r"GRAVAMEN IBRN|IMPUESTO RIONEGRINO|ING\.? ?BRUT|SIRCREB|RET\.?IIBB", "RET_IIBB"),
    (r"COMISION|COMIS|^COM\b|INTERES|INTERESES|ARANCEL|GASTO BANC", "GASTO"),
    (r"IVA PERCEPCION|PERCEPCION IVA|RETEN IVA|RET\.IVA|RG ?2408", "RET_IVA"),
    (r"IVA BASE|IVA ALICUOTA|IVA ", "IVA_CREDITO"),
    (r"RETENCION GANAN|RET\.?GAN", "RET_GAN"),
]
DEFAULT_EXCLUSIONS = {
    "BNA": ["TRANSFER", "DEBIN", "DEPOSITO", "PAGO DIRECTO", "TODOCARD", "MASTERCARD", "VISA", "CREDITO POR TRANSFERENCIA"],
    "BPAT": ["TRANSFER", "PAGO CON TRANSFERENCIA", "PAGOS AFIP", "DEPOSITO", "TODOCARD", "TARJETA CREDITO", "DEBITO P/ACREDITAC.DE SUELDOS"],
}


def rule_book(spark: SparkSession, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(bank, mode, pattern, category) in order, as rows with ``ord``; blank patterns go, the mode is ``contains`` and the category
    OTROS by default."""
    kept = [(bank, k, (mode or "contains").lower(), pattern.strip(), (category or "OTROS").upper()) for k, (bank, mode, pattern, category) in enumerate(rules) if pattern and pattern.strip()]
    return spark.createDataFrame(kept, "bank string, ord int, mode string, pattern string, category string")


def default_rules(spark: SparkSession) -> DataFrame:
    return rule_book(spark, [(bank, "regex", pattern, category) for bank in DEFAULT_EXCLUSIONS for pattern, category in DEFAULT_RULES])


def read_rules(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rules and exclusions (bank, pattern) of a JSON rule book; the default one without a path."""
    if path is None:
        out = [(bank, p) for bank, patterns in DEFAULT_EXCLUSIONS.items() for p in patterns]
        return default_rules(spark), spark.createDataFrame(out, "bank string, pattern string")
    book = json.loads(spark.read.text(path, wholetext=True).first()[0])["banks"]  # one small file
    rules = [(bank, r.get("mode"), r.get("match", ""), r.get("category")) for bank, b in book.items() for r in b.get("rules", [])]
    out = [(bank, p) for bank, b in book.items() for p in b.get("exclusions", []) if p.strip()]
    return rule_book(spark, rules), spark.createDataFrame(out, "bank string, pattern string")


#: A perception of VAT is settled before any rule.
def is_vat_perception(concept: Column) -> Column:
    t = norm_text(concept)
    return F.contains(t, F.lit("IVA PERCEPCION")) | F.contains(t, F.lit("PERCEPCION IVA"))


def first_match_case(concept: Column, rules: list[tuple[str, str]] = DEFAULT_RULES) -> Column:
    """Category by ordered regular expressions on the raw text, as one CASE; null where none matches."""
    case = F.when(is_vat_perception(concept), "RET_IVA")
    for pattern, category in rules:
        case = case.when(concept.rlike(f"(?iu){pattern}"), category)
    return case


#: A book is sent to all tasks up to so many bytes of patterns, counted before; a larger one is joined.
BOOK_BYTES = 32 << 20
#: Texts whose parts a task makes, where a book is joined.
TASK_TEXTS = 20_000


def _shared_book(rows: DataFrame, book: DataFrame):
    """(bank, mode, pattern, category) in order, as a broadcast; null where the book is too large."""
    size = book.agg(F.sum(F.length("_pattern") + F.coalesce(F.length("_category"), F.lit(0)) + 100)).first()[0] or 0
    if size > BOOK_BYTES:
        return None
    entries = book.orderBy("_ord").select("_bank", "_mode", F.when(F.col("_mode") == "contains", norm_text(F.col("_pattern"))).otherwise(F.col("_pattern")), "_category").collect()
    return rows.sparkSession.sparkContext.broadcast([tuple(r) for r in entries])


def first_match_join(rows: DataFrame, concept: str, rules: DataFrame, bank: str | None = None) -> DataFrame:
    """``rows`` with ``category`` from a rule book of rows: the least ``ord`` that matches wins, null where none does.

    The book goes to all tasks as an automaton, so rows aren't shuffled and meet only the rules they may match; its regular
    expressions are Python's. A book of more than BOOK_BYTES is joined to the distinct concepts instead, with Spark's expressions.
    """
    book = rules.select((F.col("bank") if bank else F.lit(None).cast("string")).alias("_bank"), F.col("ord").alias("_ord"), F.col("mode").alias("_mode"), F.col("pattern").alias("_pattern"), F.col("category").alias("_category"))
    shared = _shared_book(rows, book)
    vat = F.when(is_vat_perception(F.col(concept)), "RET_IVA")
    if shared is not None:
        found = first_category(shared, F.col(bank) if bank else F.lit(None).cast("string"), F.col(concept), norm_text(F.col(concept)))
        return rows.withColumn("category", F.coalesce(vat, found))
    keys = ([bank] if bank else []) + [concept]
    distinct = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    text = F.col(f"_k{len(keys) - 1}")
    hits, regexes = _contained(distinct, book, bank), book.where("_mode = 'regex'")
    if not regexes.isEmpty():
        hit = F.regexp_like(text, F.concat(F.lit("(?iu)"), F.col("_pattern")))
        hits = hits.unionByName(distinct.join(regexes, hit & (F.col("_k0") == F.col("_bank")) if bank else hit).select(*hits.columns))
    found = hits.groupBy(*distinct.columns).agg(F.min_by("_category", "_ord").alias("_rule"))
    joined = rows.join(found, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left").drop(*distinct.columns)
    return joined.withColumn("category", F.coalesce(vat, "_rule")).drop("_rule")


def _contained(texts: DataFrame, book: DataFrame, bank: str | None) -> DataFrame:
    """``texts`` (the last column is the concept, the first its bank where there is one) with _ord and _category of the patterns that
    they contain: their parts of all lengths that patterns have are joined to the patterns, so no text meets every pattern."""
    by = ["_bank", "_part"] if bank else ["_part"]
    patterns = book.where("_mode = 'contains'").withColumn("_part", norm_text(F.col("_pattern"))).groupBy(*by).agg(F.min_by("_category", "_ord").alias("_category"), F.min("_ord").alias("_ord"))
    lengths = [r[0] for r in patterns.select(F.length("_part")).distinct().collect()]  # as many as the longest pattern has letters
    normal = texts.repartition(texts.count() // TASK_TEXTS + 1, *texts.columns).withColumn("_norm", norm_text(F.col(texts.columns[-1])))
    size, fitting = F.length("_norm"), F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_norm"))
    parts = F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda k: F.substr(F.col("_norm"), k, n)))
    long = normal.select(*texts.columns, F.explode(F.array_distinct(F.flatten(parts))).alias("_part"))
    long = long.withColumn("_bank", F.col("_k0")) if bank else long
    return long.join(patterns, by).select(*texts.columns, "_ord", "_category")


def without_excluded(rows: DataFrame, concept: str, exclusions: DataFrame, bank: str | None = None) -> DataFrame:
    """Rows whose normalized concept contains no exclusion (of its bank). The exclusions go to all tasks as an automaton; more than
    BOOK_BYTES of them are joined to the distinct concepts instead."""
    book = exclusions.select((F.col("bank") if bank else F.lit(None).cast("string")).alias("_bank"), F.lit(0).alias("_ord"), F.lit("contains").alias("_mode"), F.col("pattern").alias("_pattern"), F.lit("out").alias("_category"))
    shared = _shared_book(rows, book)
    if shared is not None:
        found = first_category(shared, F.col(bank) if bank else F.lit(None).cast("string"), F.col(concept), norm_text(F.col(concept)))
        return rows.where(found.isNull())
    keys = ([bank] if bank else []) + [concept]
    names = [f"_k{i}" for i in range(len(keys))]
    distinct = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).distinct()
    out = _contained(distinct, book, bank).select(*names).distinct()
    return rows.join(out, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], "left_anti")


def clamp_category(category: Column, known: list[str]) -> Column:
    return F.when(category.isin(known), category).otherwise("OTROS")


def classify_concept(concept: Column) -> Column:
    """Category of a settlement's concept, by ordered tests on its text."""
    t = norm_upper(concept)
    has = lambda *words: _any(t, words)
    return (
        F.when(has("RET_GAN"), "RET_GAN")
        .when(has("RET_IIBB"), "RET_IIBB")
        .when(has("RET_IVA"), "RET_IVA")
        .when(has("IVA_CREDITO"), "IVA_CREDITO")
        .when(has("BANCO", "ACREDITADO", "LIQUIDADO", "NETO DE PAGOS", "NETO A COBRAR", "A DEPOSITAR"), "BANCO")
        .when(has("ARANCEL", "COMISION", "CARGO"), "GASTO")
        .when(has("IMPUESTO") & ~has("IVA", "GANANCIAS", "IIBB", "INGRESOS"), "GASTO")
        .when(has("GASTO", "COMISION") & ~has("IVA", "CREDITO"), "GASTO")
        .when(has("IVA") & has("ARANCEL", "COMISION", "GASTO"), "IVA_CREDITO")
        .when((has("IVA") & has("RET", "PERCEP")) | has("R.G. 2408", "RG 2408"), "RET_IVA")
        .when(has("INGRESOS", "IIBB", "SIRTAC", "ING.BRUTOS", "ING. BRUTOS", "ING BRUTOS"), "RET_IIBB")
        .when(has("GANANCIAS", "RG 830") | (has("RET") & has("GAN")), "RET_GAN")
        .when(has("CRED.FISC", "CRED FISC") | (has("IVA") & has("CREDITO")) | (has("IVA") & has("CRED") & has("FISC")), "IVA_CREDITO")
        .when(has("TARJETA") & ~has("IVA"), "TARJETA")
        .otherwise("OTROS")
    )


def _any(text: Column, words) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def positional_category(category: Column, concept: Column, row: Column) -> Column:
    """Rows that only say OTRO, OTROS or OTHER are classed by their place; a first row that is unknown is the card's."""
    by_place = F.try_element_at(F.array(*map(F.lit, CARD_CATEGORIES)), row.cast("int"))
    only = norm_text(concept).isin("OTRO", "OTROS", "OTHER")
    placed = F.when((category == "OTROS") & only & row.between(1, len(CARD_CATEGORIES)), by_place).otherwise(category)
    return F.when((row == 1) & (placed == "OTROS"), "TARJETA").otherwise(placed)


#: Fixed: labels of a settlement's lines; what a line contains, and its label. ARANCEL comes before the VAT on it.
SALES, NET = "VENTAS C/DESCUENTO CONTADO", "IMPORTE NETO DE PAGOS"
LINE_LABELS = [
    ("VENTAS C/DESCUENTO CONTADO", SALES),
    ("ARANCEL", "ARANCEL"),
    ("IVA CRED.FISC.COMERCIO S/ARANC", "IVA CRED.FISC.COMERCIO S/ARANC 21,00%"),
    ("IVA RI SERV.OPER. INT", "IVA RI SERV.OPER. INT."),
    ("SERVICIO OPER. INTERNAC", "SERVICIO OPER. INTERNAC."),
    ("SERV.OPER. INT", "SERVICIO OPER. INTERNAC."),
    ("RETENCION ING.BRUTOS SIRTAC", "RETENCION ING.BRUTOS SIRTAC"),
    ("PERCEPCION IVA R.G. 2408", "PERCEPCION IVA R.G. 2408 3,00 %"),
    ("QR PERCEPCION IVA 3337", "QR PERCEPCION IVA 3337"),
    ("QR RETENCION IIBB RIO NEGRO", "QR RETENCION IIBB RIO NEGRO"),
    ("IMPORTE NETO DE PAGOS", NET),
]
#: Fixed: order of a ledger's lines, and of a control sheet's columns.
LEDGER_ORDER = [SALES, "ARANCEL", "IVA CRED.FISC.COMERCIO S/ARANC 21,00%", "RETENCION ING.BRUTOS SIRTAC", "PERCEPCION IVA R.G. 2408 3,00 %", "RETENCION IVA", "RETENCION GANANCIAS", NET]
SHEET_ORDER = [x for x in LEDGER_ORDER if x != "RETENCION IVA"]


def line_label(line: Column) -> Column:
    """Canonical label of a settlement's line, null without one."""

    def label_of(t: Column) -> Column:
        case = F
        for word, label in LINE_LABELS:
            case = case.when(F.contains(t, F.lit(word)), label)
        return case

    return once(F.trim(F.regexp_replace(F.upper(line), r"\s+", " ")), label_of)


#: Fixed: card brands, by what a text has as a word, or a file name at all.
BRANDS = [("CABAL", r"\bCABAL\b", ["CABAL"]), ("AMEX", r"\bAMEX\b|\bAMERICAN\s+EXPRESS\b", ["AMEX", "AMERICAN"]), ("MASTERCARD", r"\bMASTERCARD\b|\bMASTER\b", ["MASTER"]), ("VISA", r"\bVISA\b", ["VISA"]), ("NARANJA", r"\bNARANJA\b", ["NARANJA"])]


def card_of_text(text: Column) -> Column:
    case = F
    for brand, pattern, _ in BRANDS:
        case = case.when(F.upper(text).rlike(pattern), f"TARJETA {brand}")
    return case


def card_of_name(name: Column) -> Column:
    case = F
    for brand, _, words in BRANDS:
        case = case.when(_any(F.upper(name), words), f"TARJETA {brand}")
    return case


GENERIC_CARD = r"(?iu)^\s*TARJETA\s+DE\s+(?:DEBITO|CR[EÉ]DITO)(?:\s+.*)?\s*$"


def is_generic_card(card: Column) -> Column:
    return F.coalesce(card.rlike(GENERIC_CARD), F.lit(False))


def card_phrase(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?iu)\bTARJETA\s+DE\s+(?:DEBITO|CR[EÉ]DITO)[^\n]{0,30}\b", 0)
    return F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def is_nacion(text: Column) -> Column:
    return text.rlike(r"(?i)\bBCO\s+DE\s+LA\s+NACION\s+ARGENTINA\b|\bBANCO\s+NACION\b")


def is_patagonia(text: Column) -> Column:
    return text.rlike(r"(?i)\bBANCO\s+PATAGONIA\b")


def paying_bank(text: Column) -> Column:
    named = F.nullif(F.trim(F.regexp_extract(text, r"(?i)Entidad\s+Pagadora\s*\n([A-Z0-9 .]+)", 1)), F.lit(""))
    return F.coalesce(named, F.when(text.rlike(r"(?i)\bBANCO\s+DE\s+LA\s+NACION\s+ARGENTINA\b"), "BANCO DE LA NACION ARGENTINA"))


def bank_of_name(name: Column) -> Column:
    t = norm_text(name)
    return F.when(_any(t, ["NACION", "BNA"]), "BNA").when(_any(t, ["PATAGONIA", "BPAT"]), "BPAT")


def bank_label(name: Column) -> Column:
    t = norm_text(name)
    return F.when(F.contains(t, F.lit("NACION")), "BANCO NACION").when(F.contains(t, F.lit("PATAGONIA")), "BANCO PATAGONIA").when(t.startswith("BANCO "), t).otherwise(F.trim(F.concat(F.lit("BANCO "), t)))


def route_task(kind: Column, automatic: Column) -> Column:
    """Task of a file by its folder, for automatic runs; else as it is."""
    return F.when(automatic & (kind == "tarjetas"), "AUTOMATICO_LIQUIDACION").when(automatic & (kind == "compras"), "AUTOMATICO_FACTURA").otherwise(F.lit("MANUAL"))


#: Fixed: detail columns of a voucher, in the order in which they are tried: what a title contains, and what it is as a whole.
DETAIL_COLUMNS = [
    ("Cantidad", ["cant"], []),
    ("Codigo_Articulo", ["artic", "cod", "producto"], []),
    ("Descripcion", ["descripcion"], ["desc"]),
    ("UD", [], ["ud", "unidad", "u."]),
    ("% Dto", ["dto", "descuento", "%"], []),
    ("Importe_Lista", ["lista"], []),
    ("Importe_Neto", ["neto", "precio"], []),
    ("IVA", ["iva"], []),
    ("Impuestos internos", ["impuestos internos", "imp internos"], []),
    ("Bl/Pq", ["bl/pq", "bulto"], []),
    ("Moneda", ["moneda"], []),
    ("Total", ["total"], []),
    ("AuxNroLote", ["lote"], []),
    ("AuxNroSerie", ["serie"], []),
]


def detail_columns(titles: Column) -> Column:
    """Canonical columns for an array of titles; the first discount is % Dto1, all later ones % Dto2; unknown titles go."""
    def named(t):
        case = F
        for name, parts, wholes in DETAIL_COLUMNS:
            tests = ([_any(t, parts)] if parts else []) + ([t.isin(wholes)] if wholes else [])
            case = case.when(tests[0] if len(tests) == 1 else tests[0] | tests[1], name)
        return case

    def numbered(found):
        first = F.array_position(found, "% Dto") - 1
        return once(first, lambda at: F.transform(found, lambda x, i: F.when(x != "% Dto", x).when(i == at, "% Dto1").otherwise("% Dto2")))

    # Titles are folded once, before their many tests, and named once, before discounts are counted.
    found = F.filter(F.transform(F.transform(titles, fold_header), named), lambda x: x.isNotNull())
    return F.array_distinct(once(found, numbered))


def auto_tuning(pages: Column, kind: str) -> Column:
    """How many tiles, images and pages one request takes, by the number of pages."""
    cuts = (1, 3) if kind == "invoice" else (2, 8)
    chunk = (0, 0, 0) if kind == "invoice" else (0, 4, 5)
    make = lambda n, c: F.struct(F.lit(n).alias("tiles"), F.lit(c).alias("chunk"))
    return F.when(pages <= cuts[0], make(3, chunk[0])).when(pages <= cuts[1], make(4, chunk[1])).otherwise(make(5, chunk[2]))


def asks_by_page(pages: Column, kind: str) -> Column:
    """Whether a document of so many pages (an invoice of so many files) is asked for page by page."""
    return pages > (1 if kind == "invoice" else 2)
