"""Queries of the operators on the driver's tables, each with the SQL that DuckDB runs on them.

Amounts are summed as decimals, which doesn't depend on the order, and returned as doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates, jsontext, numbers, text
from .operators import classify, frames, ingest, ledger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Rules of these queries: a part's name or type, and the ledger category it stands for.
PART_RULES = [("widget|gadget", "GASTO"), ("bolt", "IVA_CREDITO"), ("gear", "RET_IVA"), ("ring", "RET_IIBB"), ("^small", "RET_GAN")]
CATEGORY_SQL = "CASE WHEN regexp_matches(p_name,'widget|gadget') THEN 'GASTO' WHEN regexp_matches(p_name,'bolt') THEN 'IVA_CREDITO' WHEN regexp_matches(p_name,'gear') THEN 'RET_IVA' WHEN regexp_matches(p_name,'ring') THEN 'RET_IIBB' WHEN regexp_matches(p_name,'^small') THEN 'RET_GAN' END"
CATEGORIES = ["BANCO", "GASTO", "IVA_CREDITO", "RET_IVA", "RET_IIBB", "RET_GAN", "OTROS"]
KINDS = ["signup", "purchase", "error", "click", "view"]
CARRIED = "decimal(18,2)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doubled(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(f"`{n}`").cast("double") for n in names})


# --- ledgers -----------------------------------------------------------------------------------------------------------------

@query(f"""
WITH t AS (SELECT coalesce({CATEGORY_SQL}, 'OTROS') AS category, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
s AS (SELECT category, -amount AS amount FROM t UNION ALL SELECT 'BANCO', sum(amount) FROM t),
d AS (SELECT unnest(['BANCO','GASTO','IVA_CREDITO','RET_IVA','RET_IIBB','RET_GAN','OTROS']) AS category, unnest(range(0, 7)) AS ord)
SELECT CAST(ord AS INTEGER) AS ord, category, CAST(coalesce(amount, 0) AS DOUBLE) AS amount FROM d LEFT JOIN s USING (category)""")
def ledger_contra_entry(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.coalesce(classify.first_match_case(F.col("p_name"), PART_RULES), F.lit("OTROS")).alias("category"))
    # Summed by part before the join, so the join sees a row for each part.
    lines = ledger.sums_by(read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("amount")), ["l_partkey"])
    totals = lines.join(part, lines.l_partkey == part.p_partkey).groupBy("category").agg((-F.sum("amount")).cast(CARRIED).alias("amount"))
    done = ledger.filled_categories(ledger.with_contra(totals, [], "BANCO"), [], CATEGORIES)
    return _doubled(done.select("ord", "category", "amount"), "amount")


_RULES_SQL = f"SELECT p_partkey, {CATEGORY_SQL} AS category FROM part"


@query(_RULES_SQL)
def rule_first_match_case(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", classify.first_match_case(F.col("p_name"), PART_RULES).alias("category"))


@query(_RULES_SQL)
def rule_first_match_join(spark, sf_dir):
    rules = classify.rule_book(spark, [("all", "regex", p, c) for p, c in PART_RULES])
    return classify.first_match_join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", rules).select("p_partkey", "category")


_MANY_SQL = "SELECT p_partkey, p_name || ' N' || p_partkey AS concept FROM part"


@query(f"""
WITH t AS ({_MANY_SQL}),
r AS (SELECT p_partkey * 5 + s AS ord, trim(substr(concept, CAST(1 + s * 2 + p_partkey % 7 AS BIGINT), 3 + (p_partkey + s) % 5)) AS pattern, 'C' || p_partkey % 97 AS category FROM t, range(5) AS s(s)),
d AS (SELECT pattern, min(ord) AS ord, arg_min(category, ord) AS category FROM r WHERE pattern <> '' GROUP BY 1)
SELECT p_partkey, arg_min(category, ord) AS category FROM t JOIN d ON contains(upper(concept), upper(pattern)) GROUP BY 1""")
def rules_by_the_thousand(spark, sf_dir):
    """Five rules for each part, all tried on the names of all parts."""
    concept = F.concat("p_name", F.lit(" N"), "p_partkey")
    parts = read(spark, sf_dir, "part").select("p_partkey", concept.alias("concept"))
    made = parts.select("p_partkey", "concept", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("s"))
    pattern = F.substring("concept", (1 + F.col("s") * 2 + F.col("p_partkey") % 7).cast("int"), (3 + (F.col("p_partkey") + F.col("s")) % 5).cast("int"))
    rules = made.select(F.lit("all").alias("bank"), (F.col("p_partkey") * 5 + F.col("s")).alias("ord"), F.lit("contains").alias("mode"), F.trim(pattern).alias("pattern"), F.concat(F.lit("C"), F.col("p_partkey") % 97).alias("category")).where("pattern <> ''")
    return classify.first_match_join(parts, "concept", rules).where("category is not null").select("p_partkey", "category")


@query("SELECT p_partkey, p_name FROM part WHERE NOT contains(upper(p_name), 'RED') AND NOT contains(upper(p_name), 'HOT GEAR')")
def exclusion_anti(spark, sf_dir):
    out = spark.createDataFrame([("all", "red"), ("all", "Hot  Gear")], "bank string, pattern string")
    return classify.without_excluded(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", out)


@query(f"SELECT p_name, count(*) AS n FROM part WHERE ({CATEGORY_SQL}) IS NULL GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20")
def unmatched_top20(spark, sf_dir):
    rows = read(spark, sf_dir, "part").where(classify.first_match_case(F.col("p_name"), PART_RULES).isNull())
    return ledger.top_unknown(rows, ["p_name"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem GROUP BY 1, 2 ORDER BY abs(amount) DESC, 1, 2")
def concept_control(spark, sf_dir):
    return _doubled(ledger.concept_control(read(spark, sf_dir, "lineitem").withColumn("amount", F.col("l_extendedprice")), ["l_returnflag", "l_linestatus"]), "amount")


@query("""
WITH s AS (SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS base, CAST(sum(CAST(l_extendedprice * 0.2 AS DECIMAL(18,2))) AS DOUBLE) AS vat FROM lineitem GROUP BY 1),
a AS (SELECT *, round(base * 0.21, 2) AS vat_theory, CASE WHEN vat > 0 THEN CASE WHEN abs(round(vat / 0.21 - base, 2)) < 0.01 THEN 0 ELSE round(vat / 0.21 - base, 2) END ELSE 0 END AS base_adjustment FROM s)
SELECT l_returnflag, base, vat, vat_theory, round(vat - vat_theory, 2) AS vat_diff, base_adjustment, round(base + base_adjustment, 2) AS base_adjusted,
round((base + base_adjustment) * 0.21, 2) AS vat_adjusted, round(vat - round((base + base_adjustment) * 0.21, 2), 2) AS vat_diff_adjusted, abs(vat - vat_theory) > 1 AS alert FROM a""")
def vat_control(spark, sf_dir):
    price = F.col("l_extendedprice")
    s = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(numbers.money(price)).cast("double").alias("base"), F.sum(numbers.money(price * 0.2)).cast("double").alias("vat"))
    return s.select("*", *[c.cast("double").alias(n) if n != "alert" else c.alias(n) for n, c in numbers.vat_control(F.col("base"), F.col("vat")).items()])


@query("""
WITH t AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'TARJETA' WHEN 'O' THEN 'BANCO' ELSE 'GASTO' END AS category, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount FROM orders GROUP BY 1),
s AS (SELECT category, CASE WHEN category = 'TARJETA' THEN amount ELSE -amount END AS amount FROM t)
SELECT category, CAST(amount AS DOUBLE) AS amount FROM s UNION ALL SELECT 'OTROS', CAST(CASE WHEN abs(sum(amount)) < 0.01 THEN 0 ELSE -sum(amount) END AS DOUBLE) FROM s""")
def residual_entry(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "TARJETA").when(F.col("o_orderstatus") == "O", "BANCO").otherwise("GASTO")
    totals = ledger.sums_by(read(spark, sf_dir, "orders").select(kind.alias("category"), F.col("o_totalprice").alias("amount")), ["category"])
    signs = totals.select("category", numbers.ledger_sign(F.col("category"), F.col("amount")).cast(CARRIED).alias("amount"))
    return _doubled(ledger.with_residual(signs, []).select("category", "amount"), "amount")


@query("SELECT event_type, CAST(sum(CAST(CASE WHEN event_type = 'view' THEN value WHEN event_type IN ('error','signup') THEN -abs(value) WHEN event_type = 'purchase' THEN abs(value) ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM events GROUP BY 1")
def signed_debit_credit(spark, sf_dir):
    only = lambda *k: F.when(F.col("event_type").isin(*k), F.col("value"))
    signed = numbers.signed_amount(only("view"), only("error", "signup"), only("purchase"))
    return _doubled(ledger.sums_by(read(spark, sf_dir, "events").select("event_type", signed.alias("amount")), ["event_type"]), "amount")


@query("""
WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2),
w AS (SELECT day, coalesce(sum(v) FILTER (event_type='signup'),0) AS signup, coalesce(sum(v) FILTER (event_type='purchase'),0) AS purchase, coalesce(sum(v) FILTER (event_type='error'),0) AS error, coalesce(sum(v) FILTER (event_type='click'),0) AS click, coalesce(sum(v) FILTER (event_type='view'),0) AS view FROM e GROUP BY 1),
b AS (SELECT * FROM w UNION ALL SELECT NULL, sum(signup), sum(purchase), sum(error), sum(click), sum(view) FROM w)
SELECT CAST(day AS VARCHAR) AS day, CAST(signup AS DOUBLE) AS signup, CAST(purchase AS DOUBLE) AS purchase, CAST(error AS DOUBLE) AS error, CAST(click AS DOUBLE) AS click, CAST(view AS DOUBLE) AS view,
CAST(error + click + view AS DOUBLE) AS charges, CAST(purchase - (signup + error + click + view) AS DOUBLE) AS "check" FROM b""")
def daily_pivot_check_total(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), "event_type", "value")
    return _doubled(ledger.control_sheet(rows, ["day"], "event_type", "value", KINDS, sales="purchase", net="signup"), *KINDS, "charges", "check")


@query("""
WITH s AS (SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1)
SELECT o_orderkey, n, total, round(abs(total - o_totalprice) / o_totalprice, 9) AS deviation, coalesce(abs(total - o_totalprice) / o_totalprice > 0.03, false) AS flagged FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def totals_validation(spark, sf_dir):
    sums = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(numbers.money(F.col("l_extendedprice"))).cast("double").alias("total"))
    both = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return ledger.validated(both, F.col("total"), F.col("o_totalprice")).select("o_orderkey", "n", "total", F.round("deviation", 9).alias("deviation"), "flagged")


@query("""
WITH b AS (SELECT l_suppkey AS doc, l_orderkey AS block, CAST(sum(CAST(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS DECIMAL(18,2))) AS DOUBLE) AS s, CAST(sum(CAST(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END AS DECIMAL(18,2))) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, coalesce(s, 0) > 0 AND coalesce(n, 0) > 0 AS whole FROM b),
h AS (SELECT doc, CAST(sum(CAST(s AS DECIMAL(18,2))) AS DOUBLE) AS s_all, CAST(coalesce(sum(CAST(s AS DECIMAL(18,2))) FILTER (whole), 0) AS DOUBLE) AS s_some, bool_or(whole) AS any_whole FROM t GROUP BY 1),
c AS (SELECT *, CASE WHEN doc % 3 = 0 THEN s_all WHEN doc % 3 = 1 THEN s_some ELSE s_all * 2 END AS target FROM h),
k AS (SELECT doc, s_all > 0 AND abs(s_all - target) <= greatest(1.0, target * 0.002) AS ok_all, any_whole AND s_some > 0 AND abs(s_some - target) <= greatest(1.0, target * 0.002) AS ok_some FROM c)
SELECT doc, count(*) AS blocks, CAST(sum(CAST(s AS DECIMAL(18,2))) AS DOUBLE) AS sales FROM t JOIN k USING (doc) WHERE ok_all OR NOT ok_some OR whole GROUP BY 1""")
def partial_block_choice(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    of = lambda flag: F.sum(numbers.money(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice"))))
    b = li.groupBy(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("block")).agg(of("A").alias("s"), of("N").alias("n"))
    whole = (F.coalesce("s", F.lit(0)) > 0) & (F.coalesce("n", F.lit(0)) > 0)
    w = Window.partitionBy("doc")
    every, some = F.sum("s").over(w).cast("double"), F.coalesce(F.sum(F.when(whole, F.col("s"))).over(w), F.lit(0)).cast("double")
    target = F.when(F.col("doc") % 3 == 0, every).when(F.col("doc") % 3 == 1, some).otherwise(every * 2)
    b = b.withColumn("t", target).withColumn("tn", F.lit(None).cast("double"))
    return ledger.complete_or_all(b, ["doc"], "s", "n", "t", "tn").groupBy("doc").agg(F.count("*").alias("blocks"), F.sum("s").cast("double").alias("sales"))


@query("""
WITH t AS (SELECT l_suppkey AS doc, l_returnflag AS f, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem GROUP BY 1, 2),
w AS (SELECT doc, coalesce(sum(amount) FILTER (f = 'A'), 0) AS sales, coalesce(sum(amount) FILTER (f = 'R'), 0) AS charges, sum(amount) FILTER (f = 'N') AS net FROM t GROUP BY 1),
h AS (SELECT *, CASE WHEN doc % 2 = 0 THEN CAST(net AS DOUBLE) + 0.5 ELSE round(CAST(net AS DOUBLE) * 1.1, 2) END AS header FROM w)
SELECT doc, CAST(CASE WHEN abs(net - header) > greatest(1.0, header * 0.002) THEN round(header + CAST(charges AS DOUBLE), 2) ELSE sales END AS DOUBLE) AS sales,
CAST(CASE WHEN abs(net - header) > greatest(1.0, header * 0.002) THEN header ELSE net END AS DOUBLE) AS net FROM h""")
def header_net_wins(spark, sf_dir):
    label = F.when(F.col("l_returnflag") == "A", classify.SALES).when(F.col("l_returnflag") == "N", classify.NET).otherwise("ARANCEL")
    t = ledger.sums_by(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), label.alias("label"), F.col("l_extendedprice").alias("amount")), ["doc", "label"])
    net = F.max(F.when(F.col("label") == classify.NET, F.col("amount"))).over(Window.partitionBy("doc")).cast("double")
    t = t.withColumn("header", F.when(F.col("doc") % 2 == 0, net + 0.5).otherwise(F.round(net * 1.1, 2)))
    got = ledger.honour_net(t, ["doc"], "header").groupBy("doc").agg(F.max(F.when(F.col("label") == classify.SALES, F.col("amount"))).alias("sales"), F.max(F.when(F.col("label") == classify.NET, F.col("amount"))).alias("net"))
    return _doubled(got, "sales", "net")


@query("""
WITH s AS (SELECT o_custkey, floor(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 100) * 100 AS fees, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus <> 'F'), 0) AS DOUBLE) / 4 AS vat FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN fees > 0 AND (vat <= 0 OR abs(vat - round(fees * 0.21, 2)) > 0.05) THEN round(fees * 0.21, 2) ELSE vat END AS vat FROM s""")
def vat_fallback(spark, sf_dir):
    p = numbers.money(F.col("o_totalprice"))
    s = read(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.floor(F.sum(p).cast("double") / 100) * 100).cast("double").alias("fees"), (F.coalesce(F.sum(F.when(F.col("o_orderstatus") != "F", p)), F.lit(0)).cast("double") / 4).alias("vat"))
    return s.select("o_custkey", numbers.vat_or_theory(F.col("fees"), F.col("vat")).alias("vat"))


@query("""
SELECT CASE WHEN grouping(client) = 1 THEN 'run' ELSE CAST(client AS VARCHAR) END AS client, folder, count(*) FILTER (o = 'OK') AS processed, count(*) FILTER (o = 'SKIP') AS skipped, count(*) FILTER (o = 'ERROR') AS errors, count(*) FILTER (o = 'NOT_READY') AS not_ready,
CASE WHEN count(*) FILTER (o = 'ERROR') = 0 THEN 'OK' ELSE 'ERROR' END AS result
FROM (SELECT user_id AS client, CASE WHEN event_id % 2 = 0 THEN 'tarjetas' ELSE 'compras' END AS folder, CASE event_type WHEN 'purchase' THEN 'OK' WHEN 'view' THEN 'SKIP' WHEN 'error' THEN 'ERROR' ELSE 'NOT_READY' END AS o FROM events) GROUP BY ROLLUP (client, folder)""")
def run_counters_rollup(spark, sf_dir):
    e = F.col("event_type")
    files = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("client"), F.when(F.col("event_id") % 2 == 0, "tarjetas").otherwise("compras").alias("folder"), F.when(e == "purchase", "OK").when(e == "view", "SKIP").when(e == "error", "ERROR").otherwise("NOT_READY").alias("outcome"))
    return ledger.run_counters(files, "client", "folder", "outcome").withColumn("client", F.coalesce("client", F.lit("run")))


# --- order-sensitive ---------------------------------------------------------------------------------------------------------

@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS r FROM lineitem) WHERE r = 1")
def keep_first_dedupe(spark, sf_dir):
    return frames.keep_first(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT conv_id, role, arg_min(text, turn) FILTER (trim(text) <> '') AS first_text, arg_max(text, turn) FILTER (trim(text) <> '') AS last_text FROM conversations GROUP BY 1, 2")
def merge_first_last_nonempty(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("first_text", F.col("text")).withColumn("last_text", F.col("text"))
    return frames.merge_pages(rows, ["conv_id", "role"], "turn", ["first_text"], ["last_text"])


_BLOCKS_SQL = """
WITH o AS (SELECT user_id, event_id, event_type, value, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS ends FROM events WHERE value > 0)"""


@query(_BLOCKS_SQL + " SELECT user_id, CAST(block AS BIGINT) AS block, event_type, arg_max(value, event_id) AS value FROM o WHERE block < ends GROUP BY 1, 2, 3")
def segment_until_terminal(spark, sf_dir):
    return frames.block_amounts(read(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", "value", "purchase").select("user_id", "block", "event_type", "value")


@query("SELECT event_id, n, first_id FROM (SELECT event_id, event_type, count(*) OVER w AS n, min(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 12 PRECEDING AND 2 FOLLOWING)) WHERE event_type = 'purchase'")
def anchored_line_window(spark, sf_dir):
    rows = frames.line_windows(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_id", F.col("event_type") == "purchase", 12, 2)
    return rows.select("event_id", F.size("window").cast("long").alias("n"), F.array_min("window").alias("first_id"))


@query("SELECT event_id, last_value(CASE WHEN event_type IN ('signup','error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM events")
def carry_forward_label(spark, sf_dir):
    return frames.carry_forward(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.when(F.col("event_type").isin("signup", "error"), F.col("event_type")), "label").select("event_id", "label")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, event_type <> 'purchase' AS blank FROM events),
s AS (SELECT *, coalesce(max(CASE WHEN NOT blank THEN rn END) OVER (PARTITION BY user_id ORDER BY rn), 0) AS solid FROM r),
c AS (SELECT *, min(CASE WHEN blank AND rn - solid >= 12 AND rn > 10 THEN rn END) OVER (PARTITION BY user_id) AS cut FROM s)
SELECT user_id, count(*) AS n, max(event_id) AS last_id FROM c WHERE cut IS NULL OR rn < cut GROUP BY 1""")
def blank_streak_cut(spark, sf_dir):
    kept = frames.cut_at_blank_streak(read(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") != "purchase", 12, 10)
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("""
SELECT event_id, CASE WHEN rn <= 8 THEN ['TARJETA','BANCO','GASTO','IVA_CREDITO','RET_IVA','RET_IIBB','RET_GAN','OTROS'][rn] ELSE 'OTROS' END AS category
FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)""")
def positional_fallback(spark, sf_dir):
    rows = frames.numbered(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "row")
    return rows.select("event_id", classify.positional_category(F.lit("OTROS"), F.lit("otros"), F.col("row")).alias("category"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_assignment(spark, sf_dir):
    return ledger.last_per_category(read(spark, sf_dir, "events"), ["user_id"], "event_type", "value", "event_id")


@query("SELECT o_custkey, list_sort(list(DISTINCT o_totalprice), 'DESC')[1] AS total, list_sort(list(DISTINCT o_totalprice), 'DESC')[2] AS net FROM orders GROUP BY 1")
def two_largest_distinct(spark, sf_dir):
    # Two rows of each customer reach the arrays, however many orders there are.
    rank = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice")))
    top = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").distinct().withColumn("r", rank).where("r <= 2")
    two = top.groupBy("o_custkey").agg(ledger.two_largest(F.collect_list("o_totalprice")).alias("t"))
    return two.select("o_custkey", F.get("t", 0).alias("total"), F.get("t", 1).alias("net"))


@query("SELECT conv_id, turn, left(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), 800) AS next_head FROM conversations")
def neighbour_page(spark, sf_dir):
    return frames.neighbour(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "next_head")


@query("SELECT event_id, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS after_marker FROM events")
def marker_section(spark, sf_dir):
    return frames.before_marker(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") == "error").select("event_id", "after_marker")


@query("SELECT event_id FROM (SELECT *, bool_or(event_type = 'error') OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS s FROM events) WHERE NOT (s AND event_type IN ('click', 'view'))")
def covered_suppression(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return frames.drop_covered(rows, ["user_id", "day"], F.col("event_type") == "error", F.col("event_type").isin("click", "view")).select("event_id")


# --- scalars -----------------------------------------------------------------------------------------------------------------

_AR_SQL = "SELECT o_orderkey, o_totalprice AS {n} FROM orders"


def _rendered(spark, sf_dir):
    """Argentine, American and plain writing by turns."""
    p = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("$ "), numbers.format_ar(p))).when(F.col("o_orderkey") % 3 == 1, F.format_number(p, 2)).otherwise(F.replace(numbers.format_ar(p), F.lit("."), F.lit(""))).alias("written"), "o_totalprice")


@query("SELECT o_orderkey, o_totalprice AS amount FROM orders")
def parse_amount_nullable(spark, sf_dir):
    return _rendered(spark, sf_dir).select("o_orderkey", numbers.parse_nullable(F.col("written")).alias("amount"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END AS amount FROM orders")
def parse_amount_zero(spark, sf_dir):
    return _rendered(spark, sf_dir).select("o_orderkey", numbers.parse_zero(F.when(F.col("o_orderkey") % 5 == 0, "1.234.567").otherwise(F.col("written"))).alias("amount"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount FROM orders")
def parse_amount_ar(spark, sf_dir):
    ar = numbers.format_ar(F.col("o_totalprice"))
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.parse_ar(F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("("), ar, F.lit(")"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("$ -"), ar)).otherwise(ar)).alias("amount"))


@query("SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS written FROM orders")
def format_ar(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.format_ar(F.col("o_totalprice")).alias("written"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def accent_strip(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query(r"SELECT doc_id, md5(replace(upper(trim(regexp_replace(strip_accents(text), '\s+', ' ', 'g'))), 'ẞ', 'SS')) AS h FROM documents")
def norm_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.norm_text(F.col("text"))).alias("h"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS last FROM orders")
def last_number(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.last_number(F.concat(F.lit("ORDEN 12,50 $ "), "o_orderpriority", F.lit(" cliente "), "o_custkey")).alias("last"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9][0-9.,]*')) AS INTEGER) AS n FROM documents")
def number_findall(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(text.NUMBER), F.lit(1))).alias("n"))


@query("SELECT doc_id, CASE WHEN instr(lower(text), ' de ') > 0 THEN substr(text, instr(lower(text), ' de '), 220) END AS found FROM documents")
def anchored_substring(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.after(F.col("text"), " de ", 220).alias("found"))


@query("SELECT o_orderkey, strftime(last_day(o_orderdate), '%d-%m-%Y') AS period FROM orders")
def month_end_period(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("extracto "), F.date_format("o_orderdate", "MM-yyyy"), F.lit(".xls"))).otherwise(F.concat(F.element_at(F.array(*[F.lit(m.title()) for m in dates.MONTHS if m != "SETIEMBRE"]), F.month("o_orderdate")), F.lit(" "), F.year("o_orderdate")))
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.period_of_name(name, F.lit("2000-01-01").cast("date")).alias("period"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS date FROM orders")
def excel_serial_date(spark, sf_dir):
    serial = F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")) + 0.5
    number = F.when(F.col("o_orderkey") % 2 == 0, serial)
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"), number).alias("date"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_repair_parse(spark, sf_dir):
    broken = F.concat(F.lit("answer: "), F.regexp_replace("props", r"\}$", ", }"), F.lit(" done"))
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(jsontext.parse(broken), "$.k", "int").alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, '' AS missing FROM events")
def schema_normalize(spark, sf_dir):
    v = jsontext.parse(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", jsontext.field(v, "$.k").alias("k"), jsontext.field(v, "$.absent").alias("missing"))


_CONCEPTS = ["IVA S/ARANCEL", "PERCEPCION IVA", "SIRTAC", "NETO DE PAGOS", "RG 830", "CRED.FISC. X", "TARJETA VISA", "LUZ", "IMPUESTO SELLOS", "GASTO IVA"]
_CONCEPT_CLASSES = ["GASTO", "RET_IVA", "RET_IIBB", "BANCO", "RET_GAN", "IVA_CREDITO", "TARJETA", "OTROS", "GASTO", "IVA_CREDITO"]


@query(f"SELECT category, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM (SELECT {_CONCEPT_CLASSES}[event_id % 10 + 1] AS category, value FROM events) GROUP BY 1")
def concept_classifier(spark, sf_dir):
    concept = F.element_at(F.array(*map(F.lit, _CONCEPTS)), (F.col("event_id") % 10 + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select(classify.classify_concept(concept).alias("category"), "value")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.sum(numbers.money(F.col("value"))).cast("double").alias("amount"))


# --- ingestion, lookups, sets ------------------------------------------------------------------------------------------------

@query("SELECT c_custkey, coalesce(n_regionkey, 1) AS route, n_regionkey IS NULL AS missing FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def route_lookup_default(spark, sf_dir):
    routes = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("route"))
    return ingest.with_route(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), routes, "c_nationkey", "route", 1).select("c_custkey", "route", "missing")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) WHERE o_custkey = c_custkey AND s <> 'P')")
def status_anti_retry(spark, sf_dir):
    log = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "ERROR").otherwise("OK").alias("status"), F.col("o_orderkey").alias("ts"))
    return ingest.pending(read(spark, sf_dir, "customer").select("c_custkey"), log, "c_custkey")


@query("SELECT event_id FROM events WHERE value > 10 AND epoch(TIMESTAMP '2024-01-15 12:00:00') - floor(epoch(ts)) >= 120")
def stability_filter(spark, sf_dir):
    size = F.when(F.col("value") > 10, 1).otherwise(0)
    return read(spark, sf_dir, "events").where(ingest.stable(size, F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp"))).select("event_id")


@query("""
WITH f AS (SELECT event_id, user_id, CAST(day(ts) AS INTEGER) AS d, event_type FROM events)
SELECT count(*) AS n, min(event_id) AS first_id FROM f WHERE event_type <> 'view' GROUP BY user_id, d UNION ALL SELECT 1, event_id FROM f WHERE event_type = 'view'""")
def group_candidates(spark, sf_dir):
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("foto"), "event_id", F.lit(".jpg"))).otherwise(F.concat(F.lit("PROVEEDOR"), F.translate(F.lpad(F.col("user_id").cast("string"), 4, "0"), "0123456789", "ABCDEFGHIJ"), F.lit(" "), F.date_format("ts", "dd-MM-yyyy"), F.lit(" 0001-"), F.lpad(F.col("user_id").cast("string"), 8, "0")))
    files = read(spark, sf_dir, "events").select(name.alias("name"), F.col("event_id").alias("modificationTime"))
    return ingest.group_documents(files).select("n", F.get("members", 0)["modified"].alias("first_id"))


@query("SELECT user_id FROM (SELECT user_id, CAST(ts AS DATE) AS d, count(DISTINCT event_type) AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2) WHERE n = 2 GROUP BY 1 ORDER BY CASE WHEN user_id = 7 THEN 0 ELSE 1 END, user_id")
def having_two_columns(spark, sf_dir):
    columns = read(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("table_schema"), F.col("user_id").cast("string").alias("table_name"), F.col("event_type").alias("column_name"))
    found = ingest.tables_with(columns, ["purchase", "error"], "7").select(F.col("table_name").cast("long").alias("user_id")).distinct()
    return found.orderBy(F.when(F.col("user_id") == 7, 0).otherwise(1), "user_id")


@query("SELECT n_nationkey, n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier) AS both_sides FROM nation")
def set_ops(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer").select("c_nationkey"), read(spark, sf_dir, "supplier").select("s_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey")
    both = c.intersect(s)
    rest = n.exceptAll(both.withColumnRenamed("c_nationkey", "n_nationkey"))
    return both.select(F.col("c_nationkey").alias("n_nationkey"), F.lit(True).alias("both_sides")).unionByName(rest.withColumn("both_sides", F.lit(False)))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY")
def retention_ttl(spark, sf_dir):
    return ingest.retained(read(spark, sf_dir, "events"), F.lit("2024-01-30 00:00:00").cast("timestamp")).select("event_id")


@query("""
WITH q AS (SELECT doc_id, CAST(max(quality) AS INTEGER) AS good, CAST(max(toxic) AS INTEGER) AS retry_bad FROM labels GROUP BY 1)
SELECT d.doc_id, CASE WHEN good = 1 THEN d.lang WHEN retry_bad = 0 THEN upper(d.lang) ELSE d.lang END AS answer FROM documents d JOIN q USING (doc_id)""")
def quality_cascade(spark, sf_dir):
    from .plans.invoice import cascade

    labels = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("doc")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 0).alias("retry_good"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("answer")).join(labels, "doc")
    first = docs.select("doc", "answer")

    def retry(again):
        rows = docs.join(again, "doc", "left_semi")
        return rows.select("doc", F.upper("answer").alias("answer")), rows.select("doc", F.col("retry_good").alias("good"))

    return cascade(first, docs.select("doc", "good"), retry).select(F.col("doc").alias("doc_id"), "answer")


@query("""
WITH p AS (SELECT c_custkey AS doc, 1 + c_custkey % 9 AS total FROM customer), s AS (SELECT doc, total, CASE WHEN total <= 4 THEN total ELSE 4 END AS size FROM p)
SELECT doc, CAST(f AS INTEGER) AS first, CAST(least(f + size - 1, total) AS INTEGER) AS last FROM (SELECT *, unnest(range(1, total + 1, size)) AS f FROM s)""")
def page_chunks(spark, sf_dir):
    pages = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc"), F.explode(F.sequence(F.lit(1), (1 + F.col("c_custkey") % 9).cast("int"))).alias("page"))
    return ingest.page_chunks(pages, "doc", "page", 4).select(F.col("doc").cast("long").alias("doc"), "first", "last")


@query("""
SELECT page_id, CAST(k AS INTEGER) AS k, CAST(greatest(0, k * band - pad) AS INTEGER) AS top, CAST(least(h, (k + 1) * band + pad) AS INTEGER) AS bottom FROM (
SELECT page_id, h, band, least(60, greatest(20, CAST(floor(band / 10) AS INTEGER))) AS pad, unnest(range(0, 4)) AS k FROM (SELECT page_id, length(html) AS h, CAST(ceil(length(html) / 4) AS INTEGER) AS band FROM pages))""")
def image_tiles(spark, sf_dir):
    images = read(spark, sf_dir, "pages").select("page_id", F.length("html").alias("h"))
    return ingest.image_tiles(images, "h", 4).select("page_id", "k", "top", "bottom")
