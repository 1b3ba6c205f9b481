"""URL filters: host suffixes and path prefixes of each URL, joined to a rule book by short hashes and confirmed by full digests.

DataFrame functions only. A rule's expression is its host and the folders of its path; a URL has an expression for each shape
(labels of the host, folders of the path) that some rule has, so neither long hosts nor deep paths make more of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the short hashes.
SHORT = 8
#: The rule book is broadcast up to so many bytes of rules, counted before.
BROADCAST_BYTES = 16 << 20


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to a slash, question mark or number sign, in lower case; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark or number sign."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, folders: Column) -> Column:
    """A number sign is in no host and no path."""
    return F.sha2(F.concat(host, F.lit("#"), folders).cast("binary"), 256)


def rule_book(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their expressions: a rule whose host is null or empty, or whose verdict is neither allow nor
    block, is left out; a null path is empty; hosts are lower-cased; equal rules count once."""
    kept = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    kept = kept.where((F.col("rule_host") != "") & F.col("rule_verdict").isin("allow", "block")).distinct()
    kept = kept.withColumns({"labels": _labels(F.col("rule_host")), "folders": _slashes(F.col("rule_path"))})
    kept = kept.withColumn("rule_digest", _digest(F.col("rule_host"), F.left("rule_path", F.length("rule_path") - F.length(F.substring_index("rule_path", "/", -1)))))
    return kept.withColumn("rule_short", F.left("rule_digest", F.lit(SHORT)))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path) and verdict of each row, by the longest rule that fits; ``default`` where none does.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of several the longest host and path decide, of
    equally long ones the longer host, then ``block``. A row for each row: ids may repeat or be null. A null URL, and one without
    ``://``, has an empty host and path, which no rule fits. URLs may be of any length; without rules all rows get the default.
    """
    book = rule_book(rules)
    # One row for each shape among the rules reaches the driver, and the size of the book.
    shapes = [(r["labels"], r["folders"]) for r in book.select("labels", "folders").distinct().collect()]
    size = book.agg(F.sum(F.length("rule_host") + F.length("rule_path") + 200)).first()[0] or 0
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not shapes:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    fits = [F.when((_labels(F.col("host")) >= n) & (_slashes(F.col("path")) >= k), _digest(F.substring_index("host", ".", -n), F.concat(F.substring_index("path", "/", k), F.lit("/")) if k else F.lit(""))) for n, k in sorted(shapes)]
    rows = rows.withColumn("digest", F.explode_outer(F.array_compact(F.array(*fits)))).withColumn("short", F.left("digest", F.lit(SHORT)))
    book = book.drop("labels", "folders")
    met = rows.join(F.broadcast(book) if size <= BROADCAST_BYTES else book, F.col("short") == F.col("rule_short"), "left")
    sure = (F.col("digest") == F.col("rule_digest")) & F.startswith("path", F.col("rule_path"))
    rule = F.concat("rule_host", "rule_path")
    ranked = F.struct(F.length(rule).alias("long"), F.length("rule_host").alias("host"), (F.col("rule_verdict") == "block").alias("block"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = met.groupBy("rid", "page_id", "host", "path").agg(F.max(F.when(sure, ranked)).alias("best"))
    return best.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows, whole, whose URL isn't blocked; each distinct URL is judged once."""
    urls = pages.select(F.col(url).alias("_url")).distinct()
    bad = judge(urls.withColumn("_key", F.col("_url")), rules, "_key", "_url", default).where("verdict = 'block'").select(F.col("page_id").alias("_url"))
    return pages.join(bad, F.col(url).eqNullSafe(F.col("_url")), "left_anti")


#: Fixed: the rules of the query, (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def local_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A hand-written rule book as a table."""
    named = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*named)))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every URL of ``pages``."""
    return judge(table(spark, sf_dir, "pages"), local_rules(spark, RULES))


OP13_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {", ".join(str(x) for x in RULES)}) AS r(rule_host, rule_path, rule_verdict)),
f AS (SELECT row_number() OVER () AS rid, * FROM h)
SELECT page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, coalesce(max_by(rule_verdict, length(rule_host || rule_path)), 'allow') AS verdict
FROM f LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid, page_id, host, path"""
