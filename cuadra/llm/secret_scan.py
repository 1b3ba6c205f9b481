"""Secret scans with SQL functions only: three base patterns, and character Markov models for what they miss.

Two first-order models over 29 character classes, one of random strings and one of ordinary identifiers, are trained from
labelled samples; a long token whose mean log-likelihood ratio is high is a secret. Every token of the minimum length is judged,
whatever it is made of. The work on a text grows with its length and the number of its matches, not with their square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so that asking for the length at once finds the same ones.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Tokens that the models judge; runs are maximal here too.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
#: Mean log-likelihood ratio of a transition, in millionths, from which a token is a secret. Ratios are whole millionths, so that sums are exact.
THRESHOLD = 300_000
CLASSES = 29

#: Fixed: parts of ordinary identifiers, for the default labelled samples.
PARTS = "account active address amount array average balance batch block buffer build cache channel class client code column config connection content context count create current data database date default delete device document element error event export field file filter first format function group handler header height image import index input item key label last length level library limit line list loader local lock log main manager message method model module name network node number object option order output page parent parser path pattern permission pixel point port process product profile project query queue range read record region remote render report request resource result route sample schema score screen search section select server service session setting shape size source stage state status stream string style sync table target task template test text thread time title total trace transform tree type update user value version view width window worker write".split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Default samples: (token, label), label 1 for random strings (hexadecimal, base 64, lower-case letters, letters and digits), 0 for
    identifiers made of ordinary parts, joined in several ways, with and without numbers. Same each time."""
    number = lambda k, m: F.conv(F.substring("h", 1 + 4 * k, 4), 16, 10).cast("int") % m
    seed = spark.range(n, numPartitions=1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    letters = F.translate(F.concat("h", F.sha2("h", 256)), "0123456789", "ghijklmnop")
    small = F.translate(F.substring(letters, 1, 32), "abcdef", "qrstuv")
    mixed = F.substring(F.regexp_replace(F.base64(F.unhex("h")), "[+/=]", ""), 1, 32)
    kind = F.col("id") % 4
    raw = F.when(kind == 0, F.substring("h", 1, 40)).when(kind == 1, F.base64(F.unhex("h"))).when(kind == 2, small).otherwise(mixed)
    pick = lambda k: F.element_at(F.array(*map(F.lit, PARTS)), number(k, len(PARTS)) + 1)
    parts = [pick(k) for k in range(4)]
    title = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 99))
    how = number(5, 5)
    name = F.when(how == 0, F.concat_ws("_", *parts)).when(how == 1, F.concat(parts[0], *map(title, parts[1:]))).when(how == 2, F.concat_ws("-", *parts)).when(how == 3, F.concat_ws("/", *parts)).otherwise(F.concat(*parts))
    name = F.concat(name, F.when(number(6, 5) < 2, F.concat(F.lit("_"), number(7, 100).cast("string"))).otherwise(""))
    return seed.select(raw.alias("token"), F.lit(1).alias("label")).union(seed.select(name.alias("token"), F.lit(0).alias("label")))


def _classes(token: Column) -> Column:
    """Numbers of the classes of a token's characters. Letters of one without lower-case ones, as in constants, count as lower-case."""
    token = F.when(token.rlike("[a-z]"), token).otherwise(F.lower(token))
    one = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).when(c.between("A", "Z"), 26).when(c.between("0", "9"), 27).otherwise(28)
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), one)


def _pairs(classes: Column) -> Column:
    """Numbers of the transitions in an array of classes."""
    return _let(classes, lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.get(c, i - 1) * CLASSES + F.get(c, i)))


def train(samples: DataFrame) -> list[int]:
    """Log-likelihood ratios of all 841 transitions, random against ordinary, in millionths, with one added to each count.

    ``samples`` has token and label; null and short tokens count for nothing.
    """
    rows = samples.where("token is not null").select("label", F.explode(_pairs(_classes(F.col("token")))).alias("pair")).where("pair is not null")
    seen = {(r["label"], r["pair"]): r["n"] for r in rows.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}  # 1,682 rows at most
    def log_p(label, a, b):
        return math.log((seen.get((label, a * CLASSES + b), 0) + 1) / (sum(seen.get((label, a * CLASSES + c), 0) for c in range(CLASSES)) + CLASSES))
    return [round(1e6 * (log_p(1, a, b) - log_p(0, a, b))) for a in range(CLASSES) for b in range(CLASSES)]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), body)[0]


def _running(items: Column, zero: Column, step, kind: str, block: int = 128) -> Column:
    """Array of what ``step``, of (state, item) to a struct (s, out), puts out for each item. States go from block to block, and
    blocks are put together at the end, so that no long array is copied for each item."""
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    within = lambda s, part: F.aggregate(part, F.struct(s.alias("s"), none.alias("out")), lambda a, x: _let(step(a["s"], x), lambda n: F.struct(n["s"].alias("s"), F.concat(a["out"], F.array(n["out"])).alias("out"))))
    over = lambda x: F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")),
        F.struct(zero.alias("s"), nones.alias("out")),
        lambda a, b: _let(within(a["s"], F.slice(x, b * block + 1, F.lit(block))), lambda n: F.struct(n["s"].alias("s"), F.concat(a["out"], F.array(n["out"])).alias("out"))),
        lambda a: F.flatten(a["out"]),
    )
    return _let(items, lambda x: F.when(F.size(x) > 0, over(x)).otherwise(none))


SPAN = "struct<start:int,kind:int,end:int>"


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of (start, kind, end) of the matches, in code points; ``keep`` decides on (text, match, its number from 0)."""
    def of(texts):
        passes = lambda i: F.lit(True) if keep is None else keep(texts, i)
        items = F.transform(F.sequence(F.lit(0), F.size(texts["found"]) - 1), lambda i: F.struct(F.length(F.get(texts["between"], i)).alias("gap"), F.length(F.get(texts["found"], i)).alias("n"), passes(i).alias("keep")))
        step = lambda at, x: F.struct((at + x["gap"] + x["n"]).alias("s"), F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["n"]).alias("end"), x["keep"].alias("keep")).alias("out"))
        every = _running(items, F.lit(0), step, "struct<start:int,kind:int,end:int,keep:boolean>")
        return F.transform(F.filter(every, lambda s: s["keep"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    none = F.array().cast(f"array<{SPAN}>")
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if kind == 0 else 0))
    texts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), values.alias("values"))
    return F.when(text.rlike(pattern), _let(texts, of)).otherwise(none)


def scan(docs: DataFrame, samples: DataFrame | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` plus ``secrets``: array of (start, kind, end), by start, then kind, in code points.

    Takes ``text``; a null or empty text has no secrets. Kinds count from 0: assign, access, hex, random. Base matches stay; a
    random one is added unless it lies within one of them, and may overlap them. Rows are judged alone, so repeated rows and ids change nothing; a column
    of ``docs`` that is itself named secrets is replaced. An empty table gives an empty one.
    """
    ratios = train(samples if samples is not None else labelled_samples(docs.sparkSession))
    table = F.array(*map(F.lit, ratios))
    text = F.coalesce("text", F.lit(""))
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = _spans(text, ASSIGN, 0, lambda t, i: F.length(F.get(t["values"], i)) >= 12)

    def unlikely(texts, i):
        mean = lambda pairs: F.aggregate(pairs, F.lit(0).cast("long"), lambda a, p: a + F.get(table, p)) >= F.lit(threshold).cast("long") * F.size(pairs)
        return _let(_pairs(_classes(F.get(texts["found"], i))), mean)

    rows = docs.withColumn("secrets", F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2), _spans(text, TOKEN, 3, unlikely))))
    # In order of their starts: how far base matches before a random one, or at its start, reach.
    reach = lambda at, x: _let(F.when(x["kind"] < 3, F.greatest(at, x["end"])).otherwise(at), lambda far: F.struct(far.alias("s"), F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), ((x["kind"] < 3) | (x["end"] > far)).alias("keep")).alias("out")))
    every = F.filter(_running(F.col("secrets"), F.lit(-1), reach, "struct<start:int,kind:int,end:int,keep:boolean>"), lambda s: s["keep"])
    apart = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.withColumn("secrets", F.when(F.exists("secrets", lambda s: s["kind"] == 3), apart).otherwise(F.col("secrets")))


def redact(docs: DataFrame, mark: str = "[SECRET]", threshold: int = THRESHOLD) -> DataFrame:
    """``docs``, all rows and columns, with each secret in ``text`` replaced by ``mark``; n_chars follows where there is one."""
    # Columns of ``docs`` stay together, so that no name of theirs can clash.
    rows = scan(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text"), threshold=threshold)
    # What is put before the end of each secret: the text since the last one, and the mark, unless it overlaps that one.
    step = lambda at, x: F.struct(F.greatest(at, x["end"]).alias("s"), F.when(x["start"] >= at, F.concat(F.substr("text", at + 1, x["start"] - at), F.lit(mark))).otherwise("").alias("out"))
    last = F.array_max(F.transform("secrets", lambda x: x["end"]))
    clean = F.concat(F.array_join(_running(F.col("secrets"), F.lit(0), step, "string"), ""), F.substr("text", last + 1))
    rows = rows.select("row", F.when(F.size("secrets") > 0, clean).otherwise(F.col("text")).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("row")["n_chars"])} if "n_chars" in docs.columns else {"text": F.col("text")}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


OP9_SQL = r"""
WITH ids AS (SELECT id, sha256(CAST(id AS VARCHAR)) AS h FROM range(4000) t(id)
), hashes AS (SELECT id, h, list_transform(range(8), lambda k: CAST(('0x' || substr(h, CAST(1 + 4 * k AS INT), 4)) AS INT)) AS n FROM ids
), parts AS (SELECT id, h, n, list_transform(n[1:4], lambda x: list_extract([PARTS], x % NPARTS + 1)) AS p FROM hashes
), samples AS (
  SELECT CASE id % 4 WHEN 0 THEN substr(h, 1, 40) WHEN 1 THEN to_base64(from_hex(h))
    WHEN 2 THEN translate(substr(translate(h || sha256(h), '0123456789', 'ghijklmnop'), 1, 32), 'abcdef', 'qrstuv')
    ELSE substr(regexp_replace(to_base64(from_hex(h)), '[+/=]', '', 'g'), 1, 32) END AS token, 1 AS label FROM parts
  UNION ALL SELECT CASE n[6] % 5 WHEN 0 THEN array_to_string(p, '_')
    WHEN 1 THEN p[1] || array_to_string(list_transform(p[2:4], lambda x: upper(x[1]) || x[2:]), '')
    WHEN 2 THEN array_to_string(p, '-') WHEN 3 THEN array_to_string(p, '/') ELSE array_to_string(p, '') END
    || CASE WHEN n[7] % 5 < 2 THEN '_' || (n[8] % 100) ELSE '' END, 0 FROM parts
), sample_pairs AS (
  SELECT label, unnest(list_transform(range(1, length(token)), lambda i: (CLASS1) * 29 + (CLASS2))) AS pair
  FROM (SELECT label, CASE WHEN regexp_matches(token, '[a-z]') THEN token ELSE lower(token) END AS token FROM samples)
), counts AS (SELECT label, pair, count(*) AS n FROM sample_pairs GROUP BY ALL
), cells AS (SELECT label, pair, coalesce(n, 0) AS n FROM (SELECT * FROM (VALUES (0), (1)) l(label), range(841) r(pair)) LEFT JOIN counts USING (label, pair)
), logs AS (SELECT label, pair, ln((n + 1) / (sum(n) OVER (PARTITION BY label, pair // 29) + 29)) AS p FROM cells
), ratios AS (SELECT list(CAST(round(1e6 * (a.p - b.p)) AS BIGINT) ORDER BY pair) AS table_ FROM logs a JOIN logs b USING (pair) WHERE a.label = 1 AND b.label = 0
), d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), matches AS (
  SELECT r, 0 AS kind, regexp_split_to_array(text, ASSIGN) AS gaps, regexp_extract_all(text, ASSIGN) AS found, regexp_extract_all(text, ASSIGN, 2) AS v FROM d
  UNION ALL SELECT r, 1, regexp_split_to_array(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, 2, regexp_split_to_array(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') FROM d
  UNION ALL SELECT r, 3, regexp_split_to_array(text, '[A-Za-z0-9+/_=-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}') FROM d
), one AS (SELECT r, kind, unnest(range(1, len(found) + 1)) AS i, unnest(gaps[1:len(found)]) AS gap, unnest(found) AS token, unnest(v) AS value FROM matches WHERE len(found) > 0
), folded AS (SELECT * REPLACE (CASE WHEN kind < 3 OR regexp_matches(token, '[a-z]') THEN token ELSE lower(token) END AS token) FROM one
), placed AS (SELECT r, kind, token, value, sum(length(gap) + length(token)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM folded
), judged AS (
  SELECT r, kind, CAST(stop - length(token) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
    CASE kind WHEN 0 THEN length(value) >= 12 WHEN 1 THEN length(token) >= 18 WHEN 2 THEN length(token) >= 16
      ELSE list_sum(list_transform(range(1, length(token)), lambda i: list_extract(table_, (CLASS1) * 29 + (CLASS2) + 1))) >= LIMIT * (length(token) - 1) END AS keep
  FROM placed, ratios
), kept AS (SELECT r, kind, start, stop FROM judged WHERE keep
), spans AS (SELECT * FROM kept WHERE kind < 3 UNION ALL SELECT * FROM kept k WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM kept b WHERE b.r = k.r AND b.kind < 3 AND b.start <= k.start AND b.stop >= k.stop)
), named AS (SELECT r, kind, start, list_extract(['assign', 'access', 'hex', 'random'], kind + 1) || ':' || start || ':' || stop AS x FROM spans
), listed AS (
  SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
    string_agg(x, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY start, kind) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (r)
"""
for _n, _at in ((1, "i"), (2, "i + 1")):
    _c = f"token[{_at}]"
    OP9_SQL = OP9_SQL.replace(f"CLASS{_n}", f"CASE WHEN {_c} BETWEEN 'a' AND 'z' THEN ascii({_c}) - 97 WHEN {_c} BETWEEN 'A' AND 'Z' THEN 26 WHEN {_c} BETWEEN '0' AND '9' THEN 27 ELSE 28 END")
_letters = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
OP9_SQL = OP9_SQL.replace("ASSIGN", f"""'({_letters})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'""").replace("[PARTS]", "[" + ", ".join(f"'{p}'" for p in PARTS) + "]").replace("NPARTS", str(len(PARTS))).replace("LIMIT", str(THRESHOLD))


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans by Python's ``re``, for tests."""
    import re

    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]
