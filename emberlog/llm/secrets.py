"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over the characters of tokens, one of random strings and one of ordinary identifiers,
are counted from labelled samples and give one table of log-likelihood ratios by character
pair.  A token of the text with ``LEAST`` characters or more whose mean ratio passes ``RATIO`` is a secret of kind
"random", unless it overlaps a span of the three patterns.  All of it is DataFrame functions: no Python runs
on the executors.  No shuffle: each row is done where it stands.

Defined results: null and empty texts have no spans; very long texts and tokens are scanned whole; copies
have equal results; rows without a doc_id are scanned like others; an empty table gives no rows; other columns aren't
looked at, whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import apart, matches

# The patterns that the result is defined by.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
LEAST = 20
#: Mean log-likelihood ratio by character pair from which a token counts as random.  At 0 both models fit alike; of fresh
#: samples by the same rules the margin keeps all but one identifier in a thousand out (see the tests).
RATIO = 0.35
#: Samples of each class for the models; both are generated by rule, so training never reads the corpus.
SAMPLES = 6000

#: Parts of ordinary identifiers.
PARTS = """get set is has to from make build create update delete remove add insert find load save read write open close
start stop run init parse format convert encode decode send receive fetch push pull merge split join sort filter map
reduce count sum min max value key name id index list array map table row column field record entry item node tree
graph path file folder user group role account session request response header body status error message event
handler manager service client server worker task queue job thread process buffer stream reader writer config option
setting default current previous next first last total average number string text line word page image video audio
time date year month day hour minute second order price product customer address city country the and for with of
in on at by new old left right top bottom width height size length color style class type kind model view controller
that this which each every other more most some any all between under over after before into about through""".split()


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(sample, label): random strings (1) of four alphabets, and identifiers (0) in five styles."""
    row = spark.range(n)
    digest = F.sha2(F.concat(F.lit("r"), F.col("id").cast("string")), 512)
    raw = F.base64(F.unhex(digest))
    wide = F.regexp_replace(raw, "[\r\n=]", "")
    random = F.when(F.col("id") % 4 == 0, F.substring(wide, 1, 40)).when(F.col("id") % 4 == 1, F.regexp_replace(wide, "[+/]", "")).when(F.col("id") % 4 == 2, F.upper(F.substring(F.regexp_replace(wide, "[+/]", ""), 1, 32))).otherwise(F.translate(F.substring(wide, 1, 43), "+/", "-_"))
    parts = F.array(*[F.lit(p) for p in PARTS])
    pick = lambda k: F.element_at(parts, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    few = [pick(k) for k in range(5)]
    camel = F.concat(few[0], *[F.initcap(x) for x in few[1:]])
    ident = F.when(F.col("id") % 5 == 0, F.concat_ws("_", *few)).when(F.col("id") % 5 == 1, camel).when(F.col("id") % 5 == 2, F.concat_ws("-", *few)).when(F.col("id") % 5 == 3, F.concat(F.concat_ws("/", *few), (F.col("id") % 1000).cast("string"))).otherwise(F.concat(*few))
    ident = F.when(F.col("id") % 11 == 0, F.upper(ident)).otherwise(ident)
    return row.select(random.alias("sample"), F.lit(1).alias("label")).unionByName(row.select(ident.alias("sample"), F.lit(0).alias("label")))


def ratios(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over identifier) of every pair of the alphabet; len(ALPHABET)**2 values."""
    chars = F.split("sample", "")
    pairs = F.zip_with(F.slice(chars, 1, F.length("sample") - 1), F.slice(chars, 2, F.length("sample")), lambda a, b: F.concat(a, b))
    rows = labelled.where(F.length("sample") > 1).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count().collect()  # bounded by the alphabet
    n = len(ALPHABET)
    table = {0: [[0.5] * n for _ in range(n)], 1: [[0.5] * n for _ in range(n)]}
    for r in rows:
        a, b = ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1])
        if a >= 0 and b >= 0:
            table[r["label"]][a][b] += r["count"]
    out = []
    for a in range(n):
        one, zero = sum(table[1][a]), sum(table[0][a])
        out += [round(math.log(table[1][a][b] / one) - math.log(table[0][a][b] / zero), 4) for b in range(n)]
    return out


def mean_ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character pairs."""
    lookup = F.from_json(F.lit(json.dumps(table)), "array<double>")  # folded to a constant
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    n = F.length(token)
    terms = F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: F.coalesce(F.get(lookup, (a - 1) * F.lit(len(ALPHABET)) + b - 1), F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(n - 1, F.lit(1))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the three patterns; an assignment needs six characters of value."""
    empty = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    found = {
        "assign": F.when(text.rlike(ASSIGN), F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= 6)).otherwise(empty),
        "access": F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS)).otherwise(empty),
        "hex": F.when(text.rlike(HEX), matches(text, HEX)).otherwise(empty),
    }
    return found


def _listed(kind: str, spans: Column, order: int) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["stop"].cast("string")).alias("s")))


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["s"]), ",")


def find_secrets(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, the four lists of spans and the digests of every row."""
    table = ratios(samples(docs.sparkSession)) if table is None else table
    rows = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("_t"))
    text = F.col("_t")
    empty = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    found = rows.select("doc_id", *[c.alias(k) for k, c in base_spans(text).items()], F.when(text.rlike(TOKEN), matches(text, TOKEN)).otherwise(empty).alias("tokens"))
    base = F.concat("assign", "access", "hex")
    found = found.withColumn("tokens", F.when((F.size("tokens") > 0) & (F.size(base) > 0), apart(F.col("tokens"), base)).otherwise(F.col("tokens")))
    found = found.withColumn("random", F.when(F.size("tokens") > 0, F.filter("tokens", lambda t: mean_ratio(t["value"], table) >= RATIO)).otherwise(F.col("tokens")))
    parts = F.concat(*[_listed(k, F.col(k), i) for i, k in enumerate(KINDS)])
    every = F.concat(parts, _listed("random", F.col("random"), len(KINDS)))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(parts), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
