"""Secret scans: credentials by form, and multipart credentials by linking.

Three strong kinds are reported wherever they match: assign (a named secret and its value), access
(an access identifier) and hex (a long run of hexadecimal digits). Weak parts say little alone: an
account name, an endpoint, a mixed token that could be a key. They are reported only where
complementary parts are at most SCOPE code points apart, from the end of one to the start of the
other, found by an interval join on (document, bucket of SCOPE code points). A bucket holds a bounded
number of starts and of ends, so no document, however long, makes more than a linear number of pairs.

DataFrame functions only. Positions are code points, from the lengths of what lies between matches.

Defined results: a null text counts as empty; repeated rows and equal identifiers are scanned apart,
each row for itself; an empty table gives an empty result; further columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import id_and_text, written

#: The strong kinds, in the order in which they are listed: pattern, group that counts, its least length.
STRONG = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: The weak kinds: pattern, group, its least length.
WEAK = {
    "account": (r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 1, 3),
    "endpoint": (r"""(?i:https?|s3|ftps?|amqps?|mongodb|mysql|postgres(?:ql)?|redis)://[^\x00-\x20"'<>]+""", 0, 8),
    # what '=' and a value follow is a name
    "key": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2})?+(?![A-Za-z0-9+/=_-])", 0, 20),
}
SCOPE = 256


def _found(kind: str, rule: tuple[str, int, int]) -> Column:
    """The matches of a rule in text, in order: code points before each since the last one, its length, and whether it counts."""
    pattern, group, least = rule
    text, re = F.col("text"), F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, re, F.lit(0)), F.length)
    good = lambda x: F.length(x) >= least
    if kind == "key":  # what mixes small letters, capitals and digits, as words and numbers don't
        good = lambda x: x.rlike("[a-z]") & x.rlike("[A-Z]") & x.rlike("[0-9]")
    counts = F.transform(F.regexp_extract_all(text, re, F.lit(group)), good)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("size"), counts.alias("counts"))
    return F.when(text.rlike(pattern), zipped)


def _parts(scanned: DataFrame, kinds: list[str]) -> DataFrame:
    """row_no, kind, rank, start, end of all matches that count."""
    each = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(k).alias("found")) for i, k in enumerate(kinds)])
    rows = scanned.where(" OR ".join(f"{k} IS NOT NULL" for k in kinds)).select("row_no", F.explode(each).alias("e"))
    rows = rows.where("e.found IS NOT NULL").select("row_no", "e.rank", "e.kind", F.posexplode("e.found").alias("i", "m"))
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(Window.partitionBy("row_no", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end.cast("long")).where("m.counts").select("row_no", "rank", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak parts that complement each other: a key with an identifier or an endpoint near it, and these two."""
    # the part that comes first is listed under the bucket of its end, the other under that of its start
    first, then = F.floor(F.col("end") / scope), F.floor(F.col("start") / scope)
    part = F.struct("rank", "kind", "start", "end")
    of = {"a": parts.where("kind = 'key'"), "b": parts.where("kind IN ('access', 'account', 'endpoint')")}
    pairs = None
    for x, y in (("a", "b"), ("b", "a")):
        left = of[x].select("row_no", F.explode(F.array(first, first + 1)).alias("bucket"), part.alias(x))
        right = of[y].select("row_no", then.alias("bucket"), part.alias(y))
        new = left.join(right, ["row_no", "bucket"]).where(f"{y}.start - {x}.end BETWEEN 0 AND {scope}").select("row_no", "a", "b")
        pairs = new if pairs is None else pairs.unionByName(new)
    both = pairs.select("row_no", F.explode(F.array("a", "b")).alias("x")).select("row_no", "x.*")
    return both.where("kind <> 'access'").distinct()


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """A row for each document: doc_id, and found, an array of (start, rank, kind, end) by start, then rank; ranks below 3 are strong."""
    rules = STRONG | WEAK
    scanned = id_and_text(docs).select("doc_id", F.monotonically_increasing_id().alias("row_no"), *[_found(k, r).alias(k) for k, r in rules.items()])
    scanned = written(scanned, "scanned")
    parts = written(_parts(scanned, list(rules)), "parts")
    strong = parts.where(F.col("rank") < len(STRONG))
    linked = _linked(parts, scope)
    found = strong.unionByName(linked).groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return scanned.select("doc_id", "row_no").join(found, "row_no", "left").select("doc_id", F.coalesce("found", empty).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of secret_scan()'s rows."""
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda i: F.size(F.filter("found", lambda x: x["rank"] == i)).cast("long")
    base = F.filter("found", lambda x: x["rank"] < len(STRONG))
    return found.select("doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(STRONG)], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
