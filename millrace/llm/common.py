"""What the operators share: scratch tables in the shared folder, the words of a text, and ways to take rows out of a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class for Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]+"
#: Stands for a null identifier where identifiers are compared or the smallest one is looked for.
LAST = 2**63 - 1
#: A key is hot with more than one part in so many of all rows; so there are fewer hot keys than this, whatever the input.
HOT_KEYS = 1000
#: Words of 64 bits of a key_filter(): one megabyte, more for many keys, and 64 megabytes at most.
FILTER_WORDS, MOST_WORDS = 1 << 17, 1 << 23


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives the loss of any executor, and has a known size."""
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by written() that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._millrace_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and the text, null as empty; other columns, whatever their names, take no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key():
    """What tells rows apart: the identifier and a hash of the text; rows that have both alike are repeated rows."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def key_filter(keyed: DataFrame, on: list[str]) -> DataFrame:
    """One row of bits, of which each key of keyed sets one, and so many words; it is written, and small enough to broadcast whatever keyed holds.

    There are 16 bits for a key at least, up to MOST_WORDS.
    """
    words = FILTER_WORDS
    while words < min(MOST_WORDS, keyed.count() // 4):
        words *= 2
    word, place = _bit(on, F.lit(words))
    found = keyed.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("x")).groupBy("w").agg(F.bit_or("x").alias("x"))
    every = keyed.sparkSession.range(0, words, 1, 1).select(F.col("id").cast("int").alias("w")).join(found, "w", "left")
    return written(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("x", F.lit(0).cast("long")).alias("x")))), lambda e: e["x"]).alias("bits")), "filter")


def _bit(on: list[str], words):
    bit = F.pmod(F.xxhash64(*on), words.cast("long") * 64)
    return F.shiftrightunsigned(bit, 6).cast("int"), bit.bitwiseAND(F.lit(63)).cast("int")


def maybe_in(rows: DataFrame, bits: DataFrame, on: list[str], inside: bool = True) -> DataFrame:
    """The rows whose key may be among those of a key_filter(), and some others; or the rest, whose keys certainly aren't.

    Wide rows without a partner needn't be shuffled to find that out. The more keys, the more other rows pass.
    """
    (name,) = fresh(rows, "bits")
    word, place = _bit(on, F.size(name))
    return rows.join(F.broadcast(bits.withColumnRenamed("bits", name)), F.getbit(F.get(F.col(name), word), place) == 1, "left_semi" if inside else "left_anti")


def without(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows of docs but for those that go.

    seen: id, hash (a row_key()) and stays, for every row of a group that loses any. Rows go by their
    key; where a key that stays is there several times, one row of it does. Only rows that a filter
    takes for one of these meet them in a join; the texts of all others aren't shuffled.
    """
    cols = docs.columns
    a, b = fresh(docs, "id", "hash")
    keyed = docs.withColumns(dict(zip((a, b), row_key(), strict=True)))
    keys = seen.groupBy(F.col("id").alias(a), F.col("hash").alias(b)).agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    keys = written(keys.where("n > 1 OR NOT stays"), "keys")
    goes = written(keys.where("NOT stays").select(a, b), "goes")
    bits = key_filter(keys, [a, b])
    left = maybe_in(keyed, bits, [a, b]).join(goes, [a, b], "left_anti")
    if not keys.where("stays").isEmpty():
        several = written(keys.where("stays").select(a, b), "repeated")
        one = left.join(several, [a, b], "left_semi").dropDuplicates([a, b])
        left = left.join(several, [a, b], "left_anti").unionByName(one)
    discard(keys)
    return maybe_in(keyed, bits, [a, b], inside=False).unionByName(left).select(*cols)


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], count: str) -> DataFrame:
    """rows joined with keyed, which has one row for each key and how many of rows the key has.

    Rows of a hot key are dealt into parts of one HOT_KEYS-th of all rows, which its row in keyed is
    repeated for; the hot keys, fewer than HOT_KEYS, are broadcast to tell how many parts. Parts go by
    the place of a row in its table, so rows must come from a table.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    parts, part = fresh(rows.select("*", *[F.lit(0).alias(c) for c in keyed.columns if c not in on]), "parts", "part")
    many = keyed.withColumn(parts, F.when(F.col(count) * HOT_KEYS > total + HOT_KEYS, F.ceil(F.col(count) * HOT_KEYS / (total + HOT_KEYS))).otherwise(1).cast("int"))
    hot = F.broadcast(many.where(F.col(parts) > 1).select(*on, parts))
    dealt = rows.join(hot, on, "left").withColumn(part, F.pmod(F.monotonically_increasing_id(), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    each = many.withColumn(part, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    return dealt.join(each, [*on, part]).drop(part)
