"""SimHash near-duplicates by deletion-variant signatures (operator 4).

A fingerprint has 64 bits.  Cut into two segments of 32, two fingerprints that differ in at most
three bits differ in at most one bit of one of the segments; then they agree on that segment with
one bit masked.  So every *distinct* fingerprint is indexed under its 2 x 32 one-wildcard segment
variants, equal keys meet by one shuffle, and what meets is verified on all 64 bits.

Skew: copies are one fingerprint (pre-aggregated before the index).  A segment value that more than
``HOT`` distinct fingerprints share sends its variants to a second cut of the same kind over the
other segment (two halves of 16 bits, one wildcard each); such a group has at most 2^18 members by
construction.  Inside a group a breadth-first search over what is still unlinked gives a spanning
forest, never all pairs, so links between different texts are kept and the output stays linear.

Shuffles: the fingerprint table (for distinct values), 64 narrow rows per distinct fingerprint, the
links, and the join of components back to documents by fingerprint (a plain equi-join, which adaptive
execution splits at hot fingerprints).  Tables that are read twice lie in the shared folder.

Defined results: null text has no words, fingerprint zero, and zero links like any other value; texts of
one or two words are one shingle; a null id never becomes a component's name; repeated rows stay; other
columns, whatever their names, are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import connected_components, free_names, tidied
from quern.shared import drop_table, shared_table

SHINGLE, SEED, MAX_BITS, HOT = 3, 42, 3, 1 << 16
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """The fingerprint of a whole text (UTF-8), as an unsigned integer."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split() if text else []  # bytes: A-Z only; \x20 and \x09-\x0D only
    n = len(words) - k + 1
    if not words:
        return 0
    if n <= 1:
        return h(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        values = [h(line[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)]
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``fp`` (long, the 64 bits) of every row: a narrow map."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    want = StructType([*[StructField(k, df.schema[k].dataType) for k in keys], StructField("fp", LongType())])
    n = len(keys)

    @tidied
    def run(batches):
        schema = to_arrow_schema(want)
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(n)], np.uint64).view(np.int64)
            columns = [batch.column(i).cast(schema.field(i).type) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps)], names=schema.names)

    return df.select(*keys, F.col(text).cast("binary").alias("__text")).mapInArrow(run, want)


def _linked(values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest over positions of ``values`` that differ in at most MAX_BITS bits."""
    rest, out = np.arange(len(values)), []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(values[rest] ^ values[x]) <= MAX_BITS
            if near.any():
                found = rest[near].tolist()
                out += [(x, y) for y in found]
                front += found
                rest = rest[~near]
    return out


@tidied
def _verify(batches):
    """Rows (key, fp) sorted by key -> links (u, v) of fingerprints, group by group."""
    key = fp = np.empty(0, np.int64)

    def links(key, fp):
        cut = np.flatnonzero(np.diff(key)) + 1
        start = np.concatenate(([0], cut))
        size = np.diff(np.concatenate((start, [len(key)])))
        two = start[size == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= MAX_BITS
        u, v = [a[near]], [b[near]]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            pairs = _linked(fp[s : s + n].view(np.uint64))
            if pairs:
                x = np.array(pairs, np.int64) + s
                u.append(fp[x[:, 0]])
                v.append(fp[x[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    for batch in batches:
        key = np.concatenate((key, batch.column(0).to_numpy()))
        fp = np.concatenate((fp, batch.column(1).to_numpy()))
        if len(key) and key[0] != key[-1]:
            last = int(np.searchsorted(key, key[-1]))  # the last group may go on
            yield links(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
    if len(key):
        yield links(key, fp)


def _bit(p):
    return F.call_function("shiftleft", F.lit(1).cast("long"), p)


def _variant(value, p, tag):
    """The key of ``value`` (a column of at most 32 bits) with bit ``p`` masked; ``tag`` tells segments apart."""
    return tag * F.lit(1 << 40) + p.cast("long") * F.lit(1 << 33) + value.bitwiseAND(F.bitwise_not(_bit(p)))


def _each(bits: int, f):
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), f)


def near_links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """``distinct`` (fp long, no value twice) -> (u, v): enough links for the classes of near fingerprints."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    two = [F.struct(F.lit(i).cast("long").alias("s"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(((low, high), (high, low)))]
    segments = distinct.select("fp", F.explode(F.array(*two)).alias("g")).select("fp", "g.*")
    # bit p of "split": the group under the variant with bit p masked holds a common segment value
    common = segments.groupBy("s", "x").count().where(F.col("count") > hot)
    every = F.struct("x", F.lit(0xFFFFFFFF).alias("split"))
    beside = _each(32, lambda p: F.struct(F.col("x").bitwiseXOR(_bit(p)).alias("x"), _bit(p).alias("split")))
    common = common.select("s", F.explode(F.concat(F.array(every), beside)).alias("g")).groupBy("s", "g.x").agg(F.bit_or("g.split").alias("split"))
    segments = segments.join(common, ["s", "x"], "left").na.fill(0, ["split"])

    def finer(key, half, tag):
        return lambda q: F.xxhash64(key, _variant(half, q, tag))

    def keys(p):
        key = _variant(F.col("x"), p, F.col("s"))
        halves = [F.shiftrightunsigned(F.col("y"), 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in (0, 1)]
        second = F.concat(*[_each(16, finer(key, h, F.lit(i).cast("long"))) for i, h in enumerate(halves)])
        return F.when(F.col("split").bitwiseAND(_bit(p)) != 0, second).otherwise(F.array(key))

    keyed = segments.select(F.explode(F.flatten(_each(32, keys))).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "u long, v long")


def near_classes(df: DataFrame, key: str, text: str, rows: str | None = None) -> DataFrame:
    """``key``, ``fp`` (long), ``component``: the smallest key among the rows reachable by near fingerprints, and ``class``.

    ``class`` is the smallest fingerprint of those rows; a key of several rows can be the smallest of more than one class.  ``rows`` is
    another column to keep.  If a column kept has one of these names, an underscore follows the new one.
    """
    kept = [key, *([rows] if rows else [])]
    fp, component, number = free_names(kept, "fp", "component", "class")
    named = [f"k{i}" for i in range(len(kept))]
    fps = shared_table(fingerprints(df.select(*[F.col(c).alias(k) for c, k in zip(kept, named, strict=True)], F.col(text).alias("text")), named, "text"), "fingerprints")
    distinct = shared_table(fps.groupBy("fp").agg(F.min("k0").alias("least")), "distinct")
    comp = connected_components(near_links(distinct.select("fp")))
    classes = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("least").alias("name"))
    names = shared_table(classes.join(least, "component").select("fp", F.col("name").alias("component"), F.col("component").alias("class")), "names")
    drop_table(comp)
    drop_table(distinct)
    return fps.join(names, "fp").select(*[F.col(k).alias(c) for c, k in zip(kept, named, strict=True)], F.col("fp").alias(fp), F.col("component").alias(component), F.col("class").alias(number))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_classes(docs, "doc_id", "text").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
