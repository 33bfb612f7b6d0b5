"""Packing token streams into fixed sequences: concatenate and cut (operator 8).

Pass one tokenises every document once and writes the ids to a table in the shared folder, each row with
the number of its write task ("part") and the ids that came before it in that part.  Totals by part, one row
for each write task, give prefix sums: the global offset of every part and so of every document.  Pass two reads
the table and cuts each document at the multiples of the window; a piece is a boundary record (document, start,
length, sequence, offset) with its ids.  Neither pass shuffles a token: the bases are broadcast if there are at most
``FEW_PARTS`` parts, and joined by a shuffle of the table beyond that.

The table settles what a retry could change (which task a row fell to), so a lost executor in pass two
repeats reads only.  Nothing but the highest part number is collected: the totals, one row for each write task, are summed up
by windows and meet the table in a join on the part.

Every sequence but the last is full; the last is padded to the window unless its length is a power of two, so the
padding of the whole corpus is below one window.

Defined results: null text counts as empty and is one end id; a null key is kept; repeated rows are packed each;
the literal of an added token of the tokenizer file (``<|endoftext|>``) inside a text is that token, as the tokenizers library
reads it; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import tidied
from quern.shared import shared_table

WINDOW, END_ID = 2048, 1
BATCH_BYTES = 4 << 20
#: Parts whose totals one task sums up; parts whose bases are broadcast (16 MB of numbers), more of them are joined by a shuffle.
LEVEL, FEW_PARTS = 10_000, 1_000_000


#: The worker's encoding, by vocabulary.
_CODERS: dict[int, object] = {}


def _encoding(raw: bytes, pattern: str, special: dict[str, int]):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def tokenized(df: DataFrame, key: str, text: str, ranks_path: str, pattern: str, end_id: int | None = END_ID, special: dict[str, int] | None = None) -> DataFrame:
    """A shared table (key, part int, before long, n long, ids binary) of every row's ids and the end id.

    ``ranks_path`` holds a byte-level vocabulary as ranks, which gives the ids of the same vocabulary's tokenizer file.
    ``special`` are its added tokens with their ids; without them, their literals are ordinary text.
    """
    from pyspark import TaskContext

    with open(ranks_path, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, some MB whatever the data
    end = b"" if end_id is None else end_id.to_bytes(4, "little")
    kind = df.schema[key].dataType.simpleString()

    @tidied
    def run(batches):
        mark = hash((raw.value, *sorted((special or {}).items())))
        if mark not in _CODERS:
            _CODERS.clear()
            _CODERS[mark] = _encoding(raw.value, pattern, special or {})
        coder = _CODERS[mark]
        encode = functools.partial(coder.encode, allowed_special="all") if special else coder.encode_ordinary
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                texts, size = [], 0
                while start + len(texts) < batch.num_rows and size < BATCH_BYTES:
                    texts.append(batch.column(1)[start + len(texts)].as_py() or "")
                    size += len(texts[-1])
                ids = [array("I", encode(x)).tobytes() + end for x in texts]
                n = [len(x) // 4 for x in ids]
                sums = [before, *(before + x for x in itertools.accumulate(n))]
                before = sums.pop()
                keys = batch.column(0).slice(start, len(ids))
                yield pa.RecordBatch.from_arrays([keys, pa.array([part] * len(n), pa.int32()), pa.array(sums, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["key", "part", "before", "n", "ids"])
                start += len(ids)

    return shared_table(df.select(key, F.col(text).alias("__text")).mapInArrow(run, f"key {kind}, part int, before long, n long, ids binary"), "ids")


def pack(table: DataFrame, key: str, window: int = WINDOW) -> DataFrame:
    """Pieces of the rows of ``tokenized``: key, start, length, ids, doc_tokens, sequence_id, offset (longs; ids binary).

    The second of the two passes: the totals of the parts, a row each, are summed up in order of the part by a window, and each row gets
    what its part starts at by a join on the part.
    """
    totals = table.groupBy("part").agg(F.sum("n").alias("total"))
    # prefix sums in two levels, so that no task orders more than LEVEL parts or the totals of the LEVEL-th of them
    totals = totals.withColumn("level", F.floor(F.col("part") / LEVEL))
    levels = totals.groupBy("level").agg(F.sum("total").alias("of_level"))
    before = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("until", F.coalesce(F.sum("of_level").over(before), F.lit(0))).select("level", "until")
    within = Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("inside", F.coalesce(F.sum("total").over(within), F.lit(0))).join(levels, "level").select("part", (F.col("until") + F.col("inside")).alias("base"))
    kind = table.schema["key"].dataType.simpleString()

    @tidied
    def run(batches):
        names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            rows, pieces, size = [], [[] for _ in names[1:]], 0
            starts, ns = (batch.column(i).to_pylist() for i in (1, 2))

            def flush():
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(x, pa.binary() if k == 2 else pa.int64()) for k, x in enumerate(pieces))], names=names)  # noqa: B023

            for i in range(batch.num_rows):
                base, n = starts[i], ns[i]
                ids = memoryview(batch.column(3)[i].as_buffer())
                at = 0
                while at < n:
                    sequence, offset = divmod(base + at, window)
                    length = min(n - at, window - offset)
                    rows.append(i)
                    for column, value in zip(pieces, (at, length, bytes(ids[4 * at : 4 * (at + length)]), n, sequence, offset), strict=True):
                        column.append(value)
                    size += 4 * length + 64
                    at += length
                    if size >= BATCH_BYTES:
                        yield flush()
                        rows, pieces, size = [], [[] for _ in names[1:]], 0
            if rows:
                yield flush()

    parts = (table.agg(F.max("part")).first()[0] or 0) + 1
    if parts <= FEW_PARTS:
        bases = F.broadcast(bases)
    placed = table.join(bases, "part").select("key", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    out = placed.mapInArrow(run, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file, with their ids."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens that match more or less than their literal")
    return {t["content"]: t["id"] for t in added}


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of every document, with digests in place of the ids."""
    import public_tokenizers

    special = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    table = tokenized(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)
    return pack(table, "doc_id").select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
