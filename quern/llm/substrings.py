"""Duplicate passages by relative Lempel-Ziv parsing against reference blocks (operator 7).

A window is 13 consecutive words of one document; a word goes if a window that covers it also starts in a document with a
smaller id.  The reference is all text that smaller documents hold, as an index in blocks: a block has the passages around one
anchor, each with its document and position.  A document is factored greedily against every block that its own anchors name:
at a place whose 13 words the block holds, the factor is carried on word by word along the reference passage, as far as the two
agree; the next place looked at is the first window that the factor does not hold, so windows across a factor's end are checked.
Factors of at least 13 words are duplicate spans, and neighbours that go on in the same place of the same document are one factor.
What decides is words: a hash only names the block where they are compared.

A window's anchor is the least hash of its 5-grams.  It depends on the window alone, so equal windows name the same block and no
repeat is lost; consecutive windows of one anchor (five on average) are a passage, and passages overlap by 12 words.

1. Anchors meet in one shuffle (anchor and a number of the row alone), which tells those of more than one document.  Most occur in one and end here.
2. The passages around the others go to their blocks with their words, in order of the id, and are factored there.
3. The factors return to their documents, which are cut.

Skew: an anchor that occurs more than once in a chunk of documents, and equal passages of a chunk, are settled there, so a passage
in a third of all documents is one row a chunk.  A common anchor with many different passages would be one large block: the
``FREQUENT`` most common anchors at most (those in more documents than ``HOT`` and than one in FREQUENT of all pairs of an anchor
and a document, so a list of 32 MB at most) get a block for each window in place of one for all.

Defined results: null text has no words; ids are integers, any other type is an error; null ids are never smaller or larger than
another, so such rows stay whole; rows that share an id are judged each and never against each other (a row is told from others of
its id by a hash of both, and what equal rows would send is sent once a chunk, so an id of a third of the rows is no hot key); other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quern.llm.common import free_names, tidied
from quern.shared import drop_table, shared_table

WINDOW, ANCHOR = 13, 5
#: Windows of a passage at most; anchors and passages of a chunk; rows of an output batch.
LONGEST, ANCHORS_AT_ONCE, PASSAGES_AT_ONCE, BATCH_ROWS = 64, 400_000, 60_000, 20_000
#: Documents of an anchor from which it may be common; common anchors at most.
HOT, FREQUENT = 4096, 4_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
#: Names of the columns that ``dedup`` adds.
ADDED = ("__words", "__removed", "__spans", "__kept")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def word_codes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest as h

    return np.fromiter(map(h, words), np.uint64, len(words))


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    size = len(words) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = out * _P + words[i : i + size]
    return _mix(out)


def anchors(words: list[bytes]) -> np.ndarray:
    """The anchor of each window, in order."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(_runs(word_codes(words), ANCHOR), WINDOW - ANCHOR + 1)
    return grams.min(axis=1).view(np.int64)


def passages(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows of one anchor, ``LONGEST`` at most: the first window of each, and how many it has."""
    if not len(found):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    size = np.diff(np.append(start, len(found)))
    if size.max() > LONGEST:
        parts = -(-size // LONGEST)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + nth * LONGEST
        size = np.diff(np.append(start, len(found)))
    return start, size


#: Kinds of rows of an anchor: to be told whether another chunk has it, known to be in several documents of the chunk, and
#: the documents for which that is settled.
OPEN, SEVERAL, SETTLED = 0, 1, 2


@tidied
def _anchors(batches):
    """(row, text bytes) -> (anchor, row, mark): each anchor of a document once; mark is 4 * documents + kind."""
    for batch in batches:
        numbers = batch.column(0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            found, rows, size = [], [], 0
            while at < batch.num_rows and size < ANCHORS_AT_ONCE:
                a = anchors((batch.column(1)[at].as_py() or b"").split())
                start, _ = passages(a)
                a = np.unique(a[start])
                found.append(a)
                rows.append(np.full(len(a), at, np.int64))
                size += len(a)
                at += 1
            anchor, row = np.concatenate(found), numbers[np.concatenate(rows)].astype(np.int64)
            if not len(row):
                continue
            order = np.lexsort((row, anchor))
            anchor, row = anchor[order], row[order]
            new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            once = new | np.concatenate(([True], row[1:] != row[:-1]))  # equal rows count once
            anchor, row, new = anchor[once], row[once], new[once]
            first = np.flatnonzero(new)
            documents = np.diff(np.append(first, len(row)))
            several = (documents > 1)[np.cumsum(new) - 1]
            told = anchor[first], row[first], 4 * documents + np.where(documents > 1, SEVERAL, OPEN)
            settled = anchor[several], row[several], np.full(int(several.sum()), 4 + SETTLED)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(told, settled, strict=True)], names=["anchor", "row", "mark"])


def _shared(batches):
    """Rows of ``_anchors`` sorted by anchor -> (row, anchor, n): the anchors of each document that another document has, too.

    Beside them, without a row: each anchor of more than HOT documents and their number, and the number of all pairs.
    Of an anchor whose rows go on in the next batch only its first row is kept, as every other one has a partner.
    """
    total = 0
    last, first, documents, rows = None, None, 0, 0  # the anchor that may go on: its first row, if open and alone; its sums

    def out(row, anchor, n):
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(anchor, pa.int64()), pa.array(n, pa.int64())], names=["row", "anchor", "n"])

    for batch in batches:
        anchor, row, mark = (batch.column(i).to_numpy() for i in range(3))
        done = mark & 3 == SETTLED
        if done.any():
            yield out(row[done], anchor[done], np.zeros(int(done.sum()), np.int64))
            anchor, row, mark = anchor[~done], row[~done], mark[~done]
        if not len(row):
            continue
        n, kind = mark >> 2, mark & 3
        total += int(n.sum())
        start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        sums = np.add.reduceat(n, start)
        count = np.diff(np.append(start, len(row)))
        several = np.maximum.reduceat(kind, start) == SEVERAL
        goes_on = anchor[0] == last
        if goes_on:
            sums[0] += documents
            count[0] += rows
        elif documents > HOT:
            yield out([None], [last], [documents])
        partner = (count > 1) | several
        if goes_on and first is not None and partner[0]:
            yield out([first], [last], [0])
            first = None
        take = partner[np.repeat(np.arange(len(start)), np.diff(np.append(start, len(row))))] & (kind == OPEN)
        if take.any():
            yield out(row[take], anchor[take], np.zeros(int(take.sum()), np.int64))
        hot = np.flatnonzero(sums[:-1] > HOT)
        if len(hot):
            yield out([None] * len(hot), anchor[start[hot]], sums[hot])
        if len(start) > 1 or not goes_on:
            first = None if partner[-1] else int(row[-1])
        last, documents, rows = anchor[-1], int(sums[-1]), int(count[-1])
    if documents > HOT:
        yield out([None], [last], [documents])
    yield out([None], [None], [total])


def shared_anchors(source: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(key, row, text) -> a table to drop, (row, anchors) of the documents that share any, and the common anchors, sorted."""
    rows = source.where("key is not null").select("row", "text").mapInArrow(_anchors, "anchor long, row long, mark long")
    rows = rows.repartition(F.when(F.col("mark") % 4 == SETTLED, F.xxhash64("row")).otherwise(F.col("anchor"))).sortWithinPartitions("anchor")
    table = shared_table(rows.mapInArrow(_shared, "row long, anchor long, n long"), "anchors")
    pairs = table.where("row is null and anchor is null").agg(F.sum("n")).first()[0] or 0
    common = table.where(F.col("row").isNull() & F.col("anchor").isNotNull() & (F.col("n") > max(HOT, pairs // FREQUENT))).select("anchor")
    common = np.sort(common.toArrow().column(0).to_numpy().astype(np.int64))  # FREQUENT at most, as each stands for a FREQUENT-th of all
    return table, table.where("row is not null").groupBy("row").agg(F.collect_set("anchor").alias("anchors")), common


_PASSAGE = "block long, key long, row long, at int, words binary, n int, source long, source_at int"
_FACTOR = "key long, row long, at int, n int, source long, source_at int"


def _passages(common):
    """(key, row, text, anchors) -> the passages around these anchors, to their blocks; those settled in the chunk have a source."""

    @tidied
    def run(batches):
        hot = common.value
        for batch in batches:
            keys, rows = (batch.column(i).to_pylist() for i in range(2))
            at = 0
            while at < batch.num_rows:
                texts: dict[bytes, tuple] = {}  # by words: block and the places (key, row, first word), each once
                size = 0
                while at < batch.num_rows and size < PASSAGES_AT_ONCE:
                    words = (batch.column(2)[at].as_py() or b"").split()
                    a = anchors(words)
                    start, n = passages(a)
                    wanted = np.isin(a[start], batch.column(3)[at].values.to_numpy())
                    start, n = start[wanted], n[wanted]
                    block = a[start]
                    single = np.isin(block, hot) if len(hot) else np.zeros(len(block), bool)
                    for i, m, b, one in zip(start.tolist(), n.tolist(), block.tolist(), single.tolist(), strict=True):
                        for j, k in ((x, WINDOW) for x in range(i, i + m)) if one else ((i, m + WINDOW - 1),):
                            text = b" ".join(words[j : j + k])
                            place = (keys[at], rows[at], j)
                            if text in texts:
                                texts[text][1][place] = None
                            else:
                                texts[text] = (_window_block(text) if one else b, {place: None})
                        size += m if one else 1
                    at += 1
                out: list[tuple] = []
                for text, (block, places) in texts.items():
                    least = min(places)
                    n = text.count(b" ") + 1
                    for key, row, i in places:
                        if key == least[0]:
                            out.append((block, key, row, i, text, n, None, None))
                        else:  # a smaller document of this chunk holds the whole passage; any block will do
                            out.append((row ^ key, key, row, i, None, n, least[0], least[2]))
                    if len(out) >= BATCH_ROWS:
                        yield _rows(out, _PASSAGE)
                        out = []
                if out:
                    yield _rows(out, _PASSAGE)

    return run


def _window_block(text: bytes) -> int:
    from xxhash import xxh64_intdigest as h

    return int(np.uint64(h(text, 1)).view(np.int64))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])


class Block:
    """The passages of one block that were read so far, in order of their documents, and the places of their windows."""

    def __init__(self):
        self.passages: list[tuple[int, int, list[bytes]]] = []
        self.places: dict[bytes, tuple[int, int]] = {}

    def factors(self, key: int, at: int, text: bytes) -> list[tuple[int, int, int, int]]:
        """Greedy factors of a passage against those of smaller documents: (at, words, source, its place there).  It is indexed, then."""
        words = text.split(b" ")
        end = len(words) - WINDOW
        places, known = self.places, self.passages
        out, fresh, i = [], [], 0
        while i <= end:
            window = b" ".join(words[i : i + WINDOW]) if end else text
            place = places.get(window)
            if place is None:
                fresh.append((window, i))
                i += 1
                continue
            source, source_at, other = known[place[0]]
            if source == key:  # its own document's; not indexed twice
                i += 1
                continue
            a, b = i + WINDOW, place[1] + WINDOW
            while a < len(words) and b < len(other) and words[a] == other[b]:
                a += 1
                b += 1
            out.append((at + i, a - i, source, source_at + place[1]))
            i = a - WINDOW + 1  # the first window that the factor does not hold
        if fresh:
            n = len(known)
            known.append((key, at, words))
            for window, i in fresh:
                places.setdefault(window, (n, i))
        return out


@tidied
def _factors(batches):
    """Passages sorted by block and key -> the factors of each."""
    last, block, out = None, None, []
    for batch in batches:
        for b, key, row, at, text, n, source, source_at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text is None:
                out.append((key, row, at, n, source, source_at))
                continue
            if b != last:
                last, block = b, Block()
            out += [(key, row, *f) for f in block.factors(key, at, text)]
        if len(out) >= BATCH_ROWS:
            yield _rows(out, _FACTOR)
            out = []
    if out:
        yield _rows(out, _FACTOR)


def factored(source: DataFrame) -> DataFrame:
    """(key, row, text) -> a shared table of the factors of every document: key, row, at, n, source, source_at."""
    table, wanted, common = shared_anchors(source)
    hot = source.sparkSession.sparkContext.broadcast(common)  # 32 MB at most
    found = source.where("key is not null").join(wanted, "row").select("key", "row", "text", "anchors").mapInArrow(_passages(hot), _PASSAGE)
    found = found.repartition("block").sortWithinPartitions("block", "key").mapInArrow(_factors, _FACTOR)
    out = shared_table(found, "factors")
    drop_table(table)
    return out


def spans(found: list[dict]) -> list[tuple[int, int, int, int]]:
    """A document's factors in order, neighbours that go on in the same place of the same source joined."""
    out: list[list[int]] = []
    for at, n, source, source_at in sorted((f["at"], f["n"], f["source"], f["source_at"]) for f in found):
        if out:
            a, m, s, b = out[-1]
            if s == source and a - b == at - source_at and at <= a + m:
                out[-1][1] = max(m, at + n - a)
                continue
        out.append([at, n, source, source_at])
    return [tuple(x) for x in out]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with, after its own columns, those of ``ADDED``: words, words removed (longs), spans, and the words outside all
    spans, joined by one space.  If ``docs`` has a column of such a name, underscores follow until the name is free.

    A span has start and length in words, and the document and word where its words also stand; spans may overlap where one
    source ends inside another's words.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{key} must be an integer column, as smaller ids decide; it is {docs.schema[key].dataType.simpleString()}")
    span = StructType([StructField("start", IntegerType()), StructField("length", IntegerType()), StructField("source", LongType()), StructField("source_start", IntegerType())])
    added = free_names(docs.columns, *ADDED)
    kinds = (LongType(), LongType(), ArrayType(span), StringType())
    want = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in zip(added, kinds, strict=True))])
    column, n = docs.columns.index(text), len(docs.columns)
    row_of = F.xxhash64(F.col(key), F.col(text))
    factors = factored(docs.select(F.col(key).cast("long").alias("key"), row_of.alias("row"), F.col(text).cast("binary").alias("text")))
    k, r, f = free_names(docs.columns, "__key", "__row", "__factors")
    found = factors.groupBy(F.col("key").alias(k), F.col("row").alias(r)).agg(F.collect_set(F.struct("at", "n", "source", "source_at")).alias(f))

    @tidied
    def run(batches):
        schema = to_arrow_schema(want)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                start, size, counts, removed, cut, kept = at, 0, [], [], [], []
                while at < batch.num_rows and size < 4 << 20:
                    words = (batch.column(column)[at].as_py() or "").encode().split()
                    known = spans(batch.column(n)[at].as_py() or [])
                    gone = np.zeros(len(words), bool)
                    for a, length, _, _ in known:
                        gone[a : a + length] = True
                    rest = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if known else words
                    counts.append(len(words))
                    removed.append(len(words) - len(rest))
                    cut.append([{"start": a, "length": b, "source": s, "source_start": t} for a, b, s, t in known])
                    kept.append(b" ".join(rest).decode())
                    size += len(kept[-1]) + 64
                    at += 1
                part = batch.slice(start, at - start)
                columns = [part.column(i).cast(schema.field(i).type) for i in range(n)]
                made = [pa.array(x, schema.field(n + i).type) for i, x in enumerate((counts, removed, cut, kept))]
                yield pa.RecordBatch.from_arrays([*columns, *made], schema=schema)

    left = docs.select("*", F.col(key).cast("long").alias(k), row_of.alias(r))
    return left.join(found, [k, r], "left").select(*docs.columns, f).mapInArrow(run, want)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words, removed, _, kept = ADDED
    return dedup(docs).select("doc_id", F.col(words).alias("n_words"), F.col(removed).alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))
