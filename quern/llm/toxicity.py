"""Toxicity scores from subword-bag embeddings (operator 5).

A word is the bag of its character 3-grams to 5-grams and itself, each hashed to one of ``BUCKETS`` vectors of ``DIM``
numbers; a text is the average of its words' averages, and a linear softmax over two classes reads it.  Vectors and
softmax are trained jointly by Adam in numpy, at a rate that falls to zero; a misspelling that no training text holds shares most n-grams, and so
most of its vector, with the word it stands for.

As averages and softmax are linear, a trained word is one number (its pull on the logit); a text's score is the
average of those numbers.  Scoring is a narrow map over the documents with a bounded cache of words; the model (the
pull of each bucket, ``BUCKETS`` numbers) is broadcast and its size is fixed.

Training uses at most ``MAX_ROWS`` labelled rows and ``MAX_CHARS`` characters of each class, those whose id hashes lowest (a bound on
the fit alone, the same at every size; every text is read whole or not at all), and only rows whose crc32(id as text) mod 4 is not 2.  Only the text is looked at.

Defined results: null text counts as empty; a text without words gets the score of the bias alone; labels that are null
are ignored and of repeated labels the higher counts; without both classes every score is the share of toxic labels (0
without labels); repeated rows are scored alike; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import free_names, tidied

#: Labelled rows of each class to fit on at most; held-out remainder of crc32 mod FOLDS; decision threshold.
MAX_ROWS, FOLDS, HELD_OUT, THRESHOLD = 3000, 4, 2, 0.3
#: Characters of each class to fit on at most: rows beyond that, in the order of their ids' hashes, are not fitted on.
MAX_CHARS = 60_000_000
HASHES = 1 << 40
BUCKET_BITS, DIM, SIZES = 18, 4, (3, 4, 5)
BUCKETS = 1 << BUCKET_BITS
STEPS, RATE, DECAY, SEED = 200, 0.1, 5e-6, 7
CACHE_WORDS, CACHE_CHARS, BATCH_BYTES, WORDS_AT_ONCE = 250_000, 48, 2 << 20, 8192
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def plain(token: str) -> str:
    """A word as the model sees it: lower case, without marks at its ends."""
    word = token.lower()
    if word.isalpha():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while a < b and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams, its ends marked, and of the word itself; word by word, and how many each has."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(end, size) - np.arange(len(codes))  # characters from here to the word's end
    power = _P ** np.arange(int(size.max()), dtype=np.uint64)
    hashes, of = [np.add.reduceat(codes * power[np.repeat(size, size) - left], end - size) * _Q], [np.arange(len(words))]
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h = h * _P + codes[at + j]
        hashes.append((h + np.uint64(n)) * _Q)
        of.append(owner[at])
    of = np.concatenate(of)
    h = np.concatenate(hashes)
    h ^= h >> np.uint64(29)
    order = np.argsort(of, kind="stable")
    return ((h * _P) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)[order], np.bincount(of, minlength=len(words))


def fit(texts: list[str], toxic: list[int], weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The pull of each bucket and the bias, from texts, their classes and their weights."""
    vocabulary: dict[str, int] = {}
    token_of: dict[str, int] = {}
    docs, words, share = [], [], []
    for d, text in enumerate(texts):
        here, parts = [], []
        for token, count in Counter(text.split()).items():
            w = token_of.get(token)
            if w is None:
                word = plain(token)
                w = token_of[token] = vocabulary.setdefault(word, len(vocabulary)) if word else -1
            if w >= 0:
                here.append(w)
                parts.append(1 + math.log(count))
        docs.append(np.full(len(here), d, np.int32))
        words.append(np.array(here, np.int32))
        share.append(np.array(parts) / max(1.0, sum(parts)))
    del token_of
    docs, words, share = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (docs, words, share))
    vocabulary = list(vocabulary)
    found = [features(vocabulary[k : k + WORDS_AT_ONCE]) for k in range(0, len(vocabulary), WORDS_AT_ONCE)]
    gram, size = (np.concatenate(x) if found else np.zeros(0, np.int32) for x in ([g for g, _ in found], [n for _, n in found]))
    del vocabulary, found
    start = np.concatenate(([0], np.cumsum(size, dtype=np.int64)[:-1])) if len(size) else np.zeros(0, np.int64)
    y = np.array(toxic, np.float64)
    used = np.flatnonzero(np.bincount(gram, minlength=BUCKETS))  # buckets that no training word has keep a pull of zero
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    gram = place[gram]

    rng = np.random.default_rng(SEED)
    model = {"E": rng.normal(0, 0.05, (len(used), DIM)), "U": rng.normal(0, 0.5, (DIM, 2)), "b": np.zeros(2)}
    model["b"][1] = np.log(max(1e-6, (weight * y).sum()) / max(1e-6, (weight * (1 - y)).sum()))
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    weight = weight / weight.sum()
    for step in range(1, STEPS + 1):
        u = model["U"][:, 1] - model["U"][:, 0]
        pull = np.add.reduceat((model["E"] * u).sum(axis=1, dtype=np.float32)[gram], start) / size if len(size) else np.zeros(0)
        logit = SCALE * np.bincount(docs, share * pull[words], len(y)) + model["b"][1] - model["b"][0]
        p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        err = weight * (p - y)
        back = SCALE * np.bincount(words, share * err[docs], len(size)) / size
        g = np.zeros(len(used))
        for k in range(0, len(size), 20_000):  # bounds what bincount copies
            some = slice(start[k], start[k + 20_000] if k + 20_000 < len(size) else len(gram))
            g += np.bincount(gram[some], np.repeat(back[k : k + 20_000], size[k : k + 20_000]), len(used))
        du = (model["E"] * g[:, None]).sum(axis=0)  # no matrix product: its threads cost more than they save
        grad = {"E": np.outer(g, u), "U": np.stack([-du, du], 1), "b": np.array([-err.sum(), err.sum()])}
        grad["E"] += DECAY * model["E"]
        for k, v in model.items():
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            v -= RATE * (1 - (step - 1) / STEPS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    pulls = np.zeros(BUCKETS, np.float32)
    pulls[used] = SCALE * (model["E"] * (model["U"][:, 1] - model["U"][:, 0])).sum(axis=1)
    return pulls, float(model["b"][1] - model["b"][0])


#: Factor between an average and the logit, so that numbers of ordinary size are learnt.
SCALE = 50.0


class Scorer:
    """A trained model with a bounded cache of the pull of each token (None: no word in it)."""

    def __init__(self, pulls: np.ndarray, bias: float):
        self.pulls, self.bias, self.known = pulls, bias, {}

    def pull(self, tokens: list[str]) -> list[float | None]:
        out: list[float | None] = []
        for at in range(0, len(tokens), WORDS_AT_ONCE):
            words = [plain(t) for t in tokens[at : at + WORDS_AT_ONCE]]
            gram, size = features([w for w in words if w])
            values = iter((np.add.reduceat(self.pulls[gram].astype(np.float64), np.cumsum(size) - size) / size).tolist() if len(size) else ())
            out += [next(values) if w else None for w in words]
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        if len(self.known) >= CACHE_WORDS:
            self.known = {}
        known = self.known
        counts = [Counter((t or "").split()) for t in texts]
        new = list({t for c in counts for t in c if t not in known})
        here = dict(zip(new, self.pull(new), strict=True))
        out = []
        for c in counts:
            total = weights = 0.0
            for token, count in c.items():
                value = known[token] if token in known else here[token]
                if value is not None:
                    part = 1.0 if count == 1 else 1 + math.log(count)
                    weights += part
                    total += part * value
            logit = self.bias + (total / weights if weights else 0.0)
            out.append(1 / (1 + math.exp(-min(50.0, max(-50.0, logit)))))
        known.update((t, v) for t, v in here.items() if len(t) <= CACHE_CHARS)
        return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, float]:
    """Fit on at most MAX_ROWS labelled rows and MAX_CHARS characters of each class, and the shares of the classes over all labelled rows."""
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS
    known = (
        labels.select(F.col(key).alias("id"), F.col(label).alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (fold != HELD_OUT))
        .groupBy("id")
        .agg((F.max("y") > 0).cast("int").alias("y"))
    )
    # ids alone are ranked; the texts of those chosen follow by a join on the id
    order = Window.partitionBy("y").orderBy(F.pmod(F.xxhash64("id"), F.lit(HASHES)), "id")
    sizes = {0: 0, 1: 0} | {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    # hashes beyond this have no chance to be among the MAX_ROWS lowest (ten standard deviations), however many tasks there are
    for y, n in sizes.items():
        share = min(1.0, (MAX_ROWS + 10 * math.sqrt(MAX_ROWS)) / max(1, n))
        known = known.where((F.col("y") != y) | (F.pmod(F.xxhash64("id"), F.lit(HASHES)) < int(share * HASHES)))
    picked = F.broadcast(known.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= MAX_ROWS))
    sample = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(picked, "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"), F.min("nth").alias("nth"))
    until = Window.partitionBy("y").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sample = sample.withColumn("until", F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).over(until)).where(F.col("until") <= MAX_CHARS)

    @tidied
    def run(batches):
        rows = sorted((t or "", y) for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        got = {y: sum(1 for _, z in rows if z == y) for y in (0, 1)}
        if got[0] and got[1]:
            pulls, bias = fit([t for t, _ in rows], [y for _, y in rows], np.array([sizes[y] / got[y] for _, y in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([pulls.astype("<f4").tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["pulls", "bias"])

    # the bounded sample is fitted in one task; the driver gets the BUCKETS pulls
    model = sample.select("text", "y").repartition(1).mapInArrow(run, "pulls binary, bias double").collect()
    if model:
        return np.frombuffer(model[0]["pulls"], "<f4"), model[0]["bias"]
    share = sizes[1] / max(1, sizes[0] + sizes[1])
    return np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``score`` of every row: a narrow map.  If a key has that name, an underscore follows the new one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the data
    want = StructType([*[StructField(k, docs.schema[k].dataType) for k in keys], StructField(free_names(keys, "score")[0], DoubleType())])
    n = len(keys)
    read = keys.index(text) if text in keys else n  # the text goes to Python once

    @tidied
    def run(batches):
        scorer, schema = Scorer(*shared.value), to_arrow_schema(want)
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                texts, size = [], 0
                while start + len(texts) < batch.num_rows and size < BATCH_BYTES:
                    texts.append(batch.column(read)[start + len(texts)].as_py())
                    size += len(texts[-1] or "")
                part = batch.slice(start, len(texts))
                columns = [part.column(i).cast(schema.field(i).type) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scorer.scores(texts), pa.float64())], names=schema.names)
                start += len(texts)

    return docs.select(*keys, *([F.col(text)] if read == n else [])).mapInArrow(run, want)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; learnt from labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    return scored(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
