"""Text operators against brute force: BPE, SimHash, substrings, packing, toxicity; nulls, empty and long texts, copies, empty tables."""

import array
import hashlib
import math
import random
import re
import zlib
from unittest import mock

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import bpe, packing, simhash, stages, substrings, toxicity
from quern.llm.common import connected_components

SCHEMA = "doc_id long, text string, score double, `key` string"  # columns whose names the operators use themselves
WORD = r"[^\x20\x09-\x0D]+"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(60)
    texts = [None, "", " ", "one", "one two", "One TWO three", "a  b\t\nc", "x" * 5000, "the " * 400, say(3000)]
    texts += [say(30) + " " + passage + " " + say(30) for _ in range(6)] + [passage, passage, say(12), say(13)]
    near = say(300).split()
    for i in range(5):
        texts.append(" ".join(near[: 290 + i]))
    texts += ["<|endoftext|> it's we'll\n\n z", "😀日本 ünïcode  ", say(40)]
    rows = [(i, t, 1.0, "k") for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[12], (None, passage, 0.0, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_tiktoken_and_decodes(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = bpe.encode(docs.withColumn("t", F.col("text")), ["doc_id", "t", "key"], "text", path, public_tokenizers.PATTERN)
    rows = out.collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert array.array("I", r.ids).tolist() == known.encode_ordinary(r.t or "")
    assert all(bytes(r.decoded).decode() == (r.t or "") for r in bpe.decode(out, ["t"], "ids", path).collect())
    assert bpe.encode(none, ["doc_id"], "text", path, public_tokenizers.PATTERN).count() == 0


def test_rank_queue_one_by_one_and_all_at_once():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(1)
    pieces = ["".join(rng.choice("aabbcdé ") for _ in range(rng.randint(2, 80))).encode() for _ in range(500)] + [b"a" * 4000, b"ab" * 900]
    pieces = [p for p in pieces if p not in ranks]
    assert [array.array("I", x).tolist() for x in encoder.merge_many(pieces)] == [encoder.merge(p) for p in pieces]
    assert all(b"".join(t for i in ids for t, r in ((bytes(k), v) for k, v in ranks.items()) if r == i) == p for p, ids in [(pieces[0], encoder.merge(pieces[0]))])


ODD_TEXTS = ["\x01\x02", "~}", "a\x85b c", "it's 's  \n q", " ", "  ", "\n", "a\x1c b", "a \x1cb", " a", "a ", "a\n", "a\n\n b", "\u3000x y\u2028 z", "'s 't", "x\u00a0 y", "1 2 ３ ²", "\U0001f600 \U0001f600", "a" * 3000 + " b", ""]


@pytest.fixture(scope="module")
def byte_level():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Encoder(ranks, public_tokenizers.PATTERN)


def test_bpe_of_odd_texts_alone_and_together(byte_level):
    ranks, known, encoder = byte_level
    want = [array.array("I", known.encode_ordinary(t)).tobytes() for t in ODD_TEXTS]
    assert [bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(t) for t in ODD_TEXTS[:4]] == want[:4]  # nothing cached
    assert [encoder.encode(t) for t in ODD_TEXTS] == want
    assert encoder.encode_many([*ODD_TEXTS, None]) == [*want, b""]
    assert encoder.encode_many([]) == [] and encoder.merge_many([]) == []


@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\x85\x1c'stab~}é1")), max_size=40), max_size=4), st.sampled_from([8, 1 << 20]))
@settings(max_examples=400, deadline=None)
def test_bpe_of_any_text(byte_level, texts, at_once):
    _, known, encoder = byte_level
    with mock.patch.object(bpe, "MERGED_BYTES", at_once), mock.patch.object(bpe, "CACHE_WORDS", 3):
        for part in (texts, texts[:1], texts):
            assert encoder.encode_many(part) == [array.array("I", known.encode_ordinary(t)).tobytes() for t in part]


def test_bpe_of_another_pattern_reads_whole_texts(byte_level):
    ranks, pattern = byte_level[0], r"\w+ \w+|\s+|\w+|[^\w\s]+"  # its pre-tokens span spaces
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["one two three", "a b  c!", " x", None]
    assert bpe.Encoder(ranks, pattern).encode_many(texts) == [array.array("I", known.encode_ordinary(t or "")).tobytes() for t in texts]
    assert bpe.CUT_AT_SPACES == public_tokenizers.PATTERN


def test_bpe_runs_on_a_batch_without_any_merge_and_refuses_unknown_ids(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(spark.createDataFrame([(1, "\x01\x02")], "doc_id long, text string"), ["doc_id"], "text", path, public_tokenizers.PATTERN)
    assert bytes(bpe.decode(out, ["doc_id"], "ids", path).first().decoded) == b"\x01\x02"
    for bad in (b"\xff\xff\xff\x7f", b"\x01\x02"):
        with pytest.raises(Exception, match="ids"):
            bpe.decode(out.withColumn("ids", F.lit(bad)), ["doc_id"], "ids", path).collect()


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest as h

    words = re.findall(WORD, (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    codes = [h(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def classes(values, ids):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(values)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(values))]


def test_simhash_equals_brute_force(docs, none):
    rows = simhash.near_classes(docs, "doc_id", "text").collect()
    want = [(r[0], brute_fingerprint(r[1])) for r in corpus()]
    names = classes([f for _, f in want], [i for i, _ in want])
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component) for r in rows), key=repr)
    assert got == sorted(((i, f, n) for (i, f), n in zip(want, names, strict=True)), key=repr)
    assert simhash.near_classes(none, "doc_id", "text").count() == 0


@pytest.mark.parametrize("hot", [1 << 16, 3])
def test_near_links_with_and_without_hot_segments(spark, hot):
    rng = np.random.default_rng(1)
    values = {int(x) << 32 | 7 for x in rng.integers(0, 2**31, 60)}
    for b in rng.integers(0, 2**63, 6).tolist():
        for _ in range(12):
            x = b
            for i in rng.integers(0, 63, rng.integers(1, 5)).tolist():
                x ^= 1 << i
            values.add(x)
    values = sorted(values)
    got = {r.node: r.component for r in connected_components(simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), hot)).collect()}
    assert [got.get(v, v) for v in values] == classes(values, values)


def test_near_dedup_judges_rows_that_share_an_id_each(spark):
    rng = random.Random(7)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (4, d), (None, a), (None, a)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string").repartition(3)
    out = stages.simhash_near_dedup(spark, df, "")
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (3, c), (3, d), (None, a), (None, a)], key=repr)


def brute_removed(rows):
    rows = [(i, re.findall(WORD, t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in rows:
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            if i is not None:
                first[k] = min(i, first.get(k, i))
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_equal_brute_force(docs, none):
    out = substrings.dedup(docs)
    assert out.columns[:4] == docs.columns
    got = out.select("doc_id", "__words", "__removed", F.sha2("__kept", 256).alias("s")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_removed(corpus())
    assert sum(r[2] for r in brute_removed(corpus())) > 300
    assert substrings.dedup(none).count() == 0


def in_process(rows, batch=3, rng=None):
    """The steps of substrings in this process, shuffles by sorting: (doc_id, row, text) -> factors."""
    rng = rng or random.Random(0)

    def batches(table, n):
        return (b for b in table.combine_chunks().to_batches(max_chunksize=n))

    def table(made, like=None):
        made = list(made)
        return pa.Table.from_batches(made) if made else like

    docs = pa.table({"row": pa.array([r[1] for r in rows], pa.int64()), "text": pa.array([r[2].encode() for r in rows])})
    found = table(substrings._anchors(batches(docs, batch)))
    if found is None:
        return []
    shared = table(substrings._shared(batches(found.sort_by("anchor"), rng.randint(1, 9)))).to_pylist()
    wanted = {}
    for r in shared:
        if r["row"] is not None:
            wanted.setdefault(r["row"], []).append(r["anchor"])
    pairs = sum(r["n"] for r in shared if r["anchor"] is None)
    common = np.sort(np.array([r["anchor"] for r in shared if r["row"] is None and r["anchor"] is not None and r["n"] > max(substrings.HOT, pairs // substrings.FREQUENT)], np.int64))
    asking = [r for r in rows if r[1] in wanted]
    if not asking:
        return []
    asking = pa.table({"key": pa.array([r[0] for r in asking], pa.int64()), "row": pa.array([r[1] for r in asking], pa.int64()), "text": pa.array([r[2].encode() for r in asking]), "anchors": pa.array([wanted[r[1]] for r in asking], pa.list_(pa.int64()))})
    around = table(substrings._passages(mock.Mock(value=common))(batches(asking, batch)))
    if around is None:
        return []
    out = table(substrings._factors(batches(around.sort_by([("block", "ascending"), ("key", "ascending")]), rng.randint(1, 9))))
    return [] if out is None else out.to_pylist()


def removed(rows, factors):
    gone = {}
    for f in factors:
        gone.setdefault((f["key"], f["row"]), []).append(f)
    out = []
    for i, row, text in rows:
        words = text.split(" ") if text else []
        cut = [False] * len(words)
        for at, n, *_ in substrings.spans(gone.get((i, row), [])):
            cut[at : at + n] = [True] * n
        kept = " ".join(w for w, g in zip(words, cut, strict=True) if not g)
        out.append((i, len(words), sum(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hashes", ["own", "one for all words", "few"])
@pytest.mark.parametrize("hot", [4096, 2, 0])
@pytest.mark.parametrize("batch", [1, 4, 1000])
def test_factors_do_not_trust_hashes(monkeypatch, hashes, hot, batch):
    """Every word with one hash (one anchor in every document), few hashes, common anchors with a block a window."""
    if hashes != "own":
        few = 1 if hashes == "one for all words" else 3
        monkeypatch.setattr(substrings, "word_codes", lambda words: np.array([len(w) % few for w in words], np.uint64))
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "FREQUENT", 1000 if hot else 10**9)
    for seed in range(6):
        rng = random.Random(seed)
        vocabulary = ["a", "bb", "ccc"] if seed % 2 else [chr(97 + i) * (1 + i % 4) for i in range(12)]
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40))) for _ in range(6)]
        texts = [" ".join(rng.choice([*lines, rng.choice(vocabulary)]) for _ in range(rng.randint(0, 6))) for _ in range(25)] + ["a " * 200 + "a", "a " * 90 + "b"]
        rows = [(rng.randint(0, 20), k, t.strip()) for k, t in enumerate(texts)]
        rows += rows[:4]  # equal rows
        found = in_process(rows, batch, rng)
        assert removed(rows, found) == brute_removed([(i, t) for i, _, t in rows])
        by_row = {(i, k): t.split(" ") for i, k, t in rows}
        sources = {}
        for i, _, t in rows:
            sources.setdefault(i, []).append(t.split(" "))
        for f in found:  # every factor stands where it says, in a document of a smaller id
            words = by_row[f["key"], f["row"]][f["at"] : f["at"] + f["n"]]
            assert f["n"] >= 13 and f["source"] < f["key"]
            assert any(w[f["source_at"] : f["source_at"] + f["n"]] == words for w in sources[f["source"]])


def test_greedy_factors_are_longest_and_boundaries_are_checked():
    block, words = substrings.Block(), [f"w{i}" for i in range(60)]
    say = lambda a, b: " ".join(words[a:b]).encode()
    assert block.factors(1, 100, say(0, 30)) == []
    assert block.factors(2, 0, say(10, 50)) == [(0, 20, 1, 110)]
    assert block.factors(2, 70, say(10, 50)) == [(70, 20, 1, 110)]  # its own passage is no source
    # words 0-29 stand in 1, 10-49 in 2: the next factor starts at the first window that the first does not hold
    assert block.factors(3, 0, say(0, 60)) == [(0, 30, 1, 100), (18, 32, 2, 8)]
    assert substrings.spans([{"at": a, "n": n, "source": s, "source_at": t} for a, n, s, t in ((20, 15, 1, 30), (0, 14, 1, 10), (12, 13, 1, 22), (30, 13, 2, 0))]) == [(0, 35, 1, 10), (30, 13, 2, 0)]


def test_passages_of_a_long_run_are_cut(monkeypatch):
    found = np.array([5] * 150 + [7] * 3 + [5] * 64, np.int64)
    start, n = substrings.passages(found)
    assert start.tolist() == [0, 64, 128, 150, 153] and n.tolist() == [64, 64, 22, 3, 64]


def test_very_long_texts(spark):
    """A text of 150 thousand words, its copy with a new middle, one word of half a million letters, and one line a hundred thousand times."""
    rng = random.Random(17)
    words = [f"w{rng.randrange(10**5)}" for _ in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:70_000], "new", *words[70_000:]])), (3, "x" * 500_000), (4, "all work and no play " * 100_000), (5, "all work and no play " * 50 + "x" * 500_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in substrings.dedup(df).collect()}
    assert [out[i]["__removed"] for i in range(1, 6)] == [0, 150_000, 0, 0, 250]
    assert [tuple(s) for s in out[2]["__spans"]] == [(0, 70_000, 1, 0), (70_001, 80_000, 1, 70_000)] and out[2]["__kept"] == "new"
    fps = {r.doc_id: r.fp for r in simhash.near_classes(df, "doc_id", "text").collect()}
    assert len({fps[1], fps[2]}) <= 2 and (fps[1] ^ fps[2]).bit_count() <= 3 and fps[3] & (2**64 - 1) == brute_fingerprint(rows[2][1])
    scores = toxicity.Scorer(np.ones(toxicity.BUCKETS, np.float32), -1.0).scores([t for _, t in rows])
    assert scores == pytest.approx([0.5] * 5)


def test_substring_spans_name_their_source(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(7, " ".join(words[:200])), (9, " ".join(["x"] * 5 + words[20:120] + ["y"] * 3 + words[150:190])), (3, "one"), (9, "two")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, `__words` int, `__factors` int").repartition(4)
    out = substrings.dedup(df)
    assert out.columns == ["doc_id", "text", "__words", "__factors", "__words_", "__removed", "__spans", "__kept"]
    got = {(r.doc_id, r.text): [tuple(s) for s in r["__spans"]] for r in out.collect()}
    assert got[rows[1]] == [(5, 100, 7, 20), (108, 40, 7, 150)] and got[rows[0]] == got[rows[2]] == got[rows[3]] == []
    with pytest.raises(ValueError, match="integer"):
        substrings.dedup(df.withColumn("doc_id", F.col("doc_id").cast("string")))


@pytest.mark.parametrize("level,few", [(10_000, 1_000_000), (2, 0)])
def test_packing_is_gapless_and_whole(docs, none, monkeypatch, level, few):
    """Against the tokenizers library as the file sets it up."""
    monkeypatch.setattr(packing, "LEVEL", level)
    monkeypatch.setattr(packing, "FEW_PARTS", few)
    path, special = public_tokenizers.path("byte_bpe_50k.tiktoken"), packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    made = lambda df: packing.tokenized(df, "doc_id", "text", path, public_tokenizers.PATTERN, special=special)
    rows = packing.pack(made(docs), "doc_id", 256).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in corpus())
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    at, stream = 0, []
    for r in rows:
        assert r.sequence_id * 256 + r.offset == at and r.offset + r.length <= 256 and len(r.ids) == 4 * r.length
        at += r.length
        stream += array.array("I", r.ids).tolist()
    whole, i = [], 0
    for r in rows:
        if r.start == 0:
            whole.append(stream[i : i + r.doc_tokens])
        i += r.length
    assert sorted(whole) == want
    assert packing.pack(made(none), "doc_id").count() == 0


def test_packing_reads_added_tokens_as_the_tokenizer_does(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>  it's\n\n", "<|endoftext|", "<|pad|> <|ENDOFTEXT|>", "é<|endoftext|>日本 😀", "plain", None]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    streams = {i: array.array("I", [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in enumerate(texts)}
    assert 50256 in streams[0] and len(rows) == len(texts)  # no document here reaches the window's end
    assert {(r.doc_id, r.doc_tokens, r.ids_crc32) for r in rows} == {(i, len(x), zlib.crc32(x.tobytes())) for i, x in streams.items()}


def test_toxicity_learns_subwords(spark, none):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(80)]
    rows, marks = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(30)] = "vilewort" + rng.choice(["", "s", "y", "en"])
            text[rng.randrange(30)] = "Vilewort!"
        rows.append((i, " ".join(text)))
        marks.append((i, 0, int(toxic)))
    rows += [(900, None), (901, ""), (902, "vilewortish " * 2 + " ".join(words[:20])), (902, "x"), (903, " ".join(words[:20]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("y", F.lit(7))
    labels = spark.createDataFrame([*marks, (5, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    out = {(r.doc_id, r.text): r.score for r in toxicity.scored(docs, model, ["doc_id", "text"]).collect()}
    assert {(r.doc_id, r.text): r.score_ for r in toxicity.scored(docs, model, docs.columns).collect()} == out
    held = [(i, t) for i, t in rows[:400] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((out[i, t] >= 0.3) == (i % 4 == 0) for i, t in held) / len(held) > 0.95
    assert out[902, rows[402][1]] > 5 * out[903, rows[404][1]]  # an unseen form of the word
    assert out[900, None] == out[901, ""] and 0 <= out[900, None] <= 1
    only = toxicity.train(docs, labels.where("toxic = 0"))
    assert all(r.score < 0.01 for r in toxicity.scored(docs, only, ["doc_id"]).collect())
    assert toxicity.scored(none, only, ["doc_id"]).count() == 0
    assert toxicity.train(none, labels)[0].any() == toxicity.train(docs, labels.where("false"))[0].any() == False  # noqa: E712


M64 = (1 << 64) - 1
P64, Q64 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def brute_buckets(word):
    """Buckets of the n-grams of a word and of itself, by whole numbers."""
    marked = [ord(c) for c in f"<{word}>"]
    hashes = [sum(c * pow(P64, i, 1 << 64) for i, c in enumerate(marked)) * Q64 & M64]
    for n in (3, 4, 5):
        for i in range(len(marked) - n + 1):
            h = 0
            for c in marked[i : i + n]:
                h = (h * P64 + c) & M64
            hashes.append((h + n) * Q64 & M64)
    return [((h ^ h >> 29) * P64 & M64) >> (64 - toxicity.BUCKET_BITS) for h in hashes]


def brute_words(text):
    """(word, weight) of each token of a text; tokens that are alike but for case or marks stay apart."""
    counts = {}
    for t in text.split():
        counts[t] = counts.get(t, 0) + 1
    out = []
    for t, n in counts.items():
        w = t.lower()
        while w and not w[0].isalnum():
            w = w[1:]
        while w and not w[-1].isalnum():
            w = w[:-1]
        if w:
            out.append((w, 1 + math.log(n)))
    return out


def brute_logit(text, pull_of, bias):
    words = brute_words(text)
    total = sum(part for _, part in words)
    return bias + (sum(part * pull_of(w) for w, part in words) / total if words else 0.0)


def test_toxicity_scores_equal_brute_force():
    rng = np.random.default_rng(3)
    pulls, bias = rng.normal(0, 3, toxicity.BUCKETS).astype(np.float32), -0.7
    texts = ["one Two two TWO, two", "", "  ", "...", "é日本 ünï 'x' a", "word " * 500 + "Word! word?", "x" * 3000, *(t for _, t, *_ in corpus() if t)]
    of = lambda w: sum(float(pulls[b]) for b in brute_buckets(w)) / len(brute_buckets(w))
    want = [1 / (1 + math.exp(-min(50, max(-50, brute_logit(t, of, bias))))) for t in texts]
    with mock.patch.object(toxicity, "WORDS_AT_ONCE", 3), mock.patch.object(toxicity, "CACHE_WORDS", 5):
        scorer = toxicity.Scorer(pulls, bias)
        got = [x for k in range(0, len(texts), 4) for x in scorer.scores(texts[k : k + 4])]
    assert got == pytest.approx(want, abs=1e-9)
    assert toxicity.Scorer(pulls, bias).scores(["", None]) == [1 / (1 + math.exp(0.7))] * 2


def test_toxicity_fit_equals_brute_force(monkeypatch):
    """Embeddings and softmax by plain gradients of the weighted log loss, word by word."""
    monkeypatch.setattr(toxicity, "STEPS", 4)
    rng = random.Random(9)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(9)] + [""]
    y, weight = [k % 3 == 0 for k in range(10)], np.array([1.0 + k % 2 for k in range(10)])
    pulls, bias = toxicity.fit(texts, [int(v) for v in y], weight)

    used = sorted({b for t in texts for w, _ in brute_words(t) for b in brute_buckets(w)})
    gen = np.random.default_rng(toxicity.SEED)
    model = {"E": gen.normal(0, 0.05, (len(used), toxicity.DIM)), "U": gen.normal(0, 0.5, (toxicity.DIM, 2)), "b": np.zeros(2)}
    model["b"][1] = math.log(sum(w for w, v in zip(weight, y, strict=True) if v) / sum(w for w, v in zip(weight, y, strict=True) if not v))
    row = {b: k for k, b in enumerate(used)}
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    for step in range(1, 5):
        grad = {k: np.zeros_like(v) for k, v in model.items()}
        for text, label, w in zip(texts, y, weight / weight.sum(), strict=True):
            x = np.zeros(toxicity.DIM)  # the text's vector, and its share of every bucket
            share = {}
            parts = brute_words(text)
            for word, part in parts:
                buckets = brute_buckets(word)
                for b in buckets:
                    share[row[b]] = share.get(row[b], 0) + toxicity.SCALE * part / sum(p for _, p in parts) / len(buckets)
            for k, v in share.items():
                x += v * model["E"][k]
            z = x @ model["U"] + model["b"]
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            dz = w * (p - np.array([not label, label], float))
            grad["U"] += np.outer(x, dz)
            grad["b"] += dz
            for k, v in share.items():
                grad["E"][k] += v * (model["U"] @ dz)
        grad["E"] += toxicity.DECAY * model["E"]
        for k in model:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            model[k] -= toxicity.RATE * (1 - (step - 1) / 4) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    want = np.zeros(toxicity.BUCKETS)
    want[used] = toxicity.SCALE * (model["E"] @ (model["U"][:, 1] - model["U"][:, 0]))
    assert pulls == pytest.approx(want, rel=1e-2, abs=1e-2) and bias == pytest.approx(model["b"][1] - model["b"][0], rel=1e-3, abs=1e-3)


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, n, 1) if i % 100 != 99] + [(5, 5), (None, 3)], "u long, v long").repartition(5)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: i // 100 * 100 for i in range(n)}  # an edge of a node with itself is none
