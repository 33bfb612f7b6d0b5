"""Byte-level BPE encoding and decoding (operator 1).

``encode`` cuts a text into pre-tokens by a pattern and merges the bytes of each with a rank queue:
one bucket per merge rank holds the positions (of a doubly linked list of symbols) where a pair of
that rank starts; a three-level bitmap over the ranks answers "which is the lowest rank that has
work" by find-first-set; entries whose pair has changed since they were queued are stale and are
skipped.  A pre-token of n bytes costs O(n log n) whatever its length, so a text that is one long run of
letters is no special case.

Exactness: for every rank in turn the leftmost pair goes first, as the greedy rule of the public
tiktoken library demands; a pre-token that is itself in the vocabulary becomes its rank at once, as there.

Memory: a worker holds the ranks, a bounded cache of encoded words, one batch of ``BATCH_BYTES`` of text (a longer text is
a batch of its own) and the rank queue of ``MERGED_BYTES``.  Work is a narrow map: no shuffle, no state, so a lost executor repeats its own tasks only.

Defined results: a null text counts as empty; an empty text has no ids; ids that the vocabulary lacks are an error; other columns pass through
unread (name the key columns to keep); repeated rows are encoded alike; an empty table gives no row.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import tidied

#: Bytes of ids or text in one output batch, words a worker remembers, longest word it remembers.
BATCH_BYTES, CACHE_WORDS, CACHE_CHARS = 3 << 20, 80_000, 64
#: Bytes of pre-tokens that one rank queue merges; the hash table of pairs.
MERGED_BYTES, _SLOT_BITS, _SPREAD = 600_000, 20, np.uint64(0x9E3779B97F4A7C15)
#: Fixed value: the pattern whose pre-tokens never span the place before a space that stands between two characters that are no
#: white space.  Texts are cut there first if they are to be cut by this pattern; any other pattern reads whole texts.
CUT_AT_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space at an end of the text or beside other white space (a few control characters more than that do no harm).
_ODD_SPACE = r"^ |[\x09-\x0D\x1C-\x20\x{85}\pZ] | [\x09-\x0D\x1C-\x20\x{85}\pZ]| $"


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a line holds a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted without copies; for the short arrays of a bucket much faster than np.unique."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


class Encoder:
    """Ranks, a pre-token pattern, the rank queue's bitmap and a bounded cache of words already encoded.

    Bitmap: level 0 has a bit for each rank, in words of 64 bits; level 1 a bit for each word of level 0 that is not
    empty, in words too; level 2, one int, a bit for each word of level 1.  A queue that has run empty leaves all
    levels empty, so one bitmap serves every pre-token.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        n0 = (max(ranks.values(), default=0) >> 6) + 1
        self.l0, self.l1 = [0] * n0, [0] * ((n0 >> 6) + 1)
        self.find = regex.compile(pattern).findall
        self.spaces = pattern == CUT_AT_SPACES
        #: Rank of each pair of bytes, by the first and the second; -1 if they don't merge.
        self.first = [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        #: Ids by word (the space before it left out): what is young, and what was until it was full.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pair_keys = None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get, l0, l1, l2 = len(piece), ranks.get, self.l0, self.l1, 0
        first = self.first
        end = list(range(1, n + 1))  # of the symbol that starts here
        prev = list(range(-1, n - 1))
        pair = [first[a][b] for a, b in zip(piece, piece[1:])]  # rank of the pair that starts here, or -1
        pair.append(-1)
        buckets: dict[int, list[int]] = {}
        for i, r in enumerate(pair):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> 6
                    l0[w] |= 1 << (r & 63)
                    l1[w >> 6] |= 1 << (w & 63)
                    l2 |= 1 << (w >> 6)
        while l2:
            v = (l2 & -l2).bit_length() - 1  # find first set, level by level
            x = l1[v]
            w = (v << 6) | ((x & -x).bit_length() - 1)
            y = l0[w]
            r = (w << 6) | ((y & -y).bit_length() - 1)
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                l0[w] = y = y & (y - 1)
                if not y:
                    l1[v] = x = x & (x - 1)
                    if not x:
                        l2 &= l2 - 1
            if pair[i] != r:
                continue  # stale
            j = end[i]
            k = end[i] = end[j]
            pair[i] = pair[j] = -1
            if k < n:
                prev[k] = i
                new = get(piece[i : end[k]], -1)
            else:
                new = -1
            h = prev[i]
            for at, r in ((i, new), (h, get(piece[h:k], -1))) if h >= 0 else ((i, new),):
                if r != pair[at]:
                    pair[at] = r
                    if r >= 0:
                        if r in buckets:
                            heappush(buckets[r], at)
                        else:
                            buckets[r] = [at]
                            w = r >> 6
                            l0[w] |= 1 << (r & 63)
                            l1[w >> 6] |= 1 << (w & 63)
                            l2 |= 1 << (w >> 6)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _pairs(self):
        """The vocabulary's pairs as arrays: sorted (left id, right id) keys and the rank of what they make."""
        if self.pair_keys is None:
            ranks, found = self.ranks, {}
            for token, rank in ranks.items():
                for i in range(1, len(token)):
                    a, b = ranks.get(token[:i]), ranks.get(token[i:])
                    if a is not None and b is not None:
                        found[a << 32 | b] = rank
            keys = np.fromiter(found.keys(), np.int64, len(found))
            values = np.fromiter(found.values(), np.int64, len(found))
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            # a hash table in front: most lookups end at one probe
            slots = (keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - _SLOT_BITS)
            self.slot_key = np.full(1 << _SLOT_BITS, -1, np.int64)
            self.slot_rank = np.full(1 << _SLOT_BITS, -1, np.int64)
            self.slot_key[slots], self.slot_rank[slots] = keys, values
            self.slot_many = np.bincount(slots.astype(np.int64), minlength=1 << _SLOT_BITS) > 1
            self.pair_keys, self.pair_ranks = keys, values
            self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 if they don't merge."""
        key = left << 32 | right
        slot = ((key.view(np.uint64) * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)
        out = np.where(self.slot_key[slot] == key, self.slot_rank[slot], -1)
        unsure = np.flatnonzero((out < 0) & self.slot_many[slot])
        if len(unsure):
            at = np.minimum(np.searchsorted(self.pair_keys, key[unsure]), len(self.pair_keys) - 1)
            out[unsure] = np.where(self.pair_keys[at] == key[unsure], self.pair_ranks[at], -1)
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens at once, by one rank queue over all of them.

        Pre-tokens lie side by side in one linked list that never links across their ends.  A bucket then holds the
        positions of a rank in all pre-tokens, and its merges, which don't touch each other, are made together.  One by one
        they would be made in the same order unless a merge opens a pair of no higher rank; a pre-token where that happens
        is done again by ``merge``.
        """
        if not pieces:
            return []
        self._pairs()
        rank_of = self._rank
        size = np.array([len(p) for p in pieces], np.int64)
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        n = int(size.sum())
        tok = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[start + size - 1] = -1
        prv[start] = -1
        pair = np.full(n, -1, np.int32)
        inner = np.flatnonzero(nxt >= 0)
        pair[inner] = rank_of(tok[inner], tok[inner + 1])
        alive = np.ones(n, bool)
        again: list[int] = []
        l0, l1, l2 = self.l0, self.l1, 0
        buckets: dict[int, list[int]] = {}
        some = np.flatnonzero(pair >= 0).astype(np.int32)
        some = some[np.argsort(pair[some], kind="stable")]
        bounds = [0, *(np.flatnonzero(np.diff(pair[some])) + 1).tolist(), len(some)] if len(some) else []
        for x, y in zip(bounds, bounds[1:]):  # noqa: B905
            r = int(pair[some[x]])
            buckets[r] = some[x:y].tolist()
            w = r >> 6
            l0[w] |= 1 << (r & 63)
            l1[w >> 6] |= 1 << (w & 63)
            l2 |= 1 << (w >> 6)
        while l2:
            v = (l2 & -l2).bit_length() - 1  # find first set, level by level
            x = l1[v]
            w = (v << 6) | ((x & -x).bit_length() - 1)
            y = l0[w]
            r = (w << 6) | ((y & -y).bit_length() - 1)
            l0[w] = y = y & (y - 1)
            if not y:
                l1[v] = x = x & (x - 1)
                if not x:
                    l2 &= l2 - 1
            i = np.array(buckets.pop(r), np.int64)
            i = i[pair[i] == r]  # the others are stale
            if not len(i):
                continue
            i = _distinct(i)
            j = nxt[i]
            if len(i) > 1 and (i[1:] == j[:-1]).any():  # overlaps: leftmost first
                taken, barred = [], -1
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if a != barred:
                        taken.append(a)
                        barred = b
                i = np.array(taken, np.int64)
                j = nxt[i]
            k = nxt[j]
            open_ = k >= 0
            more = k[open_]
            was = rank_of(np.full(len(more), r, np.int64), tok[more])  # as it stands when only this merge is made
            early = i[open_][(was >= 0) & (was <= r)]
            tok[i], nxt[i], alive[j] = r, k, False
            pair[i] = pair[j] = -1
            prv[more] = i[open_]
            h = prv[i]
            p = _distinct(np.concatenate((i[open_], h[h >= 0])))
            new = rank_of(tok[p], tok[nxt[p]])
            pair[p] = new
            works = new >= 0
            p, new = p[works], new[works]
            early = np.concatenate((early, p[new <= r]))
            if len(early):
                again += (np.searchsorted(start, early, "right") - 1).tolist()
            for at, r in zip(p.tolist(), new.tolist(), strict=True):
                bucket = buckets.get(r)
                if bucket is not None:
                    bucket.append(at)
                else:
                    buckets[r] = [at]
                    w = r >> 6
                    l0[w] |= 1 << (r & 63)
                    l1[w >> 6] |= 1 << (w & 63)
                    l2 |= 1 << (w >> 6)
        ids = tok[alive].astype("<u4").tobytes()
        ends = (np.cumsum(np.add.reduceat(alive, start, dtype=np.int64)) * 4).tolist()
        out = [ids[x:y] for x, y in zip([0, *ends], ends, strict=False)]
        for k in set(again):
            out[k] = array("I", self.merge(pieces[k])).tobytes()
        return out

    def _learn(self, wanted) -> dict[str, bytes]:
        """Ids of each piece of ``wanted``; whole vocabulary entries are their rank."""
        ranks, out, names, codes, size = self.ranks, {}, [], [], 0

        def merged():
            out.update(zip(names, self.merge_many(codes), strict=True))
            names.clear()
            codes.clear()

        for piece in wanted:
            code = piece.encode()
            whole = ranks.get(code)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
                continue
            if size + len(code) > MERGED_BYTES and codes:
                merged()
                size = 0
            names.append(piece)
            codes.append(code)
            size += len(code)
        if codes:
            merged()
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each with the space before it."""
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = [young.get(w) or old.get(w) for w in words]
        lacking = [i for i, ids in enumerate(out) if ids is None]
        flat = self.find("".join([" " + words[i] for i in lacking]))
        known = self._learn(set(flat))
        bounds = [i for i, p in enumerate(flat) if p[0] == " "]  # a space is before every word and nowhere else
        bounds.append(len(flat))
        ids = [known[p] for p in flat]
        for i, a, b in zip(lacking, bounds[:-1], bounds[1:], strict=True):
            out[i] = ids[a] if b == a + 1 else b"".join(ids[a:b])
        young.update((w, ids) for w, ids in zip(words, out, strict=True) if len(w) <= CACHE_CHARS and w not in young)
        return out

    def _texts(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are cut by the pattern as a whole."""
        cut = [self.find(t) for t in texts]
        known = self._learn({p for pieces in cut for p in pieces})
        return [b"".join([known[p] for p in pieces]) for pieces in cut]

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """A string array -> the ids of each text as little-endian unsigned 32-bit integers (binary array; null counts as empty).

        Words are numbered by Arrow, so Python sees the distinct ones of the batch only, and their ids are put together by
        a gather over the words' numbers.
        """
        texts = pc.fill_null(texts, "")
        if not self.spaces:
            return pa.array(self._texts(texts.to_pylist()), pa.binary())
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        ends = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        number, names = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        head = ends[:-1]  # the first word of a text has no space before it
        first, place = np.unique(number[head], return_inverse=True)
        others = np.ones(len(number), bool)
        others[head] = False
        inner = np.flatnonzero(np.bincount(number[others], minlength=len(names)))  # words that have a space before them
        place_of = np.zeros(len(names), np.int64)
        place_of[inner] = np.arange(len(inner))
        number = place_of[number]
        number[head] = len(inner) + place.ravel()
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        number[head[whole]] = len(inner) + len(first) + np.arange(len(whole))
        ids = self._words([names[i] for i in inner.tolist()])
        ids += self._texts([names[i] for i in first.tolist()])
        ids += self._texts(texts.take(pa.array(whole)).to_pylist())
        return _joined(pa.array(ids, pa.large_binary()).take(pa.array(number)), ends)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


def _joined(parts: pa.Array, ends: np.ndarray) -> pa.Array:
    """Of a large binary array without nulls, the parts from ends[i] to ends[i + 1] joined, as a binary array."""
    _, offsets, data = parts.buffers()
    at = np.frombuffer(offsets, np.int64, len(parts) + 1, parts.offset * 8)[ends]
    if at[-1] - at[0] >= 1 << 31:
        raise ValueError("a row's ids or bytes are beyond the 2 GB that a value can hold")
    shifted = pa.py_buffer((at - at[0]).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, shifted, data.slice(int(at[0])) if data else pa.py_buffer(b"")])


def _mapped(df: DataFrame, keys: list[str], column: str, out: str, make) -> DataFrame:
    """``keys`` and the binary column ``out`` = make()(values of ``column``, an Arrow array), made once a task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    want = StructType([*[StructField(k, df.schema[k].dataType) for k in keys], StructField(out, BinaryType())])
    n = len(keys)

    @tidied
    def run(batches):
        f = make()
        schema = to_arrow_schema(want)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(n)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                before = size[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(size, before + BATCH_BYTES, "right")))
                part = batch.slice(start, end - start)
                columns = [part.column(k).cast(schema.field(k).type) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*columns, f(part.column(n))], names=schema.names)
                start = end

    return df.select(*keys, F.col(column).alias("__value")).mapInArrow(run, want)


_ENCODERS: dict[tuple, Encoder] = {}


def encode(df: DataFrame, keys: list[str], text: str, ranks_path: str, pattern: str) -> DataFrame:
    """``keys`` and ``ids`` (binary, little-endian unsigned 32-bit) of the text column.

    The driver reads ``ranks_path``; executors get the file's bytes by broadcast (a vocabulary, about 1 MB
    whatever the size of the data).
    """
    with open(ranks_path, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        key = (len(raw.value), hash(raw.value), pattern)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.value.splitlines() if x.strip())}
            _ENCODERS[key] = Encoder(ranks, pattern)
        return _ENCODERS[key].encode_array

    return _mapped(df, keys, text, "ids", make)


def decode(df: DataFrame, keys: list[str], ids: str, ranks_path: str) -> DataFrame:
    """``keys`` and ``decoded`` (binary): the bytes of the tokens in the binary column ``ids``.

    The result is bytes, since a token may end inside a character.
    """
    with open(ranks_path, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        found = {int(b): base64.b64decode(a) for a, b in (x.split() for x in raw.value.splitlines() if x.strip())}
        tokens = pa.array([found.get(i) for i in range(max(found, default=-1) + 1)], pa.large_binary())

        def back(blobs: pa.Array) -> pa.Array:
            blobs = pc.fill_null(blobs, b"")
            ends = np.concatenate(([0], np.cumsum(pc.binary_length(blobs).to_numpy(zero_copy_only=False), dtype=np.int64)))
            _, offsets, data = blobs.buffers()
            start = int(np.frombuffer(offsets, np.int32, 1, blobs.offset * 4)[0])
            if (ends % 4).any():
                raise ValueError("ids are 4 bytes each")
            codes = np.frombuffer(data, "<u4", int(ends[-1]) // 4, start) if ends[-1] else np.zeros(0, "<u4")
            if len(codes) and codes.max() >= len(tokens):
                raise ValueError("ids that the vocabulary does not have")
            parts = tokens.take(pa.array(codes.astype(np.int64)))
            if parts.null_count:
                raise ValueError("ids that the vocabulary does not have")
            return _joined(parts, ends // 4)

        return back

    return _mapped(df, keys, ids, "decoded", make)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of both."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = encode(docs, ["doc_id"], "text", path, public_tokenizers.PATTERN)
    ids = ids.select(
        F.struct("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")).alias("k"), "ids"
    )
    return decode(ids, ["k"], "ids", path).select("k.*", F.sha2("decoded", 256).alias("decoded_sha256"))
