"""Main text of web pages, with host suffix arrays (operator 9).

A scanner cuts a page into blocks and tells, from the elements around each, whether HTML itself calls it article
(article, main) or boilerplate (nav, header, footer, aside, form, script, ... or an element whose class, id or role says so).
The token streams of all blocks outside articles, of all pages of a host, are then searched for long substrings that
distinct pages share: ``LONG`` words, or a whole shorter block.  What they cover is boilerplate and goes, unique runs stay.

Who decides: text inside a marked article is protected, as articles of one host share passages and copies, which are main
text by contract, so its suffixes are not in the array.  Every other word goes if the array covers it, wherever the other page
has it: an open block that repeats a menu which another page marks as one is found, too.  What the array leaves of a marked
boilerplate block goes by its mark, as a host of one page repeats nothing.

The suffix array of a host is partitioned.  Each task sorts the suffixes of the pages it happens to have by prefix doubling, which
stops at ``LONG`` words, and sends each distinct one (128 bits of it and of its host) with the smallest and the largest page it
starts in; equal suffixes meet by one shuffle, and those of more than one page are the repeated ones.  Repeats thus do
not depend on how pages are dealt out, and a host or a passage with a third of all rows is a row a chunk.

Scale: pages are parsed once into a table in the shared folder.  Pages are never shuffled; the only ones that wait for the array's
answer are those with an open block, and of them the suffixes' numbers and the text of the open pages are shuffled.

Defined results: null html counts as empty, its text is empty; a url without host is a host of its own; pages count by id, so
repeated rows, and rows without an id, are copies of one page and not distinct pages; a "<" that no ">" follows is text, as are all
after it; an unclosed comment or script reaches to the end of the page; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import tidied
from quern.llm.urls import host_of
from quern.shared import shared_table

#: Words of a long substring (a power of two); words of a local suffix array; bytes of an output batch.
LONG, CHUNK_WORDS, BATCH_BYTES = 8, 400_000, 4 << 20

# HTML element names by their role, and words in class, id and role that mark boilerplate.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
SKIPPED = frozenset("noscript template svg math object canvas select audio video".split())
DROP = frozenset("nav header footer aside form menu dialog head button fieldset search".split())
KEEP = frozenset("article main".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored banner promo promotion sidebar aside menu nav navbar navigation topnav breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay comment comments respond reply replies disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget toolbar pagination pager alert paywall contentinfo complementary dialog form".split())
MARKS_OUTSIDE = frozenset({"header"})

_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?")
_WORDS = re.compile(r"[a-z]+")
_LONG_NUMBER = re.compile(r"&#(?:[xX]0*+[0-9a-fA-F]{7,}+|0*+[0-9]{8,}+);?")
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW | SKIPPED}


def _kind(name: str, attributes: str, inside: bool) -> int:
    """-1: boilerplate, 1: article, 0: neither. ``inside`` an article?"""
    kind = -1 if name in DROP and not (inside and name == "header") else 1 if name in KEEP else 0
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key not in ("class", "id", "role", "itemprop", "hidden", "aria-hidden"):
            continue
        value = (m[2] or "").strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return -1
        words = set(_WORDS.findall(value))
        if key in ("class", "id", "role") and (words & MARKS or (words & MARKS_OUTSIDE and not inside)):
            return -1
        if (key, value) in (("role", "main"), ("role", "article"), ("itemprop", "articlebody")):
            kind = kind or 1
    return kind


def _decoded(text: str) -> str:
    try:
        return html.unescape(text)
    except ValueError:  # a number of thousands of digits
        return html.unescape(_LONG_NUMBER.sub("�", text))


class _Ends:
    """Where tags of one page end: at the first ">" outside quotes, or if quotes never close so, at the first ">" of all.

    A quote from which no end is reached is remembered, so each is walked over once and a page costs linear time.
    """

    def __init__(self, page: str):
        self.page, self.open = page, set()

    def of(self, at: int) -> int:
        """The place of the ">", or -1."""
        page, walked, here = self.page, [], at
        while True:
            m = _QUOTE_OR_END.search(page, here)
            if m is None or m.start() in self.open:
                break
            if m[0] == ">":
                return m.start()
            walked.append(m.start())
            here = page.find(m[0], m.end()) + 1
            if not here:
                break
        self.open.update(walked)
        return page.find(">", at)


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The page's blocks in order: text with white space made one space, and 1 article, 0 open, -1 boilerplate."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    depth: Counter = Counter()  # open elements by name
    unclosed: set[str] = set()  # elements that no closing tag follows any more
    ends = _Ends(page)
    drop = keep = at = 0

    def flush():
        words = " ".join("".join(text).split())
        if words:
            out.append((words, -1 if drop else 1 if keep else 0))
        text.clear()

    def pop():
        nonlocal drop, keep
        name, kind = stack.pop()
        depth[name] -= 1
        drop -= kind < 0
        keep -= kind > 0

    size = len(page)
    while at < size:
        start = page.find("<", at)
        piece = page[at : start if start >= 0 else size]
        if piece:
            text.append(_decoded(piece) if "&" in piece else piece)
        if start < 0:
            break
        mark = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = end + 3 if end >= 0 else size
            continue
        closing = mark == "/"
        m = _NAME.match(page, start + 1 + closing)
        if not m and not (mark and mark in "!?/"):
            text.append("<")
            at = start + 1
            continue
        end = ends.of(m.end()) if m else page.find(">", start)
        if end < 0:  # no tag ends any more
            rest = page[start:]
            text.append(_decoded(rest) if "&" in rest else rest)
            break
        at = end + 1
        if not m:
            continue
        name = m[0].lower()
        if name == "br":
            text.append(" ")
            continue
        block = name in BLOCKS
        if block:
            flush()
        if closing:
            if depth[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _CLOSERS:
            single = name in ("svg", "math") and page[end - 1] == "/"
            close = None if single or name in unclosed else _CLOSERS[name].search(page, at)
            end = page.find(">", close.end()) if close else -1
            if end >= 0:
                at = end + 1
            elif name in RAW:
                at = size
            elif not single:
                unclosed.add(name)
            continue
        if name in VOID:
            continue
        if block and stack and stack[-1][0] == "p":
            pop()
        kind = _kind(name, page[m.end() : end], keep > 0)
        if block or kind:
            stack.append((name, kind))
            depth[name] += 1
            drop += kind < 0
            keep += kind > 0
    flush()
    return out


def suffix_ranks(codes: np.ndarray, long: int) -> np.ndarray:
    """Rank of each suffix by its first ``long`` (a power of two) symbols: prefix doubling, so equal ranks are equal substrings."""
    rank, width = np.unique(codes, return_inverse=True)[1].ravel(), 1
    n = len(codes)
    while width < long:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - width)] = rank[width:]
        rank = np.unique(rank * np.int64(n + 2) + after + 1, return_inverse=True)[1].ravel()
        width *= 2
    return rank


def starts(n: int, long: int = LONG) -> range:
    """Where the substrings of a block of ``n`` words start: those of ``long`` words, or the whole of a shorter block."""
    return range(max(1, n - long + 1))


def digest(host: str, words: list[str]) -> bytes:
    """128 bits of a substring and its host, taken as unique."""
    return hashlib.blake2b((host + "\n" + " ".join(words)).encode(), digest_size=16).digest()


def local_array(streams: list[list[str]], hosts: list[int], pages: list[int], long: int = LONG) -> Iterator[tuple[int, int, int, int]]:
    """The suffix array of some blocks, each of a host and a page: of every distinct substring of a host its block, its place
    there, and the smallest and largest page it starts in."""
    known: dict[str, int] = {}
    codes: list[int] = []
    block, place, at = [], [], []
    for k, words in enumerate(streams):
        here = starts(len(words), long)
        at.append(np.arange(len(codes), len(codes) + len(here)))
        place.append(np.arange(len(here)))
        block.append(np.full(len(here), k))
        codes += [known.setdefault(w, len(known) + 1) for w in words]
        codes += [0] * (long - 1)  # so that a short block is a substring of its own, and none reaches the next block
    if not codes:
        return
    at, place, block = np.concatenate(at), np.concatenate(place), np.concatenate(block)
    rank = suffix_ranks(np.array(codes, np.int64), long)[at]
    host, page = np.array(hosts, np.int64)[block], np.array(pages, np.int64)[block]
    order = np.lexsort((page, host, rank))
    r, h = rank[order], host[order]
    first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1]))))
    last = np.concatenate((first[1:], [len(r)])) - 1
    one = order[first]
    yield from zip(block[one].tolist(), place[one].tolist(), page[one].tolist(), page[order[last]].tolist(), strict=True)


def _pieces(words: list[str], size: int) -> Iterator[list[str]]:
    """A block cut so that every substring lies whole in exactly one piece."""
    yield words[: size + LONG - 1]
    for i in range(size, len(words) - LONG + 1, size):
        yield words[i : i + size + LONG - 1]


def _suffixes(chunk: int):
    """(host, page, texts) -> (digest, low, high): the distinct substrings of each ``chunk`` words with their smallest and largest page."""

    @tidied
    def run(batches):
        for batch in batches:
            streams, hosts, pages, size = [], [], [], 0
            names: dict[str, int] = {}

            def made():
                rows = list(local_array(streams, hosts, pages))  # noqa: B023
                of = list(names)  # noqa: B023
                found = [digest(of[hosts[b]], streams[b][p : p + LONG]) for b, p, _, _ in rows]  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["digest", "low", "high"])

            for i in range(batch.num_rows):
                host, page = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for text in batch.column(2)[i].as_py():
                    for piece in _pieces(text.split(" "), chunk):
                        if size + len(piece) > chunk and streams:
                            yield made()
                            streams, hosts, pages, size = [], [], [], 0
                            names = {}
                        streams.append(piece)
                        hosts.append(names.setdefault(host, len(names)))
                        pages.append(page)
                        size += len(piece) + LONG
            if streams:
                yield made()

    return run


def _asked(batches):
    """(row, host, texts) -> (row, digest): each substring of the texts once."""
    for batch in batches:
        for i in range(batch.num_rows):
            row, host = batch.column(0)[i], batch.column(1)[i].as_py()
            found = list({digest(host, words[p : p + LONG]) for words in (t.split(" ") for t in batch.column(2)[i].as_py()) for p in starts(len(words))})
            for at in range(0, len(found), 50_000):
                some = found[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(some), pa.int64()), pa.array(some, pa.binary())], names=["row", "digest"])


def unique_runs(host: str, text: str, repeated: set[bytes]) -> str:
    """The words of an open block that no repeated substring covers."""
    words = text.split(" ")
    gone = np.zeros(len(words), bool)
    for p in starts(len(words)):
        if digest(host, words[p : p + LONG]) in repeated:
            gone[p : p + LONG] = True
    return " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def _parsed(key_type):
    """(page_id, url, page, host, html) -> the same with the blocks in place of html."""

    @tidied
    def run(batches):
        kind = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int8())]))
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                found, size = [], 0
                while start + len(found) < batch.num_rows and size < BATCH_BYTES:
                    page = batch.column(4)[start + len(found)].as_py()
                    found.append([{"text": t, "kind": k} for t, k in blocks(page)])
                    size += len(page or "")
                part = batch.slice(start, len(found))
                columns = [part.column(0).cast(key_type), *(part.column(i) for i in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=["page_id", "url", "page", "host", "blocks"])
                start += len(found)

    return run


def parse(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> a shared table: page_id, url, page, host, blocks array<struct<text, kind>>, row (its number) and open."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = pages.schema["page_id"].dataType
    rows = pages.select("page_id", "url", F.xxhash64("page_id").alias("page"), host_of(F.col("url")).alias("host"), "html")
    rows = rows.mapInArrow(_parsed(to_arrow_type(kind)), f"page_id {kind.simpleString()}, url string, page long, host string, blocks array<struct<text: string, kind: tinyint>>")
    return shared_table(rows.select("*", F.monotonically_increasing_id().alias("row"), F.exists("blocks", lambda b: b["kind"] == 0).alias("open")), "pages")


def _texts(condition):
    return F.transform(F.filter("blocks", lambda b: condition(b["kind"])), lambda b: b["text"])


def repeated(parsed: DataFrame, chunk: int = CHUNK_WORDS) -> DataFrame:
    """The digests of all substrings outside articles that distinct pages of a host share."""
    outside = parsed.select("host", "page", _texts(lambda k: k <= 0).alias("texts")).where(F.size("texts") > 0)
    arrays = outside.mapInArrow(_suffixes(chunk), "digest binary, low long, high long")
    return arrays.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("digest")


def answers(asking: DataFrame, parsed: DataFrame, condition, chunk: int = CHUNK_WORDS) -> DataFrame:
    """(row, digests): the repeated substrings in those blocks of the pages ``asking`` for whose kinds ``condition`` holds."""
    asked = asking.select("row", "host", _texts(condition).alias("texts")).mapInArrow(_asked, "row long, digest binary")
    return asked.join(repeated(parsed, chunk), "digest").groupBy("row").agg(F.collect_list("digest").alias("digests"))


def coverage(pages: DataFrame) -> DataFrame:
    """(kind, blocks, words, covered_words) outside articles: what the array alone finds of open and of marked blocks."""
    parsed = parse(pages)
    outside = lambda k: k <= 0

    def count(batches):
        for batch in batches:
            rows = {0: [0, 0, 0], -1: [0, 0, 0]}
            for host, found, digests in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for b in found:
                    if b["kind"] <= 0:
                        words = b["text"].count(" ") + 1
                        left = unique_runs(host, b["text"], set(digests or ()))
                        rows[b["kind"]] = [x + y for x, y in zip(rows[b["kind"]], (1, words, words - (left.count(" ") + 1 if left else 0)), strict=True)]
            yield pa.RecordBatch.from_pylist([{"kind": k, "blocks": x, "words": y, "covered_words": z} for k, (x, y, z) in rows.items()])

    told = parsed.join(answers(parsed, parsed, outside), "row", "left").select("host", "blocks", "digests").mapInArrow(count, "kind long, blocks long, words long, covered_words long")
    return told.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("blocks", "words", "covered_words")])


def extract(pages: DataFrame, chunk: int = CHUNK_WORDS) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text; ``chunk`` words are in a local suffix array, which bounds memory alone."""
    from pyspark.sql.pandas.types import to_arrow_type

    parsed = parse(pages)
    done = parsed.where(~F.col("open")).select("page_id", "url", F.array_join(_texts(lambda k: k == 1), "\n\n").alias("text"))
    waiting = parsed.where("open")
    kind = pages.schema["page_id"].dataType
    key_type = to_arrow_type(kind)

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                host, digests = batch.column(2)[i].as_py(), set(batch.column(4)[i].as_py() or ())
                parts = [b["text"] if b["kind"] > 0 else unique_runs(host, b["text"], digests) for b in batch.column(3)[i].as_py() if b["kind"] >= 0]
                part = batch.slice(i, 1)
                text = pa.array(["\n\n".join(p for p in parts if p)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(key_type), part.column(1), text], names=["page_id", "url", "text"])

    told = waiting.join(answers(waiting, parsed, lambda k: k == 0, chunk), "row", "left").select("page_id", "url", "host", "blocks", "digests")
    return done.unionByName(told.mapInArrow(cut, f"page_id {kind.simpleString()}, url string, text string"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
