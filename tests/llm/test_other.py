"""Chat, urls, top-k, html and embeddings against brute force; nulls, ties, copies, empty tables, clashing names."""

import math
import random
import re
import statistics
import time

import pytest
from pyspark.sql import functions as F

from quern.llm import chat, embeddings, html, topk, urls


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a\\b </s>[INST] \\- <|im_end|>\n"), (1, 1, "assistant", "x<|im_sep|>\\\\"), (1, 2, "user", None),
        (2, 0, "assistant", "no"), (2, 0, "assistant", "no"), (3, 0, None, "q"), (None, 1, "user", ""), (4, None, "system", "<<SYS>>"), (4, 3, "user", "é😀"),
    ]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, loss int, formatted string")
    out = chat.format_chat(df).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    got = {r.conv_id: r for r in out}
    assert len(out) == 5
    for conv in (1, 2, 3, 4, None):
        want = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in got[conv].back] == want
        assert got[conv].loss == "".join(t for role, t in want if role == "assistant")
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
        for inner in got[conv].segments[1::3]:
            assert not any(c in inner.text for c in chat.TEMPLATE["control"])
    assert [got[c].valid for c in (1, 2, 3, 4)] == [True, False, False, True]
    assert got[2].first_bad_turn == 0
    assert chat.format_chat(df.where("false")).count() == 0


def test_chat_of_very_long_and_many_turns(spark):
    rows = [(1, 0, "user", "a</s>\\ " * 100_000), (1, 1, "assistant", "[INST]" * 50_000)] + [(2, i, ["user", "assistant"][i % 2], f"t{i}</s>") for i in range(2000)]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in out.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].back] == [r[2:] for r in rows[:2]] and got[1].loss == rows[1][3]
    assert [t.text for t in got[2].back] == [r[3] for r in rows[2:]] and got[2].valid and got[2].loss == "".join(r[3] for r in rows[3::2])


def test_urls(spark):
    rows = [(1, "HTTP://A.ExAmple.ORG/es/x?y#z"), (2, None), (3, "nothing"), (4, "http://x.org"), (5, "http://example.org/en/1"), (6, "a://b://c/d"), (7, "http://com/fr/"), (8, "http://a.com/fr"), (9, "http://É.com/de/ü?q"), (9, "http://É.com/de/ü?q"), (10, "u://" + "h" * 3000)]
    df = spark.createDataFrame([(*r, 5.0, "mine") for r in rows], "page_id long, url string, score double, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect())
    assert [g[:4] for g in got[:9]] == [(1, "a.example.org", "/es/x", "example.org/es/"), (2, "", "", None), (3, "", "", None), (4, "x.org", "", None), (5, "example.org", "/en/1", "example.org/en/1"), (6, "b:", "//c/d", None), (7, "com", "/fr/", "com/fr/"), (8, "a.com", "/fr", None), (9, "É.com", "/de/ü", "com/de/")]
    assert {g[4] for g in got} <= {"allow", "block"} and got[0][4] == "block" and got[6][4] == "allow" and got[1][4] == "block"
    assert urls.judge(df.where("false")).count() == 0


def test_url_model_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{''.join(rng.choice('abc') for _ in range(4))}.{'org' if i % 2 else 'com'}/{'de' if i % 2 == 0 else 'aa'}/{i}") for i in range(60)]
    rows += [(100 + i, f"http://{''.join(rng.choice('abc') for _ in range(4))}.net/{i}") for i in range(20)]
    judged = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    got = {i: r.score for i, r in judged.items()}
    base, symbols = urls.BASE, urls.SYMBOLS
    code = lambda c: symbols.index(c) + 1 if c in symbols else base - 1

    def grams(url):
        c = [0, 0, *[code("0" if x.isdigit() else x) for x in url.split("://")[1]]]
        return [tuple(c[i : i + 3]) for i in range(len(c) - 2)]

    def model(texts):
        n3, n2, n1 = {}, {}, {}
        for a, b, c in (g for t in texts for g in grams(t)):
            n3.setdefault((a, b), {}).setdefault(c, 0)
            n3[a, b][c] += 1
            n2.setdefault(b, {}).setdefault(c, 0)
            n2[b][c] += 1
            n1[c] = n1.get(c, 0) + 1

        def mix(counts, c, low):
            total, kinds = sum(counts.values()), len(counts)
            return (counts.get(c, 0) + kinds * low) / (total + kinds) if total else low

        def p(a, b, c):
            low = (n1.get(c, 0) + 1) / (sum(n1.values()) + base)
            return mix(n3.get((a, b), {}), c, mix(n2.get(b, {}), c, low))

        return p

    yes, no = model([u for i, u in rows if i < 100 and i % 2]), model([u for i, u in rows if i < 100 and i % 2 == 0])
    for i, u in rows[60:]:
        g = grams(u)
        assert got[i] == pytest.approx(sum(math.log(yes(*x)) - math.log(no(*x)) for x in g) / len(g), abs=1e-4)
    # the threshold: as many standard deviations below the mean of the allowed as above that of the blocked
    score = {i: sum(math.log(yes(*x)) - math.log(no(*x)) for x in grams(u)) / len(grams(u)) for i, u in rows}
    (my, sy), (mn, sn) = ((statistics.fmean(v), statistics.pstdev(v) + 1e-6) for v in ([score[i] for i in range(60) if i % 2], [score[i] for i in range(60) if i % 2 == 0]))
    threshold = (my * sn + mn * sy) / (sy + sn)
    for i in range(100, 120):
        if abs(score[i] - threshold) > 1e-3:
            assert judged[i].verdict == ("allow" if score[i] >= threshold else "block")
    assert all(judged[i].verdict == ("allow" if i % 2 else "block") and judged[i].score is None for i in range(60))
    assert len({judged[i].verdict for i in range(100, 120)}) == 2


def test_url_model_reads_query_and_fragment(spark):
    rows = [(i, f"http://a.org/x?good=yes#{'top' * (i % 3)}") for i in range(30)] + [(30 + i, f"http://a.com/de/x?bad=zzz#{'qqq' * (i % 3)}") for i in range(30)]
    rows += [(100, "http://b.net/x?good=yes"), (101, "http://b.net/x?bad=zzz"), (102, "http://b.net/x#top"), (103, "http://b.net/x#qqq"), (104, "http://b.net/x#q\nqq")]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "score", "verdict"]
    got = {r.page_id: r for r in out.collect()}
    assert got[100].score > got[101].score and got[102].score > got[103].score and got[104].score not in (got[102].score, got[103].score)
    assert (got[100].verdict, got[101].verdict) == ("allow", "block")
    assert {got[i].path for i in range(100, 105)} == {"/x"}


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "STEP", 4)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(200)]
    rows += [(1000 + i, [0.5, -0.5, 0.25, 0.0, 1.0]) for i in range(40)] + [(0, rows[0][1]), (2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 5), (2003, [0.0] * 5), (2004, [1.0, float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 5), (2005, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, rank int").select("vec_id", topk.integers(F.col("embedding")).alias("v"), "rank")
    is_query = "vec_id in (3, 7, 1005, 1006, 2000, 2002, 2003, 2005, 11)"
    got = sorted(tuple(r) for r in topk.top_k(df.where(is_query), df, "vec_id", "v", 10).collect())
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q in (3, 7, 1005, 1006, 2003, 2005, 11):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert topk.top_k(df.where("false"), df, "vec_id", "v").count() == 0
    assert topk.top_k(df.where("false"), df.where("false"), "vec_id", "v").count() == 0


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        v = [rng.gauss(0, 1) for _ in range(6)]
        if i % 3 and rows:
            v = [x + rng.gauss(0, 0.25) for x in rows[rng.randrange(len(rows))][1]]
        rows.append((i, v, rng.choice([0, 1])))
    rows += [(500 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.5], 1) for i in range(30)] + [(600, [2.0, 4.0, 0.0, 0.0, 0.0, 1.0], 1), (601, None, 1), (602, [0.0] * 6, 1), (603, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 0), (604, rows[0][1], None), (605, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (606, [1.0, 2.0], 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, block string")
    good = [(i, v, y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: [j for j, w, z in good if j != i and z == y and len(w) == len(v) and sum(a * b for a, b in zip(v, w, strict=True)) / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(a * a for a in w)) >= 0.93] for i, v, y in good}
    want = {}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        want[i] = (len(links.get(i, [])), min(seen) if i is not None else None)
    for block in (2048, 20):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        assert {r.vec_id: (r.n_links, r.component) for r in embeddings.near_duplicates(df).collect()} == want
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_embeddings_judge_rows_of_one_id_each_and_of_any_size(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [1e200, 1e-200]), (5, [1e-200, 0.0]), (6, [5e-324, 0.0]), (7, [-1.7e308, 1.7e308]), (8, [-1.0, 1.0]), (9, [0.0, 1e300])]
    df = spark.createDataFrame([(*r, 1, 2.5) for r in rows], "vec_id long, embedding array<double>, label int, n_links double")
    got = sorted((r.vec_id, r.n_links, r.component) for r in embeddings.near_duplicates(df).collect())
    # both classes of id 1 have it as their least; 1 (first), 2, 4, 5, 6 are one class, 1 (second), 3, 9 another, 7 and 8 a third
    assert got == [(1, 2, 1), (1, 4, 1), (2, 4, 1), (3, 2, 1), (4, 4, 1), (5, 4, 1), (6, 4, 1), (7, 1, 7), (8, 1, 7), (9, 2, 1)]
    renamed = df.withColumnRenamed("n_links", "x").withColumnRenamed("vec_id", "component")
    assert embeddings.near_duplicates(renamed, key="component").columns == ["component", "n_links", "component_"]


def test_top_k_of_components_beyond_64_bits(spark):
    rows = [(1, [1e18, 1.0]), (2, [-1e300, 1.0]), (3, [2.0, 3.0]), (4, [9e15, 2.0]), (5, [9e15, 1.0]), (6, [1.5, -0.25])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").select("vec_id", topk.integers(F.col("embedding")).alias("v"), "score")
    low, high = -(1 << 63), (1 << 63) - 1
    values = {i: [min(max(math.floor(1024 * x), low), high) for x in v] for i, v in rows}
    want = []
    for q, v in values.items():
        best = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), low), high), i) for i, w in values.items() if i != q)[:3]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df, df, "vec_id", "v", 3).collect()) == sorted(want)


def test_html_blocks():
    page = "<head><title>T</title></head><nav>menu</nav><div class='cookie-notice'>ok?</div><article><header><h1>Head &amp; line</h1></header><p>One <b>two<br>three</b>\n four<p>&lt;i&gt; &#233;<aside>no</aside><div class=comments>bad</div><script>1<2</script></article><footer>f</footer>"
    assert html.blocks(page) == [("menu", -1), ("ok?", -1), ("Head & line", 1), ("One two three four", 1), ("<i> é", 1), ("no", -1), ("bad", -1), ("f", -1)]
    assert html.blocks("a < b <!-- c --> d") == [("a < b d", 0)]
    assert html.blocks(None) == html.blocks("") == []
    assert html.blocks("x<svg/>y<svg>no</svg>z<svg>w") == [("xyzw", 0)]  # an unclosed one is a tag alone
    assert html.blocks("<p title='a>b'>one <a href=\"x>two</a> three <i") == [("one two three <i", 0)]  # quotes that never close
    assert html.blocks("<div hidden>no</div><p data-class='ad'>yes</p>&#" + "1" * 5000 + ";") == [("no", -1), ("yes", 0), ("\ufffd", 0)]


@pytest.mark.parametrize("part", ["<a", "<a \"'>", "<a '\"> ", "<div>", "<svg>", "</script", "<", "<!--", "<p>", "</nav", "&#1", "class "])
def test_html_pages_of_one_megabyte_take_linear_time(part):
    n = 1_000_000 // len(part)
    for page in (part * n, part * n + ">", "<div " + part * n + ">", "<div>" * 50_000 + "<script>" + part * n):
        start = time.process_time()
        html.blocks(page)
        assert time.process_time() - start < 5


def brute_texts(rows):
    """Main text of (page_id, url, html) by sets of word tuples."""
    parsed = [(i, (re.search(r"://([^/?#]*)", u or "") or [None, ""])[1].lower(), html.blocks(h)) for i, u, h in rows]
    grams = lambda w: [tuple(w[p : p + 8]) for p in range(max(1, len(w) - 7))]
    pages = {}
    for i, host, found in parsed:
        for text, kind in found:
            if kind <= 0:
                for g in grams(text.split(" ")):
                    pages.setdefault((host, g), set()).add(i)
    out = []
    for i, host, found in parsed:
        parts = []
        for text, kind in found:
            words = text.split(" ")
            gone = [False] * len(words)
            if kind == 0:
                for p, g in enumerate(grams(words)):
                    if len(pages[host, g]) > 1:
                        gone[p : p + 8] = [True] * len(gone[p : p + 8])
            if kind >= 0:
                parts.append(" ".join(w for w, x in zip(words, gone, strict=True) if not x))
        out.append((i, "\n\n".join(p for p in parts if p)))
    return out


def sites():
    """A hot host of 60 pages, small ones, menus that only some pages mark, notices on two pages, copies, odd rows."""
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    menu, notice, short, passage = say(14), [say(12) for _ in range(30)], [say(2) for _ in range(30)], say(40)
    rows = []
    for host, ids in (("hot.org", range(60)), ("b.org", range(100, 102)), ("C.org", range(200, 220)), ("one.org", range(300, 301))):
        for i in ids:
            bar = f"<nav>{menu}</nav>" if i % 2 else f"<div>{menu} {say(1)}</div>"
            lead = f"<div>{say(9)} {notice[i % 30]} {say(1)}</div><p>{short[i % 30]}</p>"
            main = f"<article><p>{passage}</p><p>{say(20)}</p></article>" if i % 3 else f"<div>{say(30)}</div>"
            rows.append((i, f"http://{host}/{i}", bar + lead + main + f"<footer>{say(3)}</footer><div>{say(3)}</div>"))
    rows += [rows[45], rows[0], (None, "http://hot.org/", None), (None, "http://hot.org/x", f"<p>{say(12)}"), (None, "http://hot.org/y", rows[45][2]), (400, None, f"<p>{menu}"), (401, "", f"<p>{menu}"), (402, "http://d.org/", "<p>" + say(3000))]
    return rows


def test_html_query_equals_brute_force(spark):
    rows = sites()
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, text string, row int").repartition(7)
    want = sorted(brute_texts(rows), key=repr)
    assert sum(len(t) for _, t in want) < sum(len(" ".join(b for b, k in html.blocks(h) if k >= 0)) for _, _, h in rows) * 0.9
    for size in (400_000, 50, 1):  # any cut into local arrays gives the same
        assert sorted(((r.page_id, r.text) for r in html.extract(df, size).collect()), key=repr) == want
    assert html.extract(df.repartition(1)).count() == len(rows)


def test_html_array_finds_marked_boilerplate_too(spark):
    rows = sites()
    got = {r.kind: r for r in html.coverage(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[-1].covered_words > 0.6 * got[-1].words  # the menus, not the footers
    assert 0 < got[0].covered_words < got[0].words


def test_local_array_gives_every_substring_once():
    streams = [["a"] * 12, ["a"] * 8, ["b", "a"], ["b", "a"], ["b", "a", "c"], [str(i) for i in range(10)]]
    rows = list(html.local_array(streams, [0, 0, 0, 1, 0, 0], [5, 3, 1, 1, 2, 9]))
    got = sorted((tuple(streams[b][p : p + 8]), [0, 0, 0, 1, 0, 0][b], lo, hi) for b, p, lo, hi in rows)
    digits = [str(i) for i in range(10)]
    want = [(tuple(["a"] * 8), 0, 3, 5), (("b", "a"), 0, 1, 1), (("b", "a"), 1, 1, 1), (("b", "a", "c"), 0, 2, 2), *((tuple(digits[i : i + 8]), 0, 9, 9) for i in range(3))]
    assert got == sorted(want)
    assert list(html.local_array([], [], [])) == []


def test_html_query_equals_plain_parse(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(df.withColumn("text", F.lit(1))).collect()}
    for r in df.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        import html as escapes

        want = [" ".join(escapes.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(b for b in want if b)
    assert html.extract(df.where("false")).count() == 0
    assert html.extract(spark.createDataFrame([(None, None, None), (1, None, "<p>x")], "page_id long, url string, html string")).count() == 2
