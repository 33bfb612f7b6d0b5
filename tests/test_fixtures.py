"""Golden fixtures for semantics that the oracle does not share."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.dialect import complete, split, to_spark
from quern.functions import dates as D
from quern.functions import json as J
from quern.functions import numbers as N
from quern.functions import strings as S
from quern.plans import running as running_plan
from quern.plans.recursion import RecursionLimitError, fixpoint
from quern.sources import boxes, changes, fulltext
from quern.store import ConstraintError, ForeignKey, Store


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


# The inputs and results of the fixtures that FIXTURES.md lists.


def test_group_by_fixture(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7), (3, 8), (3, 9)], "log int, n int")
    rows = t.groupBy("log").agg(F.count("*"), F.sum("n"), F.avg("n"), F.max("n") + 1).orderBy("log").collect()
    assert [tuple(r) for r in rows] == [(1, 3, 6, 2.0, 4), (2, 2, 9, 4.5, 6), (3, 4, 30, 7.5, 10)]


def test_substr_rules(spark):
    h = F.lit("hello")
    assert one(spark, S.substr(h, 0, 3), S.substr(h, -3, 2), S.substr(h, 2), S.substr(h, 4, -2), S.substr(h, 9, 2), S.substr(F.lit(None).cast("string"), 1, 2)) == ("he", "ll", "ello", "el", "", None)


def test_like_and_glob(spark):
    words = ["a", "ab", "abc", "abcd", "ABC", "CDE", "ABC abc xyz", "Ä"]
    df = spark.createDataFrame([(w,) for w in words], "x string")
    get = lambda p: [r.x for r in df.where(p).collect()]
    assert get(S.like(F.col("x"), "aBc")) == ["abc", "ABC"]
    assert get(S.like(F.col("x"), "ä")) == []  # only A-Z are folded
    assert get(S.glob(F.col("x"), "abc*")) == ["abc", "abcd"]
    assert get(S.glob(F.col("x"), "[A-C][^x]C")) == ["ABC"]


def test_scalars(spark):
    assert one(spark, N.least(F.lit(1), F.lit(None).cast("int")), N.greatest(F.lit(1), F.lit(3)), N.divide(F.lit(-7), F.lit(2)), N.divide(F.lit(1), F.lit(0)), N.ratio(F.lit(1.0), F.lit(0.0))) == (None, 3, -3, None, None)
    assert one(spark, N.rounded(F.lit(2.5)), N.rounded(F.lit(-2.5)), N.numeric_prefix(F.lit("12.5abc")), N.numeric_prefix(F.lit("abc")), N.integer_prefix(F.lit(" -7x"))) == (3.0, -3.0, 12.5, 0.0, -7)
    assert one(spark, S.char(F.lit(72), F.lit(None).cast("int"), F.lit(8364)), S.trim(F.lit("\t x \n")), S.unhexed(F.lit("4g")), S.number_text(F.lit(2.0))) == ("H€", "x", None, "2")


def test_dates(spark):
    ts = F.lit("2020-01-31 13:05:09").cast("timestamp")
    assert one(spark, D.date(ts, "+1 month"), D.datetime(ts, "start of day", "-1 second"), D.julianday(F.lit("2020-01-01").cast("timestamp")), D.date(ts, "weekday 0")) == ("2020-02-29", "2020-01-30 23:59:59", 2458849.5, None)
    assert one(spark, D.strftime("%d.%m.%Y %I%p %W %q %%", ts)) == ("31.01.2020 01PM 04 %q %",)
    assert spark.range(1).select(D.parsed(F.lit("12:30")), D.from_julian(F.lit(2440587.5))).first()[0] == datetime(2000, 1, 1, 12, 30)


def test_json(spark):
    doc = F.lit('{"users":[{"name":"alice","age":30},{"name":"bob","age":25}],"b":2}')
    assert one(spark, J.extract(doc, "$.users[0].name"), J.extract(doc, "$.users[1].age"), J.arrow(doc, "$.users[0].name"), J.kind(doc, "$.users"), J.length(F.lit("[1,2]"))) == ("alice", "25", '"alice"', "array", 2)
    small = F.lit('{"a":1,"b":2,"c":3}')
    assert one(spark, J.remove(small, "$.b"), J.put(small, "$.d.e", 1), J.insert(small, "$.a", 9), J.replace(small, "$.a", 9)) == ('{"a":1,"c":3}', '{"a":1,"b":2,"c":3,"d":{"e":1}}', '{"a":1,"b":2,"c":3}', '{"a":9,"b":2,"c":3}')
    assert one(spark, *[J.valid(F.lit(x)) for x in ('{"a":1}', "{a", "1],[2", "1 2", "3")]) == (1, 0, 0, 0, 1)


def test_dialect():
    assert to_spark("SELECT \"a\" FROM t WHERE [b] == 1 LIMIT 2, 5") == "SELECT `a` FROM t WHERE `b` = 1 LIMIT 5 OFFSET 2"
    assert to_spark("a IS b AND c LIKE 'x == y' AND d NOTNULL") == "a <=> b AND c ILIKE 'x == y' AND d IS NOT NULL"
    assert split("SELECT 1; CREATE TRIGGER t AFTER INSERT ON x BEGIN SELECT 1; SELECT 2; END; SELECT ';'") == ["SELECT 1", "CREATE TRIGGER t AFTER INSERT ON x BEGIN SELECT 1; SELECT 2; END", "SELECT ';'"]
    assert complete("SELECT 1;") and not complete("SELECT 1") and not complete("SELECT 'a;")


def test_recursion(spark):
    series = fixpoint(spark.sql("SELECT 1 AS n"), lambda w: w.where("n < 130").selectExpr("n + 1 AS n"))
    assert series.agg(F.sum("n")).first()[0] == 130 * 131 // 2
    with pytest.raises(RecursionLimitError):
        fixpoint(spark.sql("SELECT 1 AS n"), lambda w: w.where("n < 50").selectExpr("n + 1 AS n"), limit=5)
    assert fixpoint(spark.sql("SELECT 1 AS n"), lambda w: w.where("n < 6").selectExpr("n + 1 AS n"), limit=5).count() == 6
    ring = fixpoint(spark.sql("SELECT 0 AS n"), lambda w: w.selectExpr("(n + 1) % 4 AS n").unionAll(w.selectExpr("(n + 1) % 4 AS n")), distinct=True)
    assert sorted(r.n for r in ring.collect()) == [0, 1, 2, 3]


def test_running_sums_over_a_whole_order(spark, monkeypatch):
    monkeypatch.setattr(running_plan, "LEVEL", 2)
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "a", None]), rng.choice([None, 1, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, v int").repartition(5)
    got = running_plan.running(df, [F.desc_nulls_last("k"), "id"], {"s": "v"}, "n", parts=7).collect()
    want, total = [], 0
    for n, (i, k, v) in enumerate(sorted(rows, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], r[0])), 1):
        total += v or 0
        want.append((i, k, v, n, total))
    assert sorted(tuple(r) for r in got) == sorted(want, key=lambda r: r[0])
    assert running_plan.running(df.where("false"), ["id"], number="n").count() == 0


def test_fulltext_and_boxes(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "quickly done"), (3, None)], "id int, t string")
    assert [r.id for r in docs.where(fulltext.match(F.col("t"), "quick")).collect()] == [1, 2]
    assert [r.id for r in docs.where(fulltext.match(F.col("t"), 'quick AND "brown f"')).collect()] == [1]
    assert docs.where(fulltext.match(F.col("t"), " ")).count() == docs.where(fulltext.match(F.col("t"), "and OR")).count() == 3
    marks = spark.createDataFrame([(1, 'Say "well-known" (c++), 3rd!'), (2, "known facts")], "id int, t string")
    found = {q: [r.id for r in marks.where(fulltext.match(F.col("t"), q)).orderBy("id").collect()] for q in ("known", "well-kn*", "c++", "c", "3rd", "-known", "WELL known", "*")}
    assert found == {"known": [2], "well-kn*": [1], "c++": [], "c": [1], "3rd": [1], "-known": [], "WELL known": [], "*": [1, 2]}
    b = spark.createDataFrame([(1, 0.0, 9.0, 0.0, 9.0), (2, 8.0, 12.0, 8.0, 9.5), (3, 20.0, 21.0, 0.0, 1.0)], "id int, x0 double, x1 double, y0 double, y1 double")
    assert [tuple(r) for r in boxes.overlap_join(b, {"x": 3.0, "y": 3.0}).collect()] == [(1, 2)]
    rng = random.Random(1)
    rows = [(i, x, x + rng.choice([0.0, 0.5, 3.0, 40.0, 1e12]), y, y + rng.choice([0.1, 2.0, 1e9])) for i in range(120) for x, y in [(rng.uniform(-50, 50), rng.uniform(-50, 50))]]
    rows += [(500, None, 1.0, 0.0, 1.0), (501, 0.0, float("nan"), 0.0, 1.0), (502, 5.0, 1.0, 0.0, 1.0)]
    b = spark.createDataFrame(rows, "id int, x0 double, x1 double, y0 double, y1 double").repartition(4)
    good = rows[:120]
    want = sorted((p[0], q[0]) for p in good for q in good if p[0] < q[0] and p[1] <= q[2] and p[2] >= q[1] and p[3] <= q[4] and p[4] >= q[3])
    assert sorted(tuple(r) for r in boxes.overlap_join(b, {"x": 1.0, "y": 0.5}).collect()) == want
    assert boxes.overlap_join(b.where("false"), {"x": 1.0, "y": 0.5}).count() == 0


def _touching(rows):
    return sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] <= q[2] and p[2] >= q[1] and p[3] <= q[4] and p[4] >= q[3])


def test_boxes_of_crowded_cells_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(boxes, "BLOCK", 16, raising=False)
    monkeypatch.setattr(boxes, "PAIRS", 1000, raising=False)
    rng = random.Random(3)
    rows = [(i, 1.0, 4.0, 1.0, 3.0) for i in range(300)]  # copies in one cell
    for i in range(300, 480):  # two crowded levels and their borders
        x, y, w = rng.uniform(-4, 8), rng.uniform(-4, 8), rng.choice([0.5, 4.0, 7.0])
        rows.append((i, x, x + w, y, y + w))
    df = spark.createDataFrame(rows, "id int, x0 double, x1 double, y0 double, y1 double").repartition(3)
    got = [tuple(r) for r in boxes.overlap_join(df, {"x": 4.0, "y": 4.0}).withColumn("p", F.spark_partition_id()).collect()]
    assert sorted(r[:2] for r in got) == _touching(rows)
    of = [r[2] for r in got]
    assert max(map(of.count, set(of))) < len(got) / 10
    monkeypatch.setattr(boxes, "LISTED", 0, raising=False)
    assert sorted(tuple(r) for r in boxes.overlap_join(df, {"x": 4.0, "y": 4.0}).collect()) == _touching(rows)


def test_boxes_whose_width_is_rounded_and_ids_that_repeat(spark):
    rows = [(1, 3.9999999999999996, 8.0, 0.0, 1.0), (2, 5.0, 6.0, 0.0, 1.0), (3, 5.0, 9.0, 0.0, 1.0), (3, 0.0, 90.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, x0 double, x1 double, y0 double, y1 double")
    assert sorted(tuple(r) for r in boxes.overlap_join(df, {"x": 4.0, "y": 4.0}).collect()) == _touching(rows)


def test_store(spark):
    s = Store(spark)
    s.create("p", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), primary=("k",))
    s.create("c", spark.createDataFrame([(10, 1), (11, 2), (12, None)], "i int, k int"), foreign=(ForeignKey(("k",), "p", ("k",), "cascade"),))
    with pytest.raises(ConstraintError):
        s.insert("p", spark.createDataFrame([(1, "z")], "k int, v string"))
    with pytest.raises(ConstraintError):
        s.insert("c", spark.createDataFrame([(13, 9)], "i int, k int"))
    s.begin()
    s.delete("p", "k = 1")
    assert sorted(r.i for r in s["c"].collect()) == [11, 12]
    s.rollback()
    assert s["c"].count() == 3 and s["p"].count() == 2
    for i in range(25):  # lineage is cut on the way
        s.update("p", {"v": f"'{i}'"}, "k = 2")
    assert {r.k: r.v for r in s["p"].collect()} == {1: "a", 2: "24"}


def test_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "z")], "k int, v string")
    d = changes.diff(a, b, ["k"])
    assert sorted((r.op, r.k) for r in d.collect()) == [("D", 1), ("I", 3)]
    assert sorted(map(tuple, changes.apply(a, d, ["k"]).collect())) == sorted(map(tuple, b.collect()))
    assert changes.conflicts(b, d, ["k"]).count() == 2
    back = changes.decode(changes.encode(d), d.schema)
    assert back.schema.simpleString() == d.schema.simpleString() and sorted(map(repr, back.collect())) == sorted(map(repr, d.collect()))
