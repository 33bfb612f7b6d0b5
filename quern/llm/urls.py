"""URL filters (operator 3), native: DataFrame functions only.

Rules (a host with its subdomains and a path prefix) decide first, the longest that fits wins.  The other urls are
judged by two character language models, one of the urls that rules allow and one of those that rules block:
variable-order Markov models over the last 0, 1 and 2 characters, interpolated by Witten-Bell smoothing.  They read the whole url
after "://", query and fragment included, in 32 symbols: digits are one, and all but a-z, digits and ./-_ are another.  The
verdict compares the log-likelihood difference a character with a threshold calibrated on the urls that rules judge:
the point that lies as many standard deviations below the mean of the allowed as above that of the blocked.

Scale: characters are mapped to ``BASE`` symbols, so a model is BASE^3 weights whatever the data.  Counts cover every
ruled url and are summed within a task before the one small shuffle; the table of weights (36 thousand numbers) and
the threshold go into the plan as literals.  Pages are scanned twice: for the counts, and to score each url once into a table in the
shared folder (name the columns to keep beforehand), which gives the threshold and the verdicts.

Defined results: a null url or one without "://" has empty host and path, no score, and is blocked; repeated rows are
judged alike; with no allowed or no blocked url the threshold is 0 and the missing model uniform; other columns are left alone;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import ASCII_LOWER, ASCII_UPPER, free_names
from quern.shared import drop_table, shared_table

#: (allow or block, host/path) of the query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Symbols 1..31; digits count as 0, everything else is symbol 32, and 0 stands before the first character.
SYMBOLS = ASCII_LOWER + "0./-_"
BASE = len(SYMBOLS) + 2


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    """What stands between the host and the first ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rest_of(url: Column) -> Column:
    """What stands after the host: path, query and fragment."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*(.*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules, value) -> Column:
    """``value(verdict, text)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(value(verdict, text))).otherwise(out)
    return out


def grams(text: Column) -> Column:
    """Of each character: its number together with the two before it, below BASE^3."""
    plain = F.translate(F.translate(text, ASCII_UPPER, ASCII_LOWER), "123456789", "0" * 9)
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.when(F.instr(F.lit(SYMBOLS), c) > 0, F.instr(F.lit(SYMBOLS), c)).otherwise(BASE - 1))
    # arrays are zipped, as a lambda would build the shifted array anew for every character
    before = F.zip_with(F.concat(F.array(F.lit(0), F.lit(0)), codes), F.concat(F.array(F.lit(0)), codes), lambda a, b: (a * BASE + b) * BASE)
    return F.filter(F.zip_with(before, codes, lambda ab, c: ab + c), lambda g: g.isNotNull())


def train(labelled: DataFrame) -> str:
    """(grams array, accepted boolean) -> the BASE^3 log-likelihood ratios as text, by number, comma-separated."""
    spark = labelled.sparkSession
    # BASE^3 rows at most, read for the totals and for the weights
    counts = shared_table(labelled.select(F.explode("grams").alias("g"), "accepted").groupBy("g").agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no")), "counts")
    totals = counts.agg(F.coalesce(F.sum("yes"), F.lit(0)).alias("yes"), F.coalesce(F.sum("no"), F.lit(0)).alias("no")).first()
    grid = spark.range(BASE**3).withColumnRenamed("id", "g").join(counts, "g", "left").na.fill(0, ["yes", "no"])
    grid = grid.withColumns({"a": F.floor(F.col("g") / BASE**2), "b": F.floor(F.col("g") / BASE) % BASE, "c": F.col("g") % BASE})
    over = {k: Window.partitionBy(*k) for k in ("ab", "bc", "b", "c")}
    ratio = F.lit(0.0)
    for n, sign in (("yes", 1), ("no", -1)):
        s = F.struct(
            F.sum(n).over(over["ab"]).alias("ab"),
            F.sum((F.col(n) > 0).cast("int")).over(over["ab"]).alias("kinds_ab"),
            F.sum(n).over(over["bc"]).alias("bc"),
            F.sum(n).over(over["b"]).alias("b"),
            F.sum(n).over(over["c"]).alias("c"),
        )
        grid = grid.withColumn(f"s_{n}", s)
        grid = grid.withColumn(f"k_{n}", F.sum((F.col(f"s_{n}.bc") > 0).cast("int")).over(over["b"]) / BASE)
        p1 = (F.col(f"s_{n}.c") + 1) / F.lit(float(totals[n] + BASE))
        p2 = _mixed(F.col(f"s_{n}.bc"), F.col(f"s_{n}.b"), F.col(f"k_{n}"), p1)
        p3 = _mixed(F.col(n), F.col(f"s_{n}.ab"), F.col(f"s_{n}.kinds_ab"), p2)
        ratio = ratio + sign * F.log(p3)
    row = grid.select("g", F.format_string("%.5f", ratio).alias("w")).agg(F.array_sort(F.collect_list(F.struct("g", "w"))).alias("x"))
    out = row.select(F.array_join(F.transform("x", lambda x: x["w"]), ",")).first()[0]
    drop_table(counts)
    return out


def _mixed(n: Column, context: Column, kinds: Column, lower: Column) -> Column:
    """Witten-Bell: the count's estimate and the lower order's, weighted by the context's count and its kinds of follower."""
    return F.when(context > 0, (n + kinds * lower) / (context + kinds)).otherwise(lower)


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, score (null where a rule or nothing decides) and verdict."""
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    text, ruled, accepted = free_names([*pages.columns, "host", "path", "rule", "score", "verdict"], "__text", "__ruled", "__accepted")
    base = pages.select(*names, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.concat(host_of(F.col(url)), rest_of(F.col(url))).alias(text))
    base = base.withColumns({"rule": _rule(F.col("host"), F.col("path"), rules, lambda v, t: t), ruled: _rule(F.col("host"), F.col("path"), rules, lambda v, t: v)})
    some = F.col(text) != ""
    labelled = base.where(F.col("rule").isNotNull() & some).select(grams(F.col(text)).alias("grams"), (F.col(ruled) == "allow").alias("accepted"))
    weights = F.split(F.lit(train(labelled)), ",").cast("array<double>")

    def score(g: Column) -> Column:
        return F.try_divide(F.aggregate(g, F.lit(0.0), lambda s, x: s + F.get(weights, x.cast("int"))), F.size(g))

    # every url is scored once; the ruled ones for the threshold
    scored = shared_table(base.withColumn("score", F.when(some, score(grams(F.col(text))))).drop(text), "scored")
    by = scored.where(F.col("rule").isNotNull() & F.col("score").isNotNull()).groupBy((F.col(ruled) == "allow").alias(accepted))
    found = {r[accepted]: (r["m"], r["s"] + 1e-6) for r in by.agg(F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("s")).collect()}  # two rows
    (yes, sy), (no, sn) = found.get(True, (0.0, 1.0)), found.get(False, (0.0, 1.0))
    threshold = (yes * sn + no * sy) / (sy + sn) if len(found) == 2 else 0.0
    method = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    verdict = F.coalesce(F.col(ruled), method).alias("verdict")
    return scored.select(*names, "host", "path", "rule", F.when(F.col("rule").isNull(), F.col("score")).alias("score"), verdict)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
