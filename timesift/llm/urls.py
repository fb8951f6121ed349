"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timesift.llm.common import cut_lineage, host_of, lower_ascii

DIM, SIZES, STEPS, RATE, DECAY = 8192, (3, 4), 80, 2.0, 1e-3
TRAIN_ROWS = 10_000
"""Rows that the labelled table may have; a larger one is refused."""

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))

# A small labelled table: words of unwanted and wanted sites in hosts and paths; neutral paths come with both.
BAD_HOSTS = ("casino-win", "free-bets", "best-poker", "xxx-video", "m.hot-sex-cams", "www.cheap-pills", "viagra-shop", "win-money-now", "slots-bonus",
             "adult-porn", "adult-x-chat", "payday-loans", "lottery-jackpot", "crack-keygen", "warez-download", "replica-watches", "spam-links", "link-farm",
             "ads-popup", "click-track-ads")
GOOD_HOSTS = ("news", "library", "museum", "weather", "blog.garden", "www.science", "m.cooking", "university", "health-advice", "city-council",
              "history", "travel-notes", "www.music", "school", "sports-club", "recipes", "m.theatre", "blog.therapist", "www.athletics", "thunder-tion")
BAD_PATHS = ("/play/bonus", "/free-spins", "/xxx/cams", "/buy-now/pills")
GOOD_PATHS = ("/articles/story", "/about", "/wiki/page", "/2020/05/review")
NEUTRAL_PATHS = ("/en/5462", "/de/77.html", "/", "/fr/1")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url, bad`` of the small labelled table: every host with every path of its kind and every neutral one."""
    rows = [(f"https://{h}.example.{('com', 'net', 'org')[(i + j) % 3]}{p}", int(bad))
            for bad, hosts, paths in ((1, BAD_HOSTS, BAD_PATHS), (0, GOOD_HOSTS, GOOD_PATHS))
            for i, h in enumerate(hosts) for j, p in enumerate((*paths, *NEUTRAL_PATHS))]
    values = ", ".join(f"('{u}', {b})" for u, b in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, bad)")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null when none fits. A rule fits its host and all subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def features(host: Column, path: Column, dim: int = DIM) -> Column:
    """Hashed 3- and 4-grams of host and path, each marked by its part and bounded by ^ and $; distinct slots from 0."""
    def grams(mark: str, text: Column, n: int) -> Column:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        ends = F.length(whole) - (n - 1)
        starts = F.when(ends >= 1, F.sequence(F.lit(1), F.greatest(ends, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(whole, i, F.lit(n))), F.lit(dim)).cast("int"))

    parts = [grams(mark, text, n) for mark, text in (("h", host), ("p", lower_ascii(path))) for n in SIZES]
    return F.array_distinct(F.concat(*parts))


def train(labelled: DataFrame, dim: int = DIM, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> DataFrame:
    """One row ``w``: ``dim`` weights and then the bias, by gradient descent over the whole labelled table.

    The table is small by contract (at most ``TRAIN_ROWS`` rows, else an error) and becomes one row; the
    descent is one nested expression: margins from slots, then the gradient of each slot from the rows that hold it.
    """
    known = labelled.filter("url IS NOT NULL AND bad IS NOT NULL")
    n = known.count()
    if n > TRAIN_ROWS:
        raise ValueError(f"the labelled URL table has {n} rows; at most {TRAIN_ROWS} are taken")
    rows = known.select(features(host_of(F.col("url")), path_of(F.col("url")), dim).alias("slots"), F.col("bad").cast("double").alias("y"))
    packed = rows.agg(F.sort_array(F.collect_list(F.struct("y", "slots"))).alias("r")).filter(F.size("r") > 0)
    each = cut_lineage(packed.select(F.posexplode("r").alias("i", "row")).select(
        (F.col("i") + 1).alias("i"), "row.y", F.explode("row.slots").alias("slot")))
    # The used slots in order, each with the numbers (from 1) of the rows that hold it; and the other way round.
    by_slot = each.groupBy("slot").agg(F.sort_array(F.collect_list("i")).alias("held"))
    used = cut_lineage(by_slot.agg(F.sort_array(F.collect_list(F.struct("slot", "held"))).alias("u")))
    numbered = used.select(F.posexplode("u").alias("p", "u")).select((F.col("p") + 1).alias("p"), F.explode("u.held").alias("i"))
    by_row = numbered.groupBy("i").agg(F.sort_array(F.collect_list("p")).alias("slots")).join(each.select("i", "y").distinct(), "i")
    listed = by_row.agg(F.sort_array(F.collect_list(F.struct("i", "y", "slots"))).alias("rows"))
    held = cut_lineage(listed.filter(F.size("rows") > 0).withColumn("u", used.scalar()).select(
        "rows", F.col("u.slot").alias("used"), F.col("u.held").alias("held")))
    scale = F.lit(rate) / F.size("rows")

    def step(model: Column, _: Column) -> Column:
        miss = F.transform("rows", lambda r: F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.aggregate(
            r["slots"], model["b"], lambda s, i: s + F.element_at(model["w"], i))))) - r["y"])
        gone = F.struct(model["w"].alias("w"), model["b"].alias("b"), miss.alias("e"))
        return F.element_at(F.transform(F.array(gone), lambda g: F.struct(
            F.zip_with(g["w"], F.col("held"), lambda w, rows: w * F.lit(1 - rate * decay) - scale * F.aggregate(
                rows, F.lit(0.0), lambda s, i: s + F.element_at(g["e"], i))).alias("w"),
            (g["b"] - scale * F.aggregate(g["e"], F.lit(0.0), lambda s, e: s + e)).alias("b"))), 1)

    start = F.struct(F.transform("used", lambda _: F.lit(0.0)).alias("w"), F.lit(0.0).alias("b"))
    fitted = held.select("used", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("m"))
    return cut_lineage(fitted.withColumn("by", F.map_from_arrays("used", "m.w")).select(F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda s: F.coalesce(F.try_element_at("by", s), F.lit(0.0))),
        F.array("m.b")).alias("w")))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, dim: int = DIM) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of each row of ``pages(page_id, url)``.

    The longest fitting rule decides; without one the model blocks from a probability of 0.5. Null urls
    and urls without ``://`` have an empty host and path and are judged by the model like any other.
    With an empty labelled table nothing is known: such urls are allowed, their score is null.
    Repeated rows each return a row.
    """
    model = train(labelled_urls(pages.sparkSession) if labelled is None else labelled, dim)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    w = model.scalar()  # one row, known once for the whole query
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = parts.withColumns({"rule": rule, "v": verdict, "w": w})
    margin = F.aggregate(features(F.col("host"), F.col("path"), dim), F.element_at("w", -1),
                         lambda s, i: s + F.element_at(F.col("w"), i + 1))
    return known.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).select(
        "page_id", "host", "path", "rule",
        F.coalesce("v", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
