"""URL filters: a fixed rule list first, then association rules mined from labelled URLs.

Rule list. A rule allows or blocks a host, its subdomains and the paths below it; the longest fitting rule wins (of two equally
long ones the one with the longer host).

Association rules. A URL is a set of tokens: scheme, labels and last label of the host, words of the path (numbers are one token),
names of the query and whether there is a fragment. Spark's FP-growth mines the token sets of the labelled URLs together with the
label. A combination of at most ``longest`` tokens becomes a blocking rule when at least ``min_rows`` labelled URLs (and
``min_support`` of them) hold it and are bad and these are at least ``min_percent`` of all labelled URLs that hold it; rules that hold
a smaller rule of at least the same share are pruned. Every token held by that many bad URLs enters the mining. FP-growth has no limit on the size of
its sets, which double with each token of a URL: where a labelled URL has more than ``items`` such tokens, sets are counted level by level
instead, up to ``longest`` tokens, with the same rules. A level grows only sets that can still be part of a rule: a set held by the same URLs as a
smaller one, or that holds a set of bad URLs only, would be pruned in the end, and so would all that hold it.

Matching. Rules lie in an inverted index under their rarest token. The distinct token sets of URLs that the list leaves open are exploded, meet the
index by that token, and a rule fits when the set holds all its tokens. The best one (share, rows, tokens) gives the verdict ``block``;
where none fits it is ``allow``.

Null or malformed URLs have empty host and path and no rule; empty tables give no rows, without labels nothing is blocked
beyond the list; repeated rows are judged one by one; a URL is read whole, at any length; extra columns never matter. A URL is bad when any
of its labels says so.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsignal.llm.graph import stored

#: Fixed by the contract of the query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MIN_SUPPORT, MIN_ROWS, MIN_PERCENT, LONGEST, ITEMS = 0.002, 10, 60, 3, 12
BAD = "label=bad"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: str) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _PARTS, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _PARTS, 2)


def listed(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns ``host`` and ``path``; null where none does."""
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        rule = F.when(fits(h, p), h + p).otherwise(rule)
        verdict = F.when(fits(h, p), what).otherwise(verdict)
    return rule, verdict


def tokens(url: str) -> Column:
    """Sorted distinct tokens of a URL with the columns ``host`` and ``path``."""
    u = F.coalesce(F.col(url), F.lit(""))
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    steps = F.transform(F.regexp_extract_all(F.lower("path"), F.lit("[0-9a-z]+"), F.lit(0)), lambda x: F.when(x.rlike("^[0-9]+$"), "#").otherwise(x))
    names = F.regexp_extract_all(F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("(?:^|&)([^=&]+)"), F.lit(1))
    every = F.concat(F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(u, r"(?s)^(.*?)://", 1)))),
                     F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
                     F.array(F.concat(F.lit("top="), F.regexp_extract("host", r"([^.]*)$", 1))),
                     F.transform(steps, lambda x: F.concat(F.lit("path="), x)), F.transform(names, lambda x: F.concat(F.lit("query="), x)),
                     F.when(F.contains(u, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(every))


def _grown(each: DataFrame, least: int, longest: int) -> DataFrame:
    """(tokens, n, bad) of the sets of at most ``longest`` tokens that ``least`` bad URLs hold, by FP-growth, from (id, bad, token)."""
    chosen = each.groupBy("id").agg(F.collect_list("token").alias("some"), F.first("bad").alias("bad"))
    baskets = stored(chosen.select(F.when(F.col("bad"), F.array_append("some", F.lit(BAD))).otherwise(F.col("some")).alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=max(least - 0.5, 0.5) / baskets.count(), minConfidence=0.0).fit(baskets)
    sets = stored(model.freqItemsets.where(F.size("items") <= longest + 1), "itemsets")
    with_bad = F.array_contains("items", BAD)
    bad = sets.where(with_bad & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("bad"))
    whole = sets.where(~with_bad).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    return whole.join(bad, "tokens")


def _levels(each: DataFrame, least: int, longest: int) -> DataFrame:
    """The same, one token more a level, without the sets that a smaller one is sure to prune."""
    def counted(held):
        return held.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).where(F.col("bad") >= least)
    held = each.select("id", "bad", F.array("token").alias("tokens"))
    sets = stored(counted(held), "level")
    out = sets
    for size in range(2, longest + 1):
        grow = sets.where("bad < n")
        longer = held.join(grow.select("tokens"), "tokens", "left_semi").join(each.select("id", "token"), "id").where(F.col("token") > F.element_at("tokens", -1))
        held = stored(longer.select("id", "bad", F.array_append("tokens", F.col("token")).alias("tokens")), "held")
        some = stored(counted(held), "counted")
        # each part with one token less has been grown and is held by more URLs
        parts = some.select("tokens", F.col("n").alias("n1"), F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("part"))
        fine = parts.join(grow.select(F.col("tokens").alias("part"), "n"), "part").where("n > n1").groupBy("tokens").count().where(F.col("count") == size)
        sets = stored(some.join(fine, "tokens", "left_semi"), "level")
        out = out.union(sets)
    return out


def mine(urls: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_percent: int = MIN_PERCENT,
         longest: int = LONGEST, items: int = ITEMS) -> DataFrame:
    """Blocking rules (tokens, n, bad) from labelled URLs (id unique, tokens, bad boolean)."""
    spark = urls.sparkSession
    urls = stored(urls.select("id", "tokens", "bad"), "labelled")
    total = urls.count()
    least = max(min_rows, -(-int(total * min_support * 1e6) // 10**6))
    each = urls.select("id", "bad", F.explode("tokens").alias("token"))
    count = each.groupBy("token").agg(F.count_if("bad").alias("b")).where(F.col("b") >= least)
    each = each.join(count.select("token"), "token")
    if total < least or each.isEmpty():
        return spark.createDataFrame([], "tokens array<string>, n long, bad long")
    each = stored(each, "tokens")
    most = each.groupBy("id").count().agg(F.max("count")).first()[0]   # one number
    sets = _grown(each, least, longest) if most <= items else _levels(each, least, longest)
    strong = stored(sets.where((F.col("bad") >= least) & (100 * F.col("bad") >= min_percent * F.col("n"))).select("tokens", "n", "bad"), "strong")
    # a rule goes when a smaller one inside it has at least its share: every smaller part of at most ``longest`` tokens is looked up
    n = F.col("k")
    part = lambda mask: F.filter("tokens", lambda x, i: F.expr("k").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    parts = (strong.where(F.size("tokens") > 1).withColumn("k", F.explode(F.expr("sequence(1, shiftleft(1, size(tokens)) - 2)")))
             .select("tokens", F.col("n").alias("n1"), F.col("bad").alias("bad1"), part(n).alias("part")))
    small = strong.select(F.col("tokens").alias("part"), "n", "bad")
    weak = parts.join(small, "part").where(F.col("bad") * F.col("n1") >= F.col("bad1") * F.col("n")).select("tokens").distinct()
    return stored(strong.join(weak, "tokens", "left_anti"), "rules")


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, why, share) of the best rule that fits each token set of ``sets`` (distinct ``tokens``)."""
    every = sets.select(F.explode("tokens").alias("token"))
    rare = rules.select(F.explode("tokens").alias("token")).distinct().join(every.groupBy("token").agg(F.count(F.lit(1)).alias("found")), "token", "left")
    anchor = (rules.select("tokens", "n", "bad", F.explode("tokens").alias("token")).join(rare, "token")
              .groupBy("tokens", "n", "bad").agg(F.min(F.struct(F.coalesce("found", F.lit(0)).alias("found"), "token"))["token"].alias("token")))
    index = anchor.select("token", F.col("tokens").alias("why"), "n", "bad")
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("why", "tokens")) == 0)
    key = F.struct((F.col("bad") / F.col("n")).alias("share"), "bad", (-F.size("why")).alias("size"), F.array_join("why", " ").alias("why"))
    return met.groupBy("tokens").agg(F.max(key).alias("best")).select("tokens", "best.why", "best.share")


def judge(urls: DataFrame, mined: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """``urls`` (its columns in a struct ``row``) with host, path, rule, verdict, why (tokens of the mined rule) and share."""
    rows = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("row"), F.col(f"`{url_col}`").cast("string").alias("u"))
    rows = rows.select("row", "u", host("u").alias("host"), path("u").alias("path"))
    rule, verdict = listed(rules)
    rows = rows.withColumns({"rule": rule, "listed": verdict}).withColumn("key", F.when(F.col("rule").isNull(), tokens("u")))
    sets = rows.where("key is not null").select(F.col("key").alias("tokens")).distinct()
    met = matches(sets, mined)
    found = rows.join(met, F.col("key") == F.col("tokens"), "left")
    return found.select("row", "host", "path", "rule", F.coalesce("listed", F.when(F.col("why").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "why", "share")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, tokens, bad): one row per page id with a label (``labels.doc_id`` is the id of the page); the first URL in byte order
    stands for an id with several. Bad is quality 0 or toxic 1."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.bool_or(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    urls = pages.where("page_id is not null").groupBy(F.col("page_id").cast("long").alias("id")).agg(F.min("url").alias("url"))
    return urls.join(marks, "id").select("id", "bad", "url", host("url").alias("host"), path("url").alias("path")).select("id", tokens("url").alias("tokens"), "bad")


def op12_url_filter(pages: DataFrame, labels: DataFrame) -> DataFrame:
    mined = mine(labelled(pages.select("page_id", "url"), labels.select("doc_id", "quality", "toxic")))
    out = judge(pages.select("page_id", "url"), mined)
    return out.select(F.col("row.page_id").cast("long").alias("page_id"), "host", "path", "rule", "verdict")
