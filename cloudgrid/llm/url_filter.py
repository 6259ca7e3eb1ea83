"""URL filtering by path rules and by mined token rules.

Listed host and path rules judge the URLs they fit. Their verdicts label those
URLs, Spark's FP-growth mines which combinations of URL tokens go with a block,
and the rules that pass bounds of support, confidence and lift judge all other
URLs through an inverted index from each rule's rarest item.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Items of one row that FP-growth takes as they are; rows of more are projected on their last items first.
MAX_ITEMS = 12


@dataclass(frozen=True)
class PathRule:
    """A rule 'host/path...': fits the host and its subdomains where the path starts so."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first '://' up to '/', '?', '#'; path: up to '?', '#'. Else empty."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def longest_rule(host: Column, path: Column, rules: list[PathRule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.rule).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host suffixes, labels before the last two, path words with digits as 0, query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    tags = lambda prefix, xs: F.transform(xs, lambda x: F.concat(F.lit(prefix), x))
    digits = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    words = F.transform(F.filter(F.split(path, "[/._-]+"), lambda x: x != ""), digits)
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), digits)
    scheme = F.array(F.substring_index(url, "://", 1))
    suffix = F.when(F.size(labels) > 1, F.array(F.concat_ws(".", F.slice(labels, -2, 2)), F.element_at(labels, -1))).otherwise(labels)
    found = F.array_distinct(F.flatten(F.array(tags("s:", scheme), tags("d:", suffix), tags("h:", F.slice(labels, 1, F.greatest(F.lit(0), F.size(labels) - 2))), tags("p:", words), tags("q:", keys))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(found)


def token_classes(labelled: DataFrame, needed: int) -> DataFrame:
    """(item, members, n, blocked) of tokens that needed blocked rows or more have.

    Tokens that stand in the same rows are one item, named by its first member: in
    a combination each can take the other's place. Rows are told by two 64-bit
    hashes of their number, combined by exclusive or. There are at most as many
    tokens here as a labelled row has on average, divided by the support.
    """
    each = labelled.select(F.explode("tokens").alias("token"), (F.col("verdict") == "block").alias("b"), F.xxhash64("row").alias("h"), F.xxhash64("row", F.lit(1)).alias("g"))
    per = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("b").alias("blocked"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")).where(F.col("blocked") >= needed)
    return per.groupBy("h", "g", "n", "blocked").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members")).select("item", "members", "n", "blocked")


def mine(labelled: DataFrame, wanted: DataFrame, min_support: float, min_confidence: float, min_rows: int, min_z: float) -> tuple[DataFrame, DataFrame]:
    """(rules, lookup) from (row, tokens, verdict) and open URLs' (url, token): rules (items array<string>, confidence, support), lookup (token, item).

    A combination of tokens is a rule if min_support of all rows, and min_rows at
    least, have it and are blocked, if min_confidence of the rows that have it are
    blocked, and if that is min_z standard errors more than the share of blocked
    rows among all. Of these the shortest stay: a URL that a longer one fits, one of
    them fits too. So items that are rules by themselves aren't combined further.
    FP-growth combines the others, over the blocked rows, since only these give
    support. Rows of more than MAX_ITEMS items are projected before, as projected()
    tells; then rules that no open URL holds may be missing, which changes no
    verdict. What it finds is counted exactly, over all rows.
    """
    n, blocked = labelled.agg(F.count("*"), F.count_if(F.col("verdict") == "block")).first()
    needed = max(1, min_rows, math.ceil(min_support * n - 1e-9))
    base = blocked / n if n else 1.0
    share = F.col("blocked") / F.col("n")
    good = (share >= min_confidence - 1e-12) & (share > base) & (share - base >= min_z * F.sqrt(base * (1 - base) / F.col("n")))
    items = materialise(token_classes(labelled, needed))
    found = [items.where(good).select(F.array("item").alias("items"), "n", "blocked")]
    rest = items.where(~good)
    if rest.count() > 1:
        names = rest.select(F.explode("members").alias("token"), "item", share.alias("share"))
        each = labelled.select("row", (F.col("verdict") == "block").alias("b"), F.explode("tokens").alias("token")).join(names, "token")
        held = each.groupBy("row", "b").agg(F.collect_set(F.struct("share", "item")).alias("s")).select("b", F.sort_array("s", asc=False)["item"].alias("items"))
        patterns = materialise(held.groupBy("items").agg(F.count("*").alias("n"), F.count_if("b").alias("blocked")))
        longest = patterns.where("blocked > 0").agg(F.max(F.size("items"))).first()[0] or 0
        if longest > MAX_ITEMS:
            asked = wanted.join(names, "token").groupBy("url").agg(F.collect_set(F.struct("share", "item")).alias("s")).select(F.sort_array("s", asc=False)["item"].alias("items")).distinct()
            rules = materialise(projected(patterns, asked, rest, n - blocked, needed, good))
        else:
            candidates = materialise(_combined(patterns, needed))
            rules = materialise(_counted(candidates, patterns, rest.select("item", F.col("n").alias("rows"))).where(good))
        # a shorter rule shares an item, so both meet under it
        one = rules.select(F.explode("items").alias("item"), "items")
        longer = one.join(one.withColumnRenamed("items", "short"), "item").where((F.size("short") < F.size("items")) & (F.size(F.array_except("short", "items")) == 0))
        found.append(rules.join(longer.select("items").distinct(), "items", "left_anti").select("items", "n", "blocked"))
    rules = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    rules = materialise(rules.select("items", share.alias("confidence"), (F.col("blocked") / max(1, n)).alias("support")))
    return rules, items.select(F.explode("members").alias("token"), "item", F.col("n").alias("rows"))


def _combined(patterns: DataFrame, needed: int) -> DataFrame:
    """(items) of two or more that FP-growth finds in needed blocked rows.

    A pattern counts needed times at most, which changes no answer and bounds the copies made of one.
    """
    times = F.least(F.col("blocked"), F.lit(needed))
    held = patterns.where("blocked > 0").select("items", times.alias("times"))
    total = held.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    if not total:
        return held.select("items").limit(0)
    parts = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / 1000)))).repartition(partitions(patterns.sparkSession))
    rows = parts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("times") - 1000 * F.col("part"))))).select("items")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (needed - 0.5) / total)).fit(rows)
    return model.freqItemsets.where(F.size("items") > 1).select(F.array_sort("items").alias("items"))


def _counted(sets: DataFrame, patterns: DataFrame, rarity: DataFrame, *key: str) -> DataFrame:
    """(*key, items, n, blocked): sets with their counts over the patterns of their key. Both meet under a set's rarest item."""
    rare = sets.select(*key, "items", F.explode("items").alias("item")).join(rarity, [*key, "item"]).groupBy(*key, "items").agg(F.min(F.struct("rows", "item"))["item"].alias("item"))
    fits = patterns.withColumn("item", F.explode("items")).withColumnRenamed("items", "has").join(rare, [*key, "item"]).where(F.size(F.array_except("items", "has")) == 0)
    return fits.groupBy(*key, "items").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))


def projected(patterns: DataFrame, asked: DataFrame, single: DataFrame, allowed: int, needed: int, good: Column) -> DataFrame:
    """(items, n, blocked) of rules of two items or more, among them every shortest one that a row of asked holds, from rows of any length.

    Items have one order in all rows. A set is reached through its last item, then
    the last but one: each row that has it leaves the items before it, as in
    FP-growth's own projections. Where those have MAX_ITEMS at most, FP-growth takes
    them, all such projections in one run, with items named by their projection.
    Before, a projection loses the items that no shortest rule needs. Those are the
    ones that with the items held so far
    - have too few blocked rows, or stand in no row of asked;
    - are a rule, as it is found then, and a longer one isn't a shortest;
    - have as many allowed rows as without the new item, or as with it alone: the
      set without what takes no allowed row away has all the blocked rows and no
      more allowed ones, so it is a rule whenever the set is.
    Each holds for all larger sets too. The rest is exact, so it can grow with the
    power of two of the items that rows have in common, where none of this applies.
    """
    let = F.col("n") - F.col("blocked")
    none = F.array().cast("array<string>")
    rows = patterns.select("items", "n", "blocked", F.lit(False).alias("asked")).unionByName(asked.select("items", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("blocked"), F.lit(True).alias("asked")))
    rows = rows.select(none.alias("held"), F.lit(allowed).cast("bigint").alias("above"), "items", "n", "blocked", "asked")
    alone = single.select("item", let.alias("alone"))
    counted = [F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.max("asked").alias("asked")]
    rules, short = [], []
    while True:
        rows = materialise(rows.groupBy("held", "above", "items").agg(*counted))
        sets = rows.withColumn("item", F.explode("items")).groupBy("held", "above", "item").agg(*counted).where((F.col("blocked") >= needed) & F.col("asked") & (let < F.col("above")))
        sets = materialise(sets.join(alone, "item").where((F.size("held") == 0) | (let < F.col("alone"))))
        rules.append(sets.where(good & (F.size("held") > 0)).select(F.array_append("held", F.col("item")).alias("items"), "n", "blocked"))
        kept = sets.where(~good).groupBy("held").agg(F.map_from_entries(F.collect_list(F.struct("item", let))).alias("kept"))
        rows = rows.join(kept, "held").withColumn("items", F.filter("items", lambda x: F.map_contains_key("kept", x))).where(F.size("items") > 1)
        rows = rows.withColumn("lets", F.transform("items", lambda x: F.col("kept")[x])).drop("kept")
        lengths = rows.where("blocked > 0").groupBy("held").agg(F.max(F.size("items")).alias("longest"))
        rows = materialise(rows.join(lengths, "held"))
        short.append(rows.where(F.col("longest") <= MAX_ITEMS).select("held", "items", "n", "blocked"))
        rows = rows.where(F.col("longest") > MAX_ITEMS)
        if rows.isEmpty():
            break
        rows = rows.select("*", F.posexplode("items").alias("at", "item")).where("at > 0")
        rows = rows.select(F.array_append("held", F.col("item")).alias("held"), F.col("lets")[F.col("at")].alias("above"), F.slice("items", 1, F.col("at")).alias("items"), "n", "blocked", "asked")
    short = reduce(DataFrame.unionByName, short)
    # each projection's items have a name of their own, so that one run mines all
    names = materialise(short.select("held").distinct().withColumn("name", F.monotonically_increasing_id().cast("string")))
    short = materialise(short.where("n > 0").join(names, "held").select("name", "items", "n", "blocked"))
    named = short.select(F.transform("items", lambda x: F.concat("name", F.lit(":"), x)).alias("items"), "blocked")
    own = F.expr("transform(items, x -> substring(x, instr(x, ':') + 1))")
    found = materialise(_combined(named, needed).select(F.substring_index(F.col("items")[0], ":", 1).alias("name"), own.alias("items")))
    rarity = short.withColumn("item", F.explode("items")).groupBy("name", "item").agg(F.sum("n").alias("rows"))
    rules.append(_counted(found, short, rarity, "name").where(good).join(names, "name").select(F.concat("held", "items").alias("items"), "n", "blocked"))
    return reduce(DataFrame.unionByName, rules).withColumn("items", F.array_sort("items"))


def inverted_index(rules: DataFrame, lookup: DataFrame) -> DataFrame:
    """(item, postings): each rule stands under that of its items that fewest labelled rows have."""
    rows = lookup.select("item", "rows").distinct()
    each = rules.select("items", "confidence", "support", F.explode("items").alias("item")).join(rows, "item")
    rare = each.groupBy("items", "confidence", "support").agg(F.min(F.struct("rows", "item"))["item"].alias("item"))
    return rare.groupBy("item").agg(F.collect_list(F.struct("confidence", "support", "items")).alias("postings"))


def judge(df: DataFrame, rules: list[PathRule], min_support: float = 0.01, min_confidence: float = 0.8, min_rows: int = 10, min_z: float = 3.0, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, mined array<string>, confidence) of each row.

    rule and verdict come from the longest fitting path rule. Without one, the
    verdict is block where a mined rule matches (mined: tokens of the URL that make
    it up; the most confident rule, then the best supported, then the first in
    order), else allow. A null URL or one without '://' has an empty host and path
    and is allowed. Repeated rows and null ids are judged like any other, and URLs
    may be of any length. Other columns are ignored. Without labelled rows nothing
    is mined; an empty table gives no rows.

    Mined rules are matched once for each distinct URL and joined back by URL, so
    a URL with very many rows is a skewed side of one join, which Spark splits.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    own = own.withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "listed": verdict})
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))

    # written once: mining passes over it several times
    labelled = materialise(own.where(F.col("listed").isNotNull()).select(F.monotonically_increasing_id().alias("row"), tokens.alias("tokens"), F.col("listed").alias("verdict")))
    open_urls = own.where(F.col("listed").isNull() & (F.col("host") != ""))
    distinct = open_urls.select("url", "host", "path").distinct().select("url", F.explode(tokens).alias("token"))
    found, lookup = mine(labelled, distinct, min_support, min_confidence, min_rows, min_z)
    index = inverted_index(found, lookup)

    used = lookup.join(found.select(F.explode("items").alias("item")).distinct(), "item", "left_semi").select("token", "item")
    held = distinct.join(used, "token").groupBy("url", "item").agg(F.min("token").alias("token"))
    held = held.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("item", "token"))).alias("held"))
    hits = held.select("url", "held", F.explode(F.map_keys("held")).alias("item")).join(index, "item")
    hits = hits.withColumn("posting", F.explode("postings")).where(F.size(F.array_except("posting.items", F.map_keys("held"))) == 0)
    best = hits.groupBy("url").agg(F.max(F.struct("posting.confidence", "posting.support", "posting.items", F.transform("posting.items", lambda i: F.col("held")[i]).alias("tokens"))).alias("best"))

    columns = [F.col("id").alias(id_col), "host", "path", "rule"]
    decided = own.where(F.col("listed").isNotNull() | (F.col("host") == "")).select(*columns, F.coalesce("listed", F.lit("allow")).alias("verdict"), F.lit(None).cast("array<string>").alias("mined"), F.lit(None).cast("double").alias("confidence"))
    rest = open_urls.join(best, "url", "left").select(*columns, F.when(F.col("best").isNotNull(), "block").otherwise("allow").alias("verdict"), F.col("best.tokens").alias("mined"), F.col("best.confidence").alias("confidence"))
    return decided.unionByName(rest)
