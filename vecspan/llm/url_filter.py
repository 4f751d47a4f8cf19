"""URL filters: longest rule first, else a ratio of character language models. DataFrame functions only.

Method: two smoothed variable-order Markov models over a 32-symbol alphabet, one of the addresses that the rules accept, one
of those they reject. A context is as long as its count allows: up to DEPTH symbols, while at least least_count labelled
characters follow it. None of them is left out, however many there are, unless a caller asks for a smaller model (max_contexts: the
most frequent stay, a shorter one always before a longer one that ends in it). Probabilities are interpolated with those of the context without its first symbol (Witten and Bell), down to
order 0. The contexts are the states of an automaton: from a context and a symbol it goes to the longest context that
ends the two. An address scores the mean over its characters of log P(accepted) - log P(rejected), one step of the automaton each.
A model of more than AUTOMATON contexts stays a table: the longest context of each distinct run of DEPTH + 1 symbols is found by
a join, and an address adds up the same numbers in the same order.

Calibration, on a held-out fifth of the labelled addresses: at most error (0.05) of the accepted ones score below the one bound and
at most error of the rejected ones at or above the other, both in thousandths; the cut is the middle between the two, and
addresses below it are blocked. Where the classes are apart by these bounds, both error rates stay below error. Counts use
every other labelled row; the model is one row of at most AUTOMATON x 32 cells, or a table on the executors.

Edge cases: a null url or one without "://" has empty host and path, fits no rule, scores 0; without labelled
addresses of both classes every score is 0; with held-out addresses of one class alone its bound is the cut, without any it is 0; a score at the cut is allowed; texts of any length are
taken whole; repeated rows are judged (and counted) each time; other columns pass through, but for those named like an output, in
any case of letters; empty tables give empty results. A rule fits only a path that starts with the rule's path, so an empty path
fits none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspan.llm.common import Stash, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols 1..30; 31 is any other character, 0 the boundary. Digits count as one symbol.
SYMBOLS = LOWER + "0/.-"
SIZE, DEPTH = 32, 5
#: Contexts up to which a model is one row that every task holds.
AUTOMATON = 4096
#: Characters that stand for the symbols 1 .. 31, in the order of their codes.
CODED = "".join(chr(64 + k) for k in range(1, SIZE))


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def address(url: Column) -> tuple[Column, Column]:
    """Host and path of an url column, never null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules: tuple[Rule, ...], what) -> Column:
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest ends outermost
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(what(r))).otherwise(out)
    return out


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def codes(text: Column) -> Column:
    """Symbols of a text, one for each character, and the boundary."""
    folded = F.translate(F.lower(text), "123456789", "000000000")
    folded = F.regexp_replace(folded, "(?s)[^a-z0/.\\-]", "~")
    chars = F.filter(F.split(F.translate(folded, SYMBOLS + "~", CODED), "", -1), lambda c: c != "")
    return F.concat(F.transform(chars, lambda c: F.ascii(c) - 64), F.array(F.lit(0)))


def keys(text: Column) -> Column:
    """For each symbol of a text, the DEPTH symbols before it (boundaries before the first) and itself as one number."""

    def of(code: Column) -> Column:
        def one(i: Column) -> Column:
            key = F.get(code, i)
            for back in range(1, DEPTH + 1):
                key = key + F.coalesce(F.when(i >= back, F.get(code, i - back)), F.lit(0)) * SIZE**back
            return key

        return F.transform(F.sequence(F.lit(0), F.size(code) - 1), one)

    return let(codes(text), of)


def contexts(counts: DataFrame, least_count: int, most: int | None = None) -> DataFrame:
    """k, ctx: the kept contexts, all that are frequent enough or the most frequent of these. counts: accepted, key, n."""
    orders = F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))
    every = counts.select(orders.alias("k"), "key", "n").withColumn("ctx", _suffix(F.floor(F.col("key") / SIZE), F.col("k")))
    kept = every.groupBy("k", "ctx").agg(F.sum("n").alias("n")).where((F.col("n") >= least_count) | (F.col("k") == 0))
    return (kept if most is None else kept.orderBy(F.desc("n"), "k", "ctx").limit(most)).select("k", "ctx")


def _suffix(number: Column, length: Column) -> Column:
    """The last length symbols of a number."""
    power = F.element_at(F.array(*[F.lit(SIZE**k) for k in range(DEPTH + 2)]), length + 1)
    return (number % power).cast("long")


def fit(counts: DataFrame, kept: DataFrame, stash: Stash) -> DataFrame:
    """k, ctx, ratio (by symbol) of the kept contexts."""
    classes = counts.agg(F.count_distinct("accepted")).first()[0]
    seen = (
        counts.select("accepted", "key", "n", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("k"))
        .select("accepted", "k", _suffix(F.floor(F.col("key") / SIZE), F.col("k")).alias("ctx"), (F.col("key") % SIZE).alias("symbol"), "n")
        .groupBy("accepted", "k", "ctx", "symbol").agg(F.sum("n").alias("n"))
        .groupBy("accepted", "k", "ctx").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("seen"))
    )
    zeros = F.map_from_arrays(F.array().cast("array<long>"), F.array().cast("array<long>"))
    both = kept.withColumn("accepted", F.explode(F.array(F.lit(True), F.lit(False))))
    rows = both.join(seen, ["accepted", "k", "ctx"], "left").withColumn("seen", F.coalesce("seen", zeros))
    own = F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda s: F.coalesce(F.try_element_at("seen", s.cast("long")), F.lit(0)).cast("double"))
    rows = rows.select("accepted", "k", "ctx", own.alias("n"), F.aggregate(own, F.lit(0.0), lambda a, x: a + x).alias("all"), F.size("seen").alias("kinds"))
    rows = stash.cut(rows, "counted")
    level = rows.where("k = 0").select("accepted", "k", "ctx", F.transform("n", lambda x: (x + 1.0) / (F.col("all") + SIZE)).alias("p"))
    out = level
    for k in range(1, DEPTH + 1):
        parent = level.select("accepted", F.col("ctx").alias("rest"), F.col("p").alias("q"))
        mine = rows.where(F.col("k") == k).withColumn("rest", _suffix(F.col("ctx"), F.lit(k - 1)))
        mixed = F.zip_with("n", "q", lambda x, q: F.when(F.col("all") > 0, (x + F.col("kinds") * q) / (F.col("all") + F.col("kinds"))).otherwise(q))
        level = stash.cut(mine.join(parent, ["accepted", "rest"]).select("accepted", "k", "ctx", mixed.alias("p")), f"order{k}")
        out = out.unionByName(level)
    sides = out.groupBy("k", "ctx").agg(F.max(F.when(F.col("accepted"), F.col("p"))).alias("a"), F.max(F.when(~F.col("accepted"), F.col("p"))).alias("r"))
    ratio = F.zip_with("a", "r", lambda a, r: F.log(a) - F.log(r)) if classes == 2 else F.transform("a", lambda a: F.lit(0.0))
    return sides.select("k", "ctx", ratio.alias("ratio"))


def automaton(fitted: DataFrame, stash: Stash) -> DataFrame:
    """One row, one struct column model: start (a state), next and ratio by state * SIZE + symbol. States are the contexts,
    numbered by length and then number; state 0 is the empty one."""
    spark = fitted.sparkSession
    states = stash.cut(fitted.select((F.row_number().over(W.partitionBy().orderBy("k", "ctx")) - 1).alias("state"), "k", "ctx", "ratio"), "states")  # at most AUTOMATON rows
    ratios = states.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("state", F.col("ratio").alias("x")))), lambda s: s["x"])).alias("ratio"))
    moves = states.select("state", "k", "ctx", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))).alias("symbol"))
    moves = moves.select("state", "symbol", (F.col("ctx") * SIZE + F.col("symbol")).alias("text"), F.least(F.col("k") + 1, F.lit(DEPTH)).alias("length"))
    moves = moves.unionByName(spark.range(1).select(F.lit(-1).alias("state"), F.lit(0).alias("symbol"), F.lit(0).cast("long").alias("text"), F.lit(DEPTH).alias("length")))
    moves = moves.select("state", "symbol", "text", F.explode(F.sequence(F.lit(0), F.col("length"))).alias("k")).withColumn("ctx", _suffix(F.col("text"), F.col("k")))
    to = states.select(F.col("state").alias("to"), "k", "ctx")
    moves = stash.cut(moves.join(F.broadcast(to), ["k", "ctx"]).groupBy("state", "symbol").agg(F.max_by("to", "k").alias("to")), "moves")
    start = moves.where("state < 0").select(F.col("to").alias("start"))
    tables = moves.where("state >= 0").agg(F.transform(F.sort_array(F.collect_list(F.struct("state", "symbol", "to"))), lambda s: s["to"]).alias("next"))
    return tables.withColumn("ratio", ratios.scalar()).withColumn("start", start.scalar()).select(F.struct("start", "next", "ratio").alias("model"))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def scores(texts: DataFrame, fitted: DataFrame, stash: Stash) -> DataFrame:
    """name (a digest), s of every distinct text, by joins with a model of any size."""
    places = texts.select(digest(F.col("text")).alias("name"), "text").dropDuplicates(["name"]).select("name", F.posexplode(keys(F.col("text"))).alias("pos", "key"))
    places = stash.cut(places.withColumn("key", F.col("key").cast("long")), "places")
    every = places.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("k"))
    every = every.withColumn("ctx", _suffix(F.floor(F.col("key") / SIZE), F.col("k")))
    steps = every.join(fitted, ["k", "ctx"]).groupBy("key").agg(F.max_by(F.get("ratio", (F.col("key") % SIZE).cast("int")), "k").alias("x"))
    lists = places.join(steps, "key").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("x"))
    return stash.cut(lists.select("name", F.aggregate("x", F.lit(0.0), lambda a, e: a + e["x"], lambda a: a / F.size("x")).alias("s")), "scores")


def score(text: Column, model: Column) -> Column:
    """Mean log-likelihood difference of a text's symbols."""

    def walk(m: Column, code: Column) -> Column:
        first = F.struct(m["start"].cast("int").alias("state"), F.lit(0.0).alias("sum"))

        def step(a: Column, c: Column) -> Column:
            at = a["state"] * SIZE + c
            return F.struct(F.get(m["next"], at).cast("int").alias("state"), (a["sum"] + F.get(m["ratio"], at)).alias("sum"))

        return F.aggregate(code, first, step, lambda a: a["sum"] / F.size(code))

    return let(model, lambda m: let(codes(text), lambda code: walk(m, code)))


def calibrated(scores: DataFrame, error: float) -> DataFrame:
    """One row, one column cut: the middle between the highest thousandth below which at most error of the accepted scores lie
    and the lowest one from which on at most error of the rejected do. scores: accepted, s."""
    bins = scores.groupBy("accepted", F.floor(F.col("s") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    order = W.partitionBy("accepted").orderBy("bin")  # one row for each thousandth
    bins = bins.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(W.partitionBy("accepted")))
    yes = F.col("accepted") & (F.col("upto") - F.col("n") <= error * F.col("all"))
    no = ~F.col("accepted") & (F.col("all") - F.col("upto") <= error * F.col("all"))
    ends = bins.agg((F.max(F.when(yes, F.col("bin"))) / 1000.0).alias("a"), (F.min(F.when(no, F.col("bin") + 1)) / 1000.0).alias("r"))
    return ends.select(F.coalesce((F.col("a") + F.col("r")) / 2, "a", "r", F.lit(0.0)).alias("cut"))


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url", holdout: int = 5, error: float = 0.05, least_count: int = 16, max_contexts: int | None = None) -> DataFrame:
    """pages plus host, path, rule, verdict and score (null where a rule decides)."""
    stash = Stash(pages.sparkSession)
    host, path = address(F.col(f"`{url_col}`").cast("string"))
    own = "__vs_"
    base = pages.withColumn(own + "host", host).withColumn(own + "path", path)
    h, p = F.col(own + "host"), F.col(own + "path")
    base = base.withColumn(own + "rule", match(h, p, rules, lambda r: r.text)).withColumn(own + "by_rule", match(h, p, rules, lambda r: r.verdict))
    text = F.concat(h, p)
    labelled = base.where(F.col(own + "rule").isNotNull()).select((F.col(own + "by_rule") == "allow").alias("accepted"), text.alias("text"))
    held = F.pmod(F.xxhash64("text"), F.lit(holdout)) == 0
    counts = labelled.where(~held).select("accepted", F.explode(keys(F.col("text"))).alias("key")).groupBy("accepted", F.col("key").cast("long").alias("key")).agg(F.count("*").alias("n"))
    counts = stash.cut(counts, "counts")
    kept = stash.cut(contexts(counts, least_count, max_contexts), "contexts")
    fitted = stash.cut(fit(counts, kept, stash), "fitted")
    if kept.count() <= AUTOMATON:
        model = stash.cut(automaton(fitted, stash), "model")
        known = labelled.where(held).withColumn("model", model.scalar()).select("accepted", score(F.col("text"), F.col("model")).alias("s"))
        base, found = base.withColumn(own + "model", model.scalar()), score(text, F.col(own + "model"))
    else:
        unruled = base.where(F.col(own + "rule").isNull() & (text != "")).select(text.alias("text"))
        by_name = scores(labelled.where(held).select("text").union(unruled), fitted, stash)
        known = labelled.where(held).withColumn("name", digest(F.col("text"))).join(by_name, "name").select("accepted", "s")
        by_name = by_name.select(F.col("name").alias(own + "name"), F.col("s").alias(own + "found"))
        base, found = base.withColumn(own + "name", digest(text)).join(by_name, own + "name", "left"), F.col(own + "found")
    cut = stash.cut(calibrated(known, error), "cut")
    s = F.when(F.col(own + "rule").isNull(), F.when(text == "", F.lit(0.0)).otherwise(found))
    judged = base.withColumn(own + "cut", cut.scalar()).withColumn(own + "score", s)
    verdict = F.coalesce(F.col(own + "by_rule"), F.when(F.col(own + "score") >= F.col(own + "cut"), F.lit("allow")).otherwise(F.lit("block")))
    made = {"host": h, "path": p, "rule": F.col(own + "rule"), "verdict": verdict, "score": F.col(own + "score")}
    return judged.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in made], *[c.alias(n) for n, c in made.items()])


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
