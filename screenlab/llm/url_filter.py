"""URL filter: rules first, then a ratio of two character language models.

Variable-order Markov models of accepted and of rejected URLs are counted over
all URLs that a rule decides.  A URL's score is the difference of its log
likelihoods under both, divided by its length; a logistic curve fitted on a
held-out third of the decided URLs turns it into a probability.  The models are
tables that grow with the URLs, and no n-gram is left out.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlab.llm.common import fold, shared_folder, written

#: Letters of the longest n-gram, and how many letters there are (fixed values).
ORDER, ALPHABET = 6, 48
#: What has a 2**-BITS share of all windows or rows is looked up in each task, not joined: at most 2**BITS.
BITS = 15


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(str(r)), str(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _letters(host: Column, path: Column) -> Column:
    """The text that is modelled, between marks; letters outside a small alphabet are one."""
    text = F.regexp_replace(F.lower(F.concat(host, path)), r"[^a-z0-9./_%=~+-]", "*")
    return F.concat(F.lit("^"), text, F.lit("$"))


def ngrams(texts: DataFrame) -> DataFrame:
    """(gram, size, n_allow, n_block, windows) of every n-gram in distinct (letters, allow, block).

    n_allow and n_block count it in texts weighted by allow and block; windows
    is how often it is what a letter is judged by, counting each text once.
    """
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(ORDER), F.length("letters")))).alias("size")
    grams = texts.select("letters", "allow", "block", sizes)
    cut = "transform(sequence(1, length(letters) - size + 1), i -> substring(letters, i, size))"
    grams = grams.select("size", "allow", "block", F.posexplode(F.expr(cut)).alias("at", "gram"))
    judged = (F.col("size") == ORDER) | ((F.col("at") == 0) & (F.col("size") > 1))
    return grams.groupBy("gram", "size").agg(
        F.sum("allow").alias("n_allow"), F.sum("block").alias("n_block"), F.sum(judged.cast("long")).alias("windows")
    )


def gram_ratios(texts: DataFrame, folder: str) -> DataFrame:
    """(gram, windows, d) of every n-gram that judges a letter; d is the difference of its log probabilities.

    Both models interpolate all orders as `MarkovModel` does, with no n-gram left
    out. A context has at most as many n-grams, and an n-gram at most as many
    longer by one letter in front, as there are letters, so no join has a hot key.
    """
    head = Window.partitionBy("_head", "size")
    grams = ngrams(texts).withColumn("_head", F.expr("left(gram, size - 1)"))
    for kind in ("allow", "block"):
        seen = (F.col(f"n_{kind}") > 0).cast("long")
        grams = grams.withColumns(
            {f"after_{kind}": F.sum(f"n_{kind}").over(head), f"kinds_{kind}": F.sum(seen).over(head)}
        )
    grams = written(grams.drop("_head"), folder, "grams")
    out, shorter = None, None
    for size in range(1, ORDER + 1):
        level = grams.filter(F.col("size") == size)
        if shorter is None:
            level = level.withColumns({f"lower_{k}": F.lit(1 / ALPHABET) for k in ("allow", "block")})
        else:
            level = level.withColumn("_tail", F.expr("substring(gram, 2)")).join(shorter, "_tail")
        chance = {}
        for k in ("allow", "block"):
            kinds, after, lower = F.col(f"kinds_{k}"), F.col(f"after_{k}"), F.col(f"lower_{k}")
            both = (F.col(f"n_{k}") + kinds * lower) / (after + kinds)
            chance[f"p_{k}"] = F.when(after > 0, both).otherwise(lower)
        level = level.withColumns(chance).select("gram", "windows", "p_allow", "p_block")
        level = written(level, folder, f"chances{size}")
        shorter = level.selectExpr("gram AS _tail", "p_allow AS lower_allow", "p_block AS lower_block")
        out = level if out is None else out.unionByName(level)
    return out.filter("windows > 0").select("gram", "windows", (F.log("p_allow") - F.log("p_block")).alias("d"))


class MarkovModel:
    """Witten-Bell interpolation of all orders, as log probabilities and back-off weights.

    The plain form for counts in memory; `gram_ratios` is the same on tables.
    """

    def __init__(self, counts: dict[str, int], alphabet: int = ALPHABET) -> None:
        after, kinds = defaultdict(int), defaultdict(int)
        for gram, n in counts.items():
            after[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        self.log: dict[str, float] = {}
        self.back: dict[str, float] = {}
        self.unseen = -math.log(alphabet)
        for gram in sorted(counts, key=len):
            head = gram[:-1]
            lower = math.exp(self.of(gram[1:])) if len(gram) > 1 else 1 / alphabet
            self.log[gram] = math.log((counts[gram] + kinds[head] * lower) / (after[head] + kinds[head]))
            self.back.setdefault(head, math.log(kinds[head] / (after[head] + kinds[head])))

    def of(self, gram: str) -> float:
        """Log probability of the last letter after the others, from the longest known part."""
        weight = 0.0
        while gram:
            known = self.log.get(gram)
            if known is not None:
                return weight + known
            weight += self.back.get(gram[:-1], 0.0)
            gram = gram[1:]
        return weight + self.unseen

    def likelihood(self, letters: str) -> float:
        return sum(self.of(letters[max(0, k - ORDER + 1) : k + 1]) for k in range(1, len(letters)))


def _looked_up(hot, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: id, letters. The sum of the frequent windows' ratios, and the other windows."""
    table = hot.value
    for batch in batches:
        known, rest = [], []
        for letters in batch.column(1).to_pylist():
            windows = [letters[max(0, k - ORDER + 1) : k + 1] for k in range(1, len(letters))]
            known.append(sum(table[w] for w in windows if w in table))
            rest.append([w for w in windows if w not in table])
        columns = [batch.column(0), pa.array(known, pa.float64()), pa.array(rest, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "known", "rest"])


def ratios(texts: DataFrame, folder: str) -> DataFrame:
    """Distinct texts (id, letters, allow, block, ...) with ratio added.

    Frequent windows go to every task, at most 2**BITS of them whatever the
    corpus; each other one is joined, so its key has no more than a 2**-BITS
    share of the rows. Sums are taken in a fixed order.
    """
    found = written(gram_ratios(texts, folder), folder, "ratios")
    total = found.agg(F.sum("windows")).first()[0] or 0
    frequent = F.col("windows") * 2**BITS >= total
    hot = {r["gram"]: r["d"] for r in found.filter(frequent).select("gram", "d").toLocalIterator()}
    sent = texts.sparkSession.sparkContext.broadcast(hot)
    kind = "id long, known double, rest array<string>"
    looked = texts.select("id", "letters").mapInArrow(functools.partial(_looked_up, sent), kind)
    looked = written(looked, folder, "looked")
    rest = looked.select("id", F.explode("rest").alias("gram")).join(found.filter(~frequent).drop("windows"), "gram")
    rest = rest.groupBy("id").agg(F.array_sort(F.collect_list("d")).alias("_rest"))
    out = texts.join(looked.select("id", "known"), "id").join(rest, "id", "left")
    both = F.aggregate(F.coalesce("_rest", F.array().cast("array<double>")), F.col("known"), lambda a, d: a + d)
    size = F.length("letters")
    ratio = F.when(size > 2, both / (size - 1)).otherwise(0.0)
    return out.withColumn("ratio", ratio).drop("known", "_rest")


def logistic_curve(score: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of a logistic curve by Newton steps with a weak prior of slope 1."""
    a = np.array([1.0, 0.0])
    x = np.c_[score, np.ones(len(score))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (weight * (good - p)) - 0.01 * (a - [1, 0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(h, g)
        a += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), float(a[1])


def judge_urls(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(row, host, path, rule, verdict, ratio, probability) per row of `pages`.

    Where a rule fits, the longest one's verdict holds; elsewhere a URL whose
    probability of being accepted is one half or more is allowed. A null URL, or
    one without ://, has an empty host and path, fits no rule and has ratio 0.
    Without decided URLs both models are uniform and all ratios 0. Repeated rows
    are judged alike; the row stays in its struct, so no column name can clash.

    All n-grams of the decided URLs outside the held-out third are counted and
    kept, as tables in the shared folder. Each distinct text is scored once by
    joins to them; rows of frequent texts get their score from a broadcast of at
    most 2**BITS, others by a join. The curve is fitted on the held-out third,
    whose ratios reach the driver as counts of 800 bins.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    df = pages.select(row.alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    df = df.select("row", "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    df = df.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    held = F.coalesce(fold(F.col("id")) == 1, F.lit(False))
    df = df.withColumns({"letters": _letters(F.col("host"), F.col("path")), "held": held})
    folder = shared_folder(pages.sparkSession)
    kinds = {}
    for kind in ("allow", "block"):
        decided = F.coalesce(F.col("rule.verdict") == kind, F.lit(False))
        kinds[kind], kinds[f"held_{kind}"] = decided & ~F.col("held"), decided & F.col("held")
    sums = [F.sum(x.cast("long")).alias(name) for name, x in kinds.items()]
    texts = df.groupBy("letters").agg(F.count("*").alias("n"), *sums)
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), folder, "texts")
    scores = written(ratios(texts, folder), folder, "scores")

    bins = F.round(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), "ratio")), 2)
    each = F.explode(F.expr("array(struct('allow' AS kind, held_allow AS n), struct('block' AS kind, held_block AS n))"))
    seen = scores.select(bins.alias("bin"), each.alias("k")).filter("k.n > 0")
    seen = seen.groupBy("k.kind", "bin").agg(F.sum("k.n").alias("count")).orderBy("kind", "bin").collect()
    slope, offset = logistic_curve(
        np.array([r["bin"] for r in seen], float),
        np.array([r["kind"] == "allow" for r in seen], float),
        np.array([r["count"] for r in seen], float),
    )
    rows = scores.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * 2**BITS >= rows
    hot = F.broadcast(scores.filter(frequent).select("letters", F.col("ratio").alias("_hot")))
    cold = scores.filter(~frequent).select("letters", F.lit(0).cast("long").alias("_deal"), "ratio")
    df = df.drop("held", "id").join(hot, "letters", "left")
    # Rows that have their ratio are dealt to all tasks and meet nothing.
    deal = F.when(F.col("_hot").isNull(), 0).otherwise(F.monotonically_increasing_id() + 1)
    df = df.withColumn("_deal", deal).join(cold, ["letters", "_deal"], "left")
    df = df.withColumn("ratio", F.coalesce("_hot", "ratio"))
    chance = 1 / (1 + F.exp(-(F.col("ratio") * slope + offset)))
    out = df.withColumn("probability", chance)
    own = F.when(F.col("probability") >= 0.5, "allow").otherwise("block")
    return out.select(
        "row", "host", "path", F.col("rule.rule").alias("rule"),
        F.coalesce("rule.verdict", own).alias("verdict"), "ratio", "probability",
    )
