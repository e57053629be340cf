"""Mixtures of sources with target shares of all tokens, by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.bpe import count_tokens
from driftline.runtime import written

GRID = 24


def poisson_steps(rate: float, cap: int) -> list[float]:
    """P(X <= k) for k < cap: the number of these at or below a uniform value is the capped Poisson count."""
    if math.isinf(rate):
        return [0.0] * cap
    term, total, steps = math.exp(-rate), 0.0, []
    for k in range(cap):
        total += term
        steps.append(total)
        term *= rate / (k + 1)
    return steps


def capped_mean(rate: float, cap: int) -> float:
    return sum(1 - s for s in poisson_steps(rate, cap))


def rate_of_mean(mean: float, cap: int) -> float:
    """The Poisson rate at which the count capped at ``cap`` has the given mean."""
    if mean <= 0:
        return 0.0
    if mean >= cap:
        return math.inf
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < mean and high < 600:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < mean else (low, mid)
    return high


def uniform(*columns: Column | str, seed: int) -> Column:
    """A value in [0, 1) that depends on the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / F.lit(float(1 << 53))


def _copies(u: Column, steps: Column) -> Column:
    return F.size(F.filter(steps, lambda s: s <= u))


def _targets(targets: DataFrame) -> list:
    """The table of targets: one row per source, a bound set by whoever mixes them."""
    rows = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()
    return sorted((r.source, float(r.share), 1 if r.cap is None else max(0, int(r.cap))) for r in rows)


def plan(sized: DataFrame, targets: DataFrame, seed: int, total_tokens: int | None = None) -> list[dict]:
    """Per source the Poisson rate that gives it its target share of the tokens, and what it comes to.

    The size of the mixture is ``total_tokens``, by default that of the corpus, lowered where a source could not
    reach its share with ``max_repeats`` copies of all its documents: shares come first. Shares of sources without
    tokens go to the others in proportion. The rate whose mean is the wanted repetition is then adjusted to the
    draws themselves: in two passes, each over a grid of rates for all sources at once, tokens are summed as they
    would come out, and the rate nearest the target is taken.
    """
    wanted = _targets(targets)
    spark = sized.sparkSession
    named = F.broadcast(spark.createDataFrame([(s,) for s, _, _ in wanted], "source string"))  # as many rows as targets
    have = {r.source: int(r.n or 0) for r in sized.join(named, "source").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    live = [(s, share, cap) for s, share, cap in wanted if have.get(s, 0) > 0 and cap > 0]
    share_sum = sum(share for _, share, _ in live)
    corpus = total_tokens or sum(have.values())
    size = min([corpus, *(cap * have[s] * share_sum / share for s, share, cap in live)])
    goal = {s: size * share / share_sum for s, share, _ in live}
    caps = {s: cap for s, _, cap in live}
    rate = {s: rate_of_mean(min(cap, goal[s] / have[s]) if goal[s] / have[s] < cap * (1 - 1e-9) else cap, cap) for s, _, cap in live}
    reached: dict[str, float] = {s: float(caps[s] * have[s]) for s in rate if math.isinf(rate[s])}
    width = 0.5
    for _ in range(2):
        free = [s for s in rate if not math.isinf(rate[s])]
        grid = {s: [rate[s] * (1 + width * (2 * g / (GRID - 1) - 1)) for g in range(GRID)] for s in free}
        if not free:
            break
        rows = [(s, g, [poisson_steps(x, caps[s])]) for s in free for g, x in enumerate(grid[s])]
        steps = spark.createDataFrame([(s, [r[2][0] for r in rows if r[0] == s]) for s in free], "source string, steps array<array<double>>")
        drawn = sized.join(F.broadcast(steps), "source").select("source", "n_tokens", F.posexplode("steps").alias("g", "s"), uniform("doc_id", seed=seed).alias("u"))
        sums = drawn.groupBy("source", "g").agg(F.sum(F.col("n_tokens") * _copies(F.col("u"), F.col("s"))).alias("n")).collect()
        for s in free:
            n, g = min((abs((r.n or 0) - goal[s]), r.g) for r in sums if r.source == s)
            rate[s] = grid[s][g]
            reached[s] = next(float(r.n or 0) for r in sums if r.source == s and r.g == g)
        width /= GRID / 2
    total = sum(reached.values()) or 1.0
    return [
        {"source": s, "target_share": share, "max_repeats": cap, "tokens_available": have.get(s, 0), "tokens_used": int(reached.get(s, 0)), "rate": rate.get(s, 0.0), "actual_share": reached.get(s, 0.0) / total}
        for s, share, cap in wanted
    ]


def mixture(df: DataFrame, key: str, source: str, text: str, targets: DataFrame, vocabulary_path: str | None = None, seed: int = 17, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A mixture in which each source has its target share of all tokens, and the shares reached.

    The mixture has ``doc_id, source, copy_no, text``: each document as often as its capped Poisson count, which
    inverts the distribution at a value hashed from its key, in a global order hashed from (key, copy), so it is
    the same however the data are partitioned. No document comes more than ``max_repeats`` times. A source that
    holds most rows is no hot key: nothing is grouped by source but partial sums.

    The cap holds for each row of ``df``; rows that share a key are documents of their own with one draw. A null cap
    means no repetition, a cap of 0 or less leaves the source out, its share going to the others.

    The shares have one row per source of ``targets``. Documents of null or unnamed sources are not part of a
    mixture; null and empty texts have no tokens but count as documents. Null keys share one draw. An empty corpus
    gives an empty mixture and shares of 0.
    """
    spark = df.sparkSession
    named = df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    sized = written(count_tokens(named, ["doc_id", "source"], "text", vocabulary_path), "sized").df
    rows = plan(sized, targets, seed, total_tokens)
    shares = spark.createDataFrame(
        [(r["source"], r["target_share"], r["max_repeats"], r["tokens_available"], r["tokens_used"], r["tokens_used"] / max(1, r["tokens_available"]), r["actual_share"]) for r in rows],
        "source string, target_share double, max_repeats int, tokens_available long, tokens_used long, repetition double, actual_share double",
    )
    steps = spark.createDataFrame([(r["source"], poisson_steps(r["rate"], r["max_repeats"])) for r in rows if r["tokens_available"] and r["max_repeats"]], "source string, steps array<double>")
    drawn = named.join(F.broadcast(steps), "source")  # as many rows as targets
    copies = drawn.withColumn("copies", _copies(uniform("doc_id", seed=seed), F.col("steps"))).where("copies > 0")
    out = copies.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "text")
    order = F.xxhash64("doc_id", "copy_no", F.lit(seed + 1))
    return out.orderBy(order, "doc_id", "copy_no"), shares
