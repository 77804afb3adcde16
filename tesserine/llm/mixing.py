"""Mixing of sources to target weights by temperature.

Source token shares p are raised to an exponent a and normalised: w = p**a / sum(p**a). Bisection finds a so that
either the weights' entropy is the target, or no source is repeated more than a limit of times as often as another.
The weights are realised as epochs over each source: whole epochs take every document, the last one is budgeted. In
each epoch a source's documents are dealt to blocks and the blocks permuted by a seeded hash; blocks are taken in
that order until the budget is met, and within the one block where it runs out, documents in hash order.

Shares, exponent and budgets are found by aggregates over the table of sources, which stays distributed; what is joined with the
documents is a row for each source and for each of its blocks. Texts are never shuffled while those tables are small
(`SMALL` rows, counted), nor are a source's documents brought together.

Token counts are words `[^\\x20\\x09-\\x0D]+`. By default the budget is the least that leaves no document out:
the most generous source, by its own size, is taken exactly once.

Edges: null sources are a source of their own; null and empty texts count no tokens and are taken in every whole
epoch; a source without tokens is taken once; repeated rows (doc_id and text) are taken or left together; an empty table
gives an empty result; extra columns are kept, but for those named as the operator's own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_rows, stash, unstash, with_own

#: No source is repeated more often than this, relative to the least repeated one.
REPEATS = 2.0
SEED = 17
#: Rows of a source in one block, about.
BLOCK = 512
#: Blocks of a source at most; larger sources have larger blocks, so that the table of blocks stays small.
BLOCKS = 4096
#: Rows of a table of sources or blocks up to which it is broadcast; beyond, documents are shuffled to it.
SMALL = 200_000
#: Exponents tried at once in the search for an entropy, and the number of searches.
TRIED, SEARCHES = 64, 5


@dataclass(frozen=True)
class Mix:
    exponent: float
    weights: dict[str, float]
    epochs: dict[str, float]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: list[float], exponent: float) -> list[float]:
    top = max(shares)
    raw = [(p / top) ** exponent if p > 0 else 0.0 for p in shares]
    total = sum(raw)
    return [x / total for x in raw]


def bisect(good, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The least exponent in [low, high] for which good holds; good is false below it and true above."""
    if good(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def solve(tokens: dict[str, int], repeats: float | None = REPEATS, target_entropy: float | None = None, budget: float | None = None) -> Mix:
    """Exponent, weights and epochs for sources' token counts; target_entropy (nats) has precedence over repeats."""
    named = sorted(k for k, n in tokens.items() if n > 0)
    if not named:
        return Mix(1.0, {}, dict.fromkeys(tokens, 1.0))
    total = sum(tokens[k] for k in named)
    shares = [tokens[k] / total for k in named]

    def ratio(a: float) -> float:
        rates = [w / p for w, p in zip(tempered(shares, a), shares, strict=True)]
        return max(rates) / min(rates)

    if target_entropy is not None:
        exponent = bisect(lambda a: entropy(tempered(shares, a)) <= target_entropy)
    elif repeats is not None:
        exponent = bisect(lambda a: ratio(a) <= repeats)
    else:
        exponent = 1.0
    weights = dict(zip(named, tempered(shares, exponent), strict=True))
    spend = budget if budget is not None else max(tokens[k] / weights[k] for k in named)
    return Mix(exponent, weights, {k: round(weights[k] * spend / tokens[k], 9) if k in weights else 1.0 for k in tokens})


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _exponent(totals: DataFrame, repeats: float | None, target_entropy: float | None, most: float, least: float) -> float:
    """As in `solve`, over a table of sources with their tokens; most and least are those of the sources that have any."""
    if target_entropy is None:
        if repeats is None or most == least:
            return 1.0 if repeats is None else 0.0
        # w / p goes with p ** (a - 1), so the extreme sources decide.
        return bisect(lambda a: (most / least) ** (1 - a) <= repeats)
    low, high = 0.0, 1.0
    share = F.log(F.col("tokens") / F.lit(most))
    for search in range(SEARCHES):
        tried = [low + (high - low) * i / TRIED for i in range(0 if search == 0 else 1, TRIED + 1)]
        sums = totals.where("tokens > 0").agg(*(f(F.exp(share * a) * x).alias(f"{n}{i}") for i, a in enumerate(tried) for n, f, x in (("z", F.sum, F.lit(1.0)), ("s", F.sum, share)))).head()
        good = [i for i, a in enumerate(tried) if math.log(sums[f"z{i}"]) - a * sums[f"s{i}"] / sums[f"z{i}"] <= target_entropy]
        if not good:
            return 1.0
        at = tried[good[0]]
        if at == 0.0:
            return 0.0
        low, high = at - (high - low) / TRIED, at
    return high


def _small(df: DataFrame) -> DataFrame:
    """The table with a hint to broadcast it if it is small, else to merge with it."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df.hint("merge")


def taken_rows(docs: DataFrame, repeats: float | None = REPEATS, target_entropy: float | None = None, budget: float | None = None, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """docs as `row` (see `as_rows`) with n_tokens, epoch (from 0) and place, a row for each time that a document is taken.

    place orders the rows of a source's epoch: its blocks in permuted order, in each the documents.
    """
    sized = as_rows(docs).select("row", _source_key(F.col("row.source")).alias("_key"), token_count(F.col("row.text")).alias("n_tokens"), F.xxhash64("row.doc_id", "row.text").alias("_id"))
    light = stash(sized.select("_key", "n_tokens", "_id"), "sizes")
    totals = stash(light.groupBy("_key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "totals")
    some = totals.where("tokens > 0").agg(F.max("tokens").alias("most"), F.min("tokens").alias("least")).head()
    tokens, epochs = F.col("tokens").cast("double"), F.lit(1.0)
    if some["most"] is not None:
        a = _exponent(totals, repeats, target_entropy, float(some["most"]), float(some["least"]))
        raw = F.pow(tokens / F.lit(float(some["most"])), F.lit(a))
        z = totals.where("tokens > 0").agg(F.sum(raw).alias("z"), F.max(tokens / raw).alias("x")).head()
        spend = float(budget) if budget is not None else z["x"] * z["z"]
        epochs = F.when(F.col("tokens") > 0, F.round(raw / F.lit(z["z"]) * F.lit(spend) / tokens, 9)).otherwise(1.0)
    number = F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("rows") / block))).cast("int")
    plan = stash(totals.select("_key", F.floor(epochs).cast("int").alias("_whole"), ((epochs - F.floor(epochs)) * tokens).alias("_rest"), number.alias("_blocks")), "plan")
    sources = _small(plan)
    rank = F.xxhash64("_id", F.lit(seed))
    dealt = F.pmod(rank, F.col("_blocks")).cast("int")
    # The order of a source's blocks in its last, budgeted epoch, and where the budget runs out.
    sums = light.join(sources, "_key").where("_rest > 0").groupBy("_key", "_rest", "_whole", dealt.alias("_block")).agg(F.sum("n_tokens").alias("n"))
    order = F.xxhash64("_block", "_whole", F.lit(seed + 1))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_key").orderBy(order, "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.withColumn("before", before).where("before < _rest").select("_key", "_block", (F.col("_rest") - F.col("before")).alias("_room"), (F.col("before") + F.col("n") > F.col("_rest")).alias("_last"))
    blocks = stash(blocks, "blocks")
    last = _small(blocks.where("_last").select("_key", "_block", "_room"))  # one block of a source
    in_last = light.join(sources, "_key").select("_key", dealt.alias("_block"), "_id", rank.alias("_rank"), "n_tokens").join(last, ["_key", "_block"])
    each = in_last.groupBy("_key", "_block", "_room", "_rank", "_id").agg(F.sum("n_tokens").alias("n"))
    so_far = F.coalesce(F.sum("n").over(Window.partitionBy("_key", "_block").orderBy("_rank", "_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = each.withColumn("so_far", so_far).where(F.col("so_far") < F.col("_room")).groupBy("_key", "_block").agg(F.max(F.struct("_rank", "_id")).alias("_edge"))
    limits = stash(blocks.select("_key", "_block").join(edge, ["_key", "_block"], "left"), "limits")
    full = sized.join(sources, "_key").withColumn("_rank", rank).withColumn("_block", dealt)
    full = full.join(_small(limits.withColumn("_taken", F.lit(True))), ["_key", "_block"], "left")
    extra = F.coalesce(F.col("_taken"), F.lit(False)) & (F.col("_edge").isNull() | (F.struct("_rank", "_id") <= F.col("_edge")))
    times = F.col("_whole") + F.when(extra, 1).otherwise(0)
    rows = full.withColumn("_times", times).where("_times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    # The block's hash above, the document's below.
    place = F.xxhash64("_block", "epoch", F.lit(seed + 1)).bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(F.xxhash64("_id", "epoch", F.lit(seed + 2)).bitwiseAND(F.lit((1 << 32) - 1)))
    unstash(light, totals, blocks)  # plan and limits are read by the result
    return rows.select("row", "n_tokens", "epoch", place.alias("place"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with n_tokens, epoch and place, in place of columns of these names; see `taken_rows`."""
    return with_own(taken_rows(docs, **options), "n_tokens", "epoch", "place")
