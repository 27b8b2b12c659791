"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent in [0, 1] and normalised.
The exponent is bisected: the largest one whose mix reaches a target entropy,
or, if that repeats a source too often, the smallest one that keeps to the
repetition limit.  The weights become integer token quotas of a budget, and each
quota is realised as whole permutations of the source plus the front of one more.
A permutation shuffles blocks and then the documents in each block, so prefix
sums run over blocks first and no task ever holds a whole source.

Defined results: a null source counts as the empty name; null texts have no
tokens; a source without any token is passed through once; ties and repeated
doc_ids are separate documents, in an order fixed by their texts; an empty
table gives an empty table.  A document that straddles the end of the quota is
kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, word_array

DEPTH, ROUNDS = 5, 9  # bisection levels decided by one job, and jobs


@dataclass(frozen=True)
class Mix:
    """budget None: as many tokens as make the least repeated source appear whole exactly once."""

    entropy: float = 0.97  # share of the largest possible entropy
    repeats: float = 4.0
    budget: int | None = None
    block_docs: int = 512
    seed: str = "mix-1"
    #: up to so many sources the table of quotas is broadcast, beyond it is joined by key
    broadcast_sources: int = 100_000


def source_key() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def with_tokens(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_tokens", F.size(word_array(F.col("text"))).cast("long"))


def source_totals(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(source_key().alias("src")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))


def _tried(totals: DataFrame, exponents: list[float], total: int, budget: int | None) -> dict[float, tuple[float, float]]:
    """exponent -> (entropy, largest repetition), by one aggregation over the sources."""
    tries = F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a")
    share = F.col("tokens") / F.lit(float(total))
    rows = totals.select("tokens", tries).select("a", F.log(share).alias("l"), share.alias("s"))
    rows = rows.select("a", "l", "s", F.exp(F.col("a") * F.col("l")).alias("p"))
    rows = rows.groupBy("a").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.col("a") * F.col("l")).alias("e"), F.max(F.col("p") / F.col("s")).alias("hi"), F.min(F.col("p") / F.col("s")).alias("lo")).collect()  # one row per exponent tried
    return {r.a: (math.log(r.z) - r.e / r.z, r.hi / r.lo if budget is None else r.hi / r.z * (budget / total)) for r in rows}


def exponent(totals: DataFrame, mix: Mix) -> float:
    """Bisects; each job evaluates the midpoints of DEPTH levels at once (a fixed number of rows)."""
    head = totals.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    if not head.n or head.n == 1:
        return 1.0
    goal = mix.entropy * math.log(head.n)

    def bisect(ok, ends: tuple[float, float]) -> float:
        """ends: (good, bad) exponents; narrows to the last good one."""
        good, bad = ends
        tried = _tried(totals, [good, bad], head.t, mix.budget)
        if ok(tried[bad]):
            return bad
        for _ in range(ROUNDS):
            grid = [good + (bad - good) * i / 2**DEPTH for i in range(1, 2**DEPTH)]
            tried, lo, hi = _tried(totals, grid, head.t, mix.budget), 0, 2**DEPTH
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if ok(tried[grid[mid - 1]]) else (lo, mid)
            good, bad = good + (bad - good) * lo / 2**DEPTH, good + (bad - good) * hi / 2**DEPTH
        return good

    by_entropy = bisect(lambda x: x[0] >= goal, (0.0, 1.0))
    by_repeats = bisect(lambda x: x[1] <= mix.repeats, (1.0, 0.0))
    return max(by_entropy, by_repeats)


def quotas(totals: DataFrame, mix: Mix) -> DataFrame:
    """src, n_docs, tokens, weight, full (whole permutations), rest (tokens of one more)."""
    live = totals.where("tokens > 0")
    a = exponent(live, mix)
    power = F.exp(F.lit(a) * F.log(F.col("tokens") / F.col("_all")))
    sums = live.agg(F.sum("tokens").alias("_all"))
    live = live.crossJoin(F.broadcast(sums))  # one row
    z = live.agg(F.sum(power).alias("_z"), F.max(F.col("tokens") / power).alias("_least"))
    live = live.crossJoin(F.broadcast(z)).withColumn("weight", power / F.col("_z"))
    #: the source with the largest tokens/weight is the least repeated
    budget = F.lit(float(mix.budget)) if mix.budget is not None else F.col("_least") * F.col("_z")
    quota = F.greatest(F.round(F.col("weight") * budget, 3), F.lit(0.0))
    live = live.withColumn("_q", F.floor(quota).cast("long"))
    if mix.budget is None:  # rounding must not shorten a whole permutation
        live = live.withColumn("_q", F.greatest("_q", "tokens"))
    live = live.select("src", "n_docs", "tokens", "weight", F.expr("_q div tokens").alias("full"), F.expr("_q % tokens").alias("rest"))
    return live.unionByName(totals.where("tokens = 0").select("src", "n_docs", "tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("full"), F.lit(0).cast("long").alias("rest")))


def tokenised(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, n_tokens, _tie (a hash of the text) and the columns in keep."""
    carried = [c for c in keep if c not in ("doc_id", "source", "n_tokens")]
    rows = with_tokens(docs.select("doc_id", "source", "text", *[c for c in carried if c != "text"]))
    return rows.withColumn("_tie", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).select("doc_id", "source", "n_tokens", "_tie", *carried)


def mixed(docs: DataFrame, mix: Mix = Mix(), keep: tuple[str, ...] = (), slim: DataFrame | None = None) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block_rank, slot and the columns in keep.

    (source, epoch, block_rank, slot) orders the emission of each source.  slim: tokenised(docs), if at hand.
    """
    carried = [c for c in keep if c not in ("doc_id", "source", "n_tokens")]
    # of the text only its length and hash go on, unless it is to be kept: totals, blocks and quotas read these rows
    slim = cut(tokenised(docs)) if slim is None else slim
    plan = cut(quotas(cut(source_totals(slim)), mix))
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("n_docs") / float(mix.block_docs)) / F.log(F.lit(16.0)) - 1e-9)).cast("int")
    # a broadcast join leaves the rows of a hot source where they are; blocks spread them afterwards
    plan, _ = bounded_broadcast(plan.withColumn("_d", digits), mix.broadcast_sources)
    mark = F.md5(F.concat_ws("|", F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))

    def planned(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("src", source_key()).withColumn("_m", mark).join(plan, "src")
        return rows.withColumn("_block", F.substring("_m", F.lit(1), F.col("_d")))

    # blocks: (source, epoch, block) with their tokens, in the order of a hash; prefix sums run over fronts of the hash first
    blocks = planned(slim).groupBy("src", "_block").agg(F.sum("n_tokens").alias("_bt"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full")))).where("epoch < full or rest > 0")
    blocks = cut(blocks.withColumn("_o", F.md5(F.concat_ws("|", F.lit(mix.seed), "src", "epoch", "_block").cast("binary"))).withColumn("_front", F.substring("_o", 1, 2)))
    fronts = blocks.groupBy("src", "epoch", "_front").agg(F.count("*").alias("_n"), F.sum("_bt").alias("_t"))
    over = Window.partitionBy("src", "epoch").orderBy("_front")
    fronts = fronts.select("src", "epoch", "_front", (F.sum("_n").over(over) - F.col("_n")).alias("_n0"), (F.sum("_t").over(over) - F.col("_t")).alias("_t0"))
    turn = Window.partitionBy("src", "epoch", "_front").orderBy("_o", "_block")
    blocks = blocks.join(fronts, ["src", "epoch", "_front"])
    blocks = blocks.select("src", "_block", "epoch", (F.col("_n0") + F.row_number().over(turn) - 1).cast("long").alias("block_rank"), (F.col("_t0") + F.sum("_bt").over(turn) - F.col("_bt")).alias("_before"))
    inside = Window.partitionBy("src", "_block", "epoch").orderBy(F.md5(F.concat_ws("|", F.lit(mix.seed), "epoch", "_m").cast("binary")), "_m", "n_tokens", "_tie")
    out = planned(tokenised(docs, tuple(carried)) if carried else slim).join(blocks, ["src", "_block"])
    out = out.withColumns({"slot": (F.row_number().over(inside) - 1).cast("long"), "_start": F.col("_before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")})
    out = out.where("epoch < full or _start < rest")
    return out.select("doc_id", "source", "n_tokens", "epoch", "block_rank", "slot", *carried)
