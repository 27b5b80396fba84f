"""Mixing sources to target weights by temperature.

Source i with the share p_i of all tokens gets the weight p_i ** a / sum. The
exponent a (0: equal weights, 1: weights as they come, above 1: sharper) is found
by bisection: the flattest mix whose entropy is at most the target and which
repeats no small source more often than allowed. Weights grow monotonically sharper
in a, so each round tries a row of exponents in one small job over the table of
sources and keeps the interval where the answer lies. Where sources as they come
have more entropy than the target, a lies above 1: powers of two give its bracket,
and large sources are passed more often than small ones, as far as the target asks;
the repetition limit guards small sources only. A target below the entropy of the
largest sources alone (they tie) is out of reach: then a is 1.

The weights are realised for a token budget as block permutations. Within a
source rows are ordered by a hash of their id, text and epoch, a new
permutation each epoch. A source passes through whole epochs and then the front of
one more, up to the row that fills its share of the budget. That row is found by
narrowing ranges of hashes, so no source is ever sorted or gathered. The mixed
stream is cut into blocks; each source deals its passes evenly over them, so
every block has the target weights.

Tokens are words. Rows of sources without any tokens appear once, as they cost
nothing. A null source is a source of its own; rows without id take part; equal
rows (same id and text) lie next to each other in every permutation and go
together. Texts may be of any length and other columns bear any name: rows travel
whole in one column. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostloom.llm.common import settle

_STEPS, _ROUNDS = 64, 6
_BITS, _LEVELS = 12, 4


@dataclass(frozen=True)
class Mix:
    """``budget``: tokens of the mix, or None for just enough that the source repeated least is used once;
    ``entropy``: most entropy as a share of that of equal weights; ``repeats``: most passes over a small source for
    each pass over a larger one; ``block``: tokens per block."""

    budget: int | None = None
    entropy: float = 1.0
    repeats: float = 2.0
    block: int = 1 << 20
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _entropies(sources: DataFrame, tries: list[float]) -> list[float]:
    """Entropy of the weights for each exponent, in one job; ``sources`` has (source, tokens), tokens positive."""
    high = sources.agg(F.max("tokens")).first()[0]
    lw = F.col("a") * F.log(F.col("tokens") / F.lit(float(high)))
    rows = sources.select("tokens", F.posexplode(F.array(*map(F.lit, tries))).alias("i", "a")).withColumn("lw", lw)
    sums = rows.groupBy("i").agg(F.sum(F.exp("lw")).alias("z"), F.sum(F.exp("lw") * F.col("lw")).alias("zl"))
    got = {r["i"]: math.log(r["z"]) - r["zl"] / r["z"] for r in sums.collect()}  # one row per exponent tried
    return [got[i] for i in range(len(tries))]


def exponent(sources: DataFrame, how: Mix) -> float:
    """The least exponent that meets the entropy target and the repetition limit.

    ``sources`` has (source, tokens) with positive tokens. One passes over a
    source w_i / p_i times as often as a mix as it comes; the limit holds
    between the smallest source and the largest.
    """
    head = sources.agg(F.count(F.lit(1)).alias("k"), F.min("tokens").alias("low"),
                       F.max("tokens").alias("high")).first()
    if not head["k"] or head["k"] == 1:
        return 1.0
    # passes are in the ratio (p_high / p_low) ** (1 - a)
    spread = math.log(head["high"] / head["low"])
    least = max(0.0, 1 - math.log(max(how.repeats, 1.0)) / spread) if spread else 0.0
    target = how.entropy * math.log(head["k"]) * (1 + 1e-12)

    def first_within(tries: list[float]) -> int | None:
        return next((i for i, h in enumerate(_entropies(sources, tries)) if h <= target), None)

    # the bracket: least, 1, and the powers of two
    tries = [least, *(2.0 ** i for i in range(_STEPS))]
    for _ in range(_ROUNDS):
        first = first_within(tries)
        if not first:
            # the least exponent will do already, or none does
            return 1.0 if first is None else tries[0]
        low, high = tries[first - 1], tries[first]
        if high - low < 1e-12 * high:
            break
        tries = [low + (high - low) * i / _STEPS for i in range(_STEPS)] + [high]
    return high


def weights(sources: DataFrame, how: Mix) -> DataFrame:
    """(source, tokens, share, weight, passes, exponent, entropy) for sources(source, tokens).

    A source without tokens passes once. ``entropy`` is what the weights reach, as a share of that of equal ones.
    """
    full = sources.filter("tokens > 0")
    a = exponent(full, how)
    n, k, high = full.agg(F.sum("tokens"), F.count(F.lit(1)), F.max("tokens")).first()
    power = F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(float(high or 1))))
    z = full.agg(F.sum(power)).first()[0]
    reached = _entropies(full, [a])[0] / math.log(k) if k > 1 else 1.0
    weight = F.when(F.col("tokens") > 0, power / F.lit(float(z or 1)))
    out = sources.withColumn("share", F.col("tokens") / F.lit(float(n or 1))).withColumn(
        "weight", F.coalesce(weight, F.lit(0.0))).withColumn("exponent", F.lit(a)).withColumn("entropy", F.lit(reached))
    if how.budget is None:
        low = out.filter("tokens > 0").agg(F.min(F.col("weight") / F.col("tokens"))).first()[0]
        budget = 1 / low if low else 0.0
    else:
        budget = float(how.budget)
    passes = F.when(F.col("tokens") > 0, F.col("weight") * budget / F.col("tokens")).otherwise(F.lit(1.0))
    # a pass that is whole but for rounding is whole
    rounded = F.when(F.abs(passes - F.round(passes)) < 1e-9, F.round(passes)).otherwise(passes)
    return out.withColumn("passes", rounded)


def _order(epoch: Column, key: Column, how: Mix) -> Column:
    """Place of a row in the permutation of an epoch, in [0, 2^48)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(how.seed), epoch, key), 16)


def _fronts(plan: DataFrame, shares: DataFrame, how: Mix) -> DataFrame:
    """Per source the last place of its permutation that still belongs to the part epoch (``cut``, -1 for none)."""
    whole = F.floor("passes")
    quota = (F.col("passes") - whole) * F.col("tokens")
    state = shares.select("source", whole.cast("bigint").alias("whole"), quota.alias("need"),
                          F.lit(0).cast("bigint").alias("prefix")).filter("need > 0")
    for level in range(_LEVELS):
        shift = 48 - _BITS * (level + 1)
        rows = plan.join(state.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        place = F.shiftrightunsigned(_order(F.col("whole"), F.col("key"), how), shift)
        rows = rows.withColumn("_at", place).filter(F.shiftrightunsigned("_at", _BITS) == F.col("prefix"))
        # at most 4096 sums per source
        sums = rows.groupBy("source", "need", "whole", "_at").agg(F.sum("tokens").alias("t"))
        run = Window.partitionBy("source").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("t").over(run))
        state = settle(
            sums.filter("upto >= need - 1e-6").groupBy("source", "whole").agg(
                F.min_by(F.struct("_at", (F.col("need") - F.col("upto") + F.col("t")).alias("need")), "_at").alias("m"))
            .select("source", "whole", F.col("m.need").alias("need"), F.col("m._at").alias("prefix")), "fronts")
    return state.select("source", F.col("prefix").alias("cut"))


def mixed(docs: DataFrame, how: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(doc, source, key, tokens, weight, passes, exponent, entropy, whole, copies) for each row of ``docs``.

    ``doc`` holds the row's columns, or those named in ``keep``; ``copies`` says
    in how many epochs of its source the row is used.
    """
    names = docs.columns if keep is None else keep
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(source_col).alias("source"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), word_count(F.col(text_col)).alias("tokens"))
    plan = settle(keyed.select("source", "tokens", "key"), "mix-plan")
    sources = settle(plan.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    shares = settle(weights(sources, how), "mix-weights")
    fronts = _fronts(plan, shares, how)
    table = shares.join(fronts.withColumnRenamed("source", "_f"), F.col("source").eqNullSafe(F.col("_f")), "left")
    table = settle(table.select(
        F.col("source").alias("_s"), "weight", "passes", "exponent", "entropy",
        F.floor("passes").cast("bigint").alias("whole"), F.coalesce("cut", F.lit(-1)).alias("_cut")), "mix-table")
    out = keyed.join(table, F.col("source").eqNullSafe(F.col("_s")))
    last = F.shiftrightunsigned(_order(F.col("whole"), F.col("key"), how), 48 - _BITS * _LEVELS) <= F.col("_cut")
    return out.withColumn("copies", F.col("whole") + last.cast("bigint")).drop("_s", "_cut")


def stream(docs: DataFrame, how: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source") -> DataFrame:
    """One row per use of a document: (doc_id, source, epoch, block, place, n_tokens, weight, exponent, entropy).

    Reading by ``block`` and within it by ``place`` gives the mixed stream.
    """
    rows = mixed(docs, how, id_col, text_col, source_col, [id_col]).withColumn("doc_id", F.col("doc")[id_col]).drop("doc")
    rows = settle(rows, "mix-uses")
    total = rows.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    blocks = max(1, math.ceil(total / how.block))
    uses = rows.filter("copies > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    at = _order(F.col("epoch"), F.col("key"), how)
    through = (F.col("epoch") + at / F.lit(float(1 << 48))) / F.greatest(F.col("passes"), F.lit(1e-12))
    block = F.least(F.floor(through * blocks), F.lit(blocks - 1)).cast("bigint")
    return uses.select("doc_id", "source", "epoch", block.alias("block"),
                       F.xxhash64(F.lit(how.seed + 1), "epoch", "key").alias("place"),
                       F.col("tokens").alias("n_tokens"), "weight", "exponent", "entropy")


def repeated(docs: DataFrame, how: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix uses it, with the columns of ``docs``."""
    rows = mixed(docs, how, id_col, text_col, source_col).filter("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("doc.*")
