"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent between 0 (even) and 1 (as
they are); the exponent is bisected to the largest that reaches a target entropy
and keeps every source within a limit of repetitions.  The normalised weights times
the token budget give each source its budget.  A source's documents are dealt into
blocks; every pass over the source permutes its blocks anew, and the last pass
takes blocks in its order until the budget is met.

Nothing is collected but a few sums, and no window spans a source: blocks are
ordered in two levels (slices of the hash range, then within a slice), so a source
with a third of all rows is ordered by many tasks.

Cases: a null source is a source of its own; null text counts as empty; documents
without tokens are emitted in every pass that takes their block; one source, or none with tokens:
the exponent is 1; repeated rows are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

SLICES = 256
#: Up to this many sources the table of their weights is broadcast; beyond it is joined by key.
FEW_SOURCES = 10_000


@dataclass
class Mix:
    """``weights``: ``source, n_tokens, share, weight, epochs``; ``exponent`` as bisected."""

    weights: DataFrame
    exponent: float
    budget: float


def count_tokens(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def solve(totals: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None = None, steps: int = 32) -> Mix:
    """Weights for ``totals`` (``source, n_tokens``).

    ``target_entropy`` is a fraction of the greatest possible entropy.
    ``budget`` in tokens; None: the least at which every source appears whole once.
    """
    totals = checkpointed(totals)
    live = totals.filter("n_tokens > 0")
    total, n, least, most = live.agg(F.sum("n_tokens"), F.count("*"), F.min("n_tokens"), F.max("n_tokens")).first()
    if not n:
        return Mix(totals.withColumns({"share": F.lit(0.0), "weight": F.lit(0.0), "epochs": F.lit(1.0)}), 1.0, 0.0)
    p = F.col("n_tokens") / F.lit(float(total))

    def state(alphas: list[float]) -> list[tuple[float, float, float]]:
        """(alpha, entropy share, most repetitions) of each exponent, in one job."""
        import math

        made = live.agg(*[F.sum(F.pow(p, F.lit(a))).alias(f"z{i}") for i, a in enumerate(alphas)], *[F.sum(F.pow(p, F.lit(a)) * F.ln(p)).alias(f"l{i}") for i, a in enumerate(alphas)]).first()
        out = []
        for i, a in enumerate(alphas):
            z, log = made[f"z{i}"], made[f"l{i}"]
            entropy = (math.log(z) - a * log / z) / math.log(n) if n > 1 else 1.0
            epochs = [(q / total) ** (a - 1) / z for q in (least, most)]  # tokens drawn for each held, at a budget of all tokens
            out.append((a, entropy, max(epochs) * budget / total if budget else max(epochs) / min(epochs)))
        return out

    def fits(x: tuple[float, float, float]) -> tuple[bool, bool]:
        return target_entropy is None or x[1] >= target_entropy, max_repeats is None or x[2] <= max_repeats

    # Entropy falls and repetition falls as the exponent grows: the limit binds first.
    def edge(ok, low: float, high: float) -> tuple[float, float]:
        """The exponents around the change of ``ok``, bisected four times (16 ways) in one job, to ``steps`` halvings."""
        for _ in range(max(1, steps // 4)):
            grid = [low + (high - low) * i / 16 for i in range(17)]
            marks = [ok(x) for x in state(grid)]
            k = next((i for i in range(1, 17) if marks[i] != marks[0]), 16)
            low, high = grid[k - 1], grid[k]
        return low, high

    ends = state([0.0, 1.0])
    exponent = 1.0
    if n > 1 and target_entropy is not None and not fits(ends[1])[0]:
        exponent = edge(lambda x: fits(x)[0], 0.0, 1.0)[0]
    if n > 1 and max_repeats is not None and not fits(state([exponent])[0])[1]:
        exponent = edge(lambda x: fits(x)[1], 0.0, 1.0)[1]
    z = live.agg(F.sum(F.pow(p, F.lit(exponent)))).first()[0]
    weight = F.when(F.col("n_tokens") > 0, F.pow(p, F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    tokens = budget if budget is not None else total / min(((q / total) ** (exponent - 1)) / z for q in (least, most))
    epochs = F.when(F.col("n_tokens") > 0, weight * F.lit(float(tokens)) / F.col("n_tokens")).otherwise(1.0)
    return Mix(totals.withColumns({"share": p, "weight": weight, "epochs": F.round(epochs, 9)}), exponent, float(tokens))


def mix(
    docs: DataFrame, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, budget: float | None = None, block_tokens: int = 100_000, seed: int = 7,
    source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", whole: bool = False,
) -> DataFrame:
    """One row for each time that a document is drawn.

    Columns: ``doc_id, source, n_tokens, weight, pass, block, progress``, and with
    ``whole`` the input row as a struct ``row``, so that its names can't clash;
    ordering by ``progress`` interleaves the sources by weight.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    # A null source is the empty key; every other has a mark before it.
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    counted = docs.select(F.col(id_col).alias("doc_id"), source.alias("__source"), count_tokens(F.col(text_col)).alias("n_tokens"), F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col)).alias("__hash"), *row)
    found = solve(counted.groupBy(F.col("__source").alias("source")).agg(F.sum("n_tokens").alias("n_tokens")), target_entropy, max_repeats, budget)
    weights = found.weights.select(F.col("source").alias("__source"), F.col("n_tokens").alias("__total"), "weight", "epochs", F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / block_tokens)).alias("__blocks"))
    # One row a source: broadcast while that is small, whatever the rows are; else by key, where AQE splits a hot source.
    if weights.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        weights = F.broadcast(weights)
    dealt = counted.join(weights, "__source").withColumn("block", F.pmod("__hash", "__blocks"))
    blocks = dealt.groupBy("__source", "block").agg(F.sum("n_tokens").alias("__tokens"), F.first("epochs").alias("epochs"))
    passes = checkpointed(
        blocks.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs") - 1, F.lit(0)).cast("int"))).alias("pass"))
        .withColumn("__u", F.xxhash64(F.lit(seed), "__source", "pass", "block"))
        .withColumn("__slice", F.pmod(F.shiftrightunsigned("__u", 8), F.lit(SLICES)))
    )
    # Two levels: tokens of a slice, slices before it, then blocks before in its slice.
    sums = passes.groupBy("__source", "pass", "__slice").agg(F.sum("__tokens").alias("__in"))
    before = sums.select("__source", "pass", "__slice", F.coalesce(F.sum("__in").over(Window.partitionBy("__source", "pass").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("__source", "pass", "__slice").orderBy("__u", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = passes.withColumn("__within", F.coalesce(F.sum("__tokens").over(inner), F.lit(0))).join(before, ["__source", "pass", "__slice"])
    totals = weights.select("__source", F.col("__total").alias("__all"))
    # The last pass stops at the block that reaches the budget; a block that is half in is taken.
    share = F.col("epochs") - F.col("pass")
    start = F.col("__before") + F.col("__within")
    taken = placed.join(totals, "__source").filter((F.col("__all") == 0) | (start + F.col("__tokens") / 2 <= share * F.col("__all")) | (share >= 1))
    taken = taken.select("__source", "block", "pass", F.when(F.col("__all") > 0, (F.col("pass") + start / F.col("__all")) / F.col("epochs")).otherwise(0.0).alias("progress"))
    # All passes of a block in one row, so the documents are read and joined once.
    drawn = checkpointed(taken.groupBy("__source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "progress"))).alias("__draws"), F.lit(1).alias("__one")))
    joined = _join_blocks(dealt, drawn)
    source = F.when(F.col("__source") != "", F.substr("__source", F.lit(2)))
    return joined.select("doc_id", source.alias("source"), "n_tokens", "weight", F.col("__draw.pass").alias("pass"), "block", F.col("__draw.progress").alias("progress"), *(["row"] if whole else []))


def _join_blocks(dealt: DataFrame, drawn: DataFrame) -> DataFrame:
    """Documents with the draws of their block; blocks are of like size, so no key is hot."""
    return dealt.join(drawn, ["__source", "block"]).withColumn("__draw", F.explode("__draws")).drop("__draws", "__one")


def remix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as drawn by :func:`mix`: the same columns, a row as often as it is drawn."""
    return mix(docs, whole=True, **options).select("row.*")
