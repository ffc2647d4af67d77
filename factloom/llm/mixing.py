"""Mixing sources to target weights: raking, then calibrated sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import materialize

#: Rounds of raking in one plan.
ROUNDS_AT_ONCE = 5
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _class(value: Column) -> Column:
    """A join key that is never null: nulls form a class of their own."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def tempered_shares(cells: DataFrame, dim: str, alpha: float) -> DataFrame:
    """Target shares (dim, share) in proportion to the class's share of tokens to the power ``alpha``."""
    powers = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(alpha)).alias("power"))
    powers = powers.where(F.col("power") > 0)
    return powers.crossJoin(powers.agg(F.sum("power").alias("all"))).select(dim, (F.col("power") / F.col("all")).alias("share"))


def bounded_shares(cells: DataFrame, dim: str, target: DataFrame, rate: float) -> DataFrame:
    """Shares (dim, share) of ``rate`` of all tokens that ask no class for more tokens than it has.

    A class that has fewer than its target gives all it has; what is missing goes to the others in proportion
    to their targets. So all are capped at one multiple of their shares. With the classes in the order of tokens over share
    those that give all are the first ones, and running sums over the classes tell which."""
    classes = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("most")).join(target.where("share > 0"), dim)
    total = cells.agg((F.sum("tokens") * F.lit(float(rate))).alias("wanted"))
    order = Window.orderBy(F.col("most") / F.col("share"), dim)
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("share").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    scaled = classes.crossJoin(total).withColumn("scale", (F.col("wanted") - before) / rest)
    open_ = F.col("share") * F.col("scale") < F.col("most")
    # The multiple falls until the first class that does not give all; that one's holds for all.
    scale = F.min(F.when(open_, F.struct(F.col("most") / F.col("share"), "scale"))).over(Window.partitionBy(F.lit(1)))["scale"]
    given = F.coalesce(F.least(F.col("share") * scale, F.col("most")), F.col("most"))
    return scaled.select(dim, (given / F.nullif(F.col("wanted"), F.lit(0.0))).alias("share"))


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 30, tolerance: float = 1e-9, total: float | None = None
) -> DataFrame:
    """Iterative proportional fitting of ``cells`` (the dims, tokens) to ``targets`` (dim -> (dim, share)).

    Adds ``weight``, which starts at the tokens and is scaled to each target in turn until a whole
    round changes no margin by more than ``tolerance``, or for ``rounds`` rounds (targets that no
    weights can meet together; the last dim is then met exactly). A class without a target, or with
    target zero, gets no weight.

    Each scaling is a sum over the cells of a class, beside which the cells stay: one exchange of the cells, which are
    few beside the documents, and no join. ROUNDS_AT_ONCE rounds are one plan, so that the driver plans a handful of jobs, and
    a class with a third of all cells is a sum that may spill, not a table to hold.

    With ``total``, weights are tokens to draw: the targets are shares of it, and no cell gets more than it
    has; the other cells of its classes take the excess in the next rounds.
    """
    for dim, target in targets.items():
        cells = cells.join(target.select(dim, F.col("share").alias(f"{dim}_share")), dim)
    cells = cells.where(F.col("tokens") > 0).withColumn("weight", F.col("tokens").cast("double"))
    cells = materialize(cells, "cells")
    done = 0
    while done < rounds:
        for _ in range(min(ROUNDS_AT_ONCE, rounds - done)):
            change = F.lit(0.0)
            for dim in targets:
                margin = F.sum("weight").over(Window.partitionBy(dim))
                factor = F.when(margin > 0, F.col(f"{dim}_share") * F.lit(float(total or 1.0)) / margin)
                cells = cells.withColumn("factor", factor)
                weight = F.col("weight") * F.coalesce("factor", F.lit(0.0))
                weight = weight if total is None else F.least(weight, F.col("tokens").cast("double"))
                cells = cells.withColumns({"weight": weight, "change": F.greatest(change, F.abs(F.col("factor") - 1))}).drop("factor")
                change = F.col("change")
        cells = materialize(cells, "raked")
        done += ROUNDS_AT_ONCE
        if (cells.agg(F.max("change")).first()[0] or 0.0) <= tolerance:
            break
    return cells.where("weight > 0").drop("change", *[f"{dim}_share" for dim in targets])


def uniform(doc_id: Column) -> Column:
    """A fixed number in [0, 1) for each id, from 32 bits of its MD5."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_documents(
    docs: DataFrame,
    alphas: dict[str, float] | None = None,
    targets: dict[str, DataFrame] | None = None,
    rate: float | None = None,
    once: bool = False,
    tokens: Column | None = None,
    carry: tuple[str, ...] = ("doc_id",),
    draw: Column | None = None,
) -> DataFrame:
    """Sample documents so that their tokens meet marginal targets.

    ``docs`` has doc_id, text and the dims, for example source, lang and topic. ``alphas`` gives each dim a
    tempered target (token share to this power, 1 keeps shares, 0 makes classes equal); ``targets`` gives
    explicit shares instead: dim -> (dim, share). A null is a class of its own. ``tokens`` counts a row's tokens (its words).

    Returns ``carry``, the dims, n_tokens, expected (calibrated number of copies; a probability if at
    most 1) and copies, the drawn number: the whole part of ``expected`` and one more with the remaining
    probability. ``rate`` is the number of tokens wanted, relative to all; None takes the largest at
    which no document is wanted more than once. ``once`` bounds the expected number of a cell at 1 at a given
    ``rate`` (at most 1) and hands its excess to other cells, so that no single cell decides on the size of
    the sample; classes too small for their target are taken whole. The draw depends on ``draw`` alone (doc_id), so rows that repeat
    it are drawn alike within a cell and a rerun gives the same sample. Documents in cells without tokens, or in classes
    without a target, are expected 0 times. Columns other than these are ignored. An empty table gives
    an empty result.

    Tokens are counted per cell before anything is shuffled; raking runs on cells, and documents meet
    their cell's weight in one join, whose small side is stored first so that Spark knows its size.
    """
    dims = list(alphas or targets)
    keys = [f"__{d}" for d in dims]
    tokens = word_count(F.col("text")) if tokens is None else tokens
    keyed = docs.withColumns({"n_tokens": tokens, **{f"__{d}": _class(F.col(d)) for d in dims}})
    if carry == ("doc_id",):
        keyed = materialize(keyed.select("doc_id", *dims, "n_tokens", *keys), "tokens")
    cells = keyed.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"))
    cells = materialize(cells, "cells")
    if targets:
        shares = {f"__{d}": t.select(_class(F.col(d)).alias(f"__{d}"), "share") for d, t in targets.items()}
    else:
        shares = {f"__{d}": tempered_shares(cells, f"__{d}", a) for d, a in alphas.items()}
    if once:
        size = rate * (cells.agg(F.sum("tokens")).first()[0] or 0)
        shares = {d: bounded_shares(cells, d, t, rate) for d, t in shares.items()}
        raked = rake(cells, shares, total=size or None)
    else:
        raked = rake(cells, shares)
    ratio = F.col("weight") / F.col("tokens")
    scale = raked.agg(F.sum("tokens").alias("all"), F.sum("weight").alias("weights"), F.max(ratio).alias("most")).first()
    total = scale["all"] or 0
    factor = 1.0 if once else (rate * total / (scale["weights"] or 1.0)) if rate is not None else 1.0 / (scale["most"] or 1.0)
    wanted = materialize(raked.select(*keys, (ratio * F.lit(float(factor))).alias("expected")), "wanted")
    found = keyed.join(wanted, keys, "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    whole = F.floor(F.col("expected"))
    extra = F.when(uniform(F.col("doc_id") if draw is None else draw) < F.col("expected") - whole, 1).otherwise(0)
    return found.select(*carry, *[d for d in dims if d not in carry], "n_tokens", "expected", (whole + extra).cast("long").alias("copies"))
