"""Mixing sources to target weights by temperature, as budgeted block permutations.

A source with a share p of all tokens gets the weight p**t / sum(p**t).  The
exponent t between 0 (all alike) and 1 (as they are) is bisected: the least one
at which no source is repeated more often than the limit, or the one at which
the weights have the target entropy.  Weights become budgets in tokens: shares of
the total that is asked for, or, if none is, of the total under which the source
that is repeated least is read once in whole, so that no document is lost.

A source with a budget of 2.4 times its tokens is read twice in whole, each time
in another permutation, and then to 0.4 of a third: documents in the order of a
hash of this round, up to the budget.  The cut is found by blocks of that order:
sums of 2,048 blocks, then of 2,048 blocks within the one that holds the cut,
then single documents.  So no window holds more than the documents of one such
block, however large a source is.

Tokens are counted by words, or taken from a column of counts that is named.
Defined results: a null source is a source of its own; a source without tokens
(empty or null texts) is read once; null counts are 0; repeated rows and null ids
are rows like others, and rows that tie in the hash order stand or fall together.
An empty table gives an empty one.  All columns of the input are kept, whatever
their names; one named like a column that is added (``ADDED``) gives way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tramline.llm import _common as c

LIMIT, SEED = 2.0, 7
#: Columns that are added to the rows.
ADDED = ("mix_tokens", "mix_weight", "mix_epoch", "mix_place")
#: Sources whose weights are sent to every task; with more, they are joined by a shuffle.
SMALL = 20_000
#: Halvings of the exponent's interval that one pass over the sources decides.
AT_ONCE, PASSES = 4, 10
BLOCK_BITS = 11


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, limit: float | None = None, entropy: float | None = None) -> float:
    """Bisect the exponent over (source, tokens): by the repetition limit, or by the entropy in nats.

    With no source over zero tokens, or a goal that no exponent misses or meets, an end of [0, 1] is given.
    """
    total = sources.agg(F.sum("tokens"), F.max("tokens"), F.min(F.when(F.col("tokens") > 0, F.col("tokens")))).first()
    if not total[0]:
        return 1.0
    share = sources.where("tokens > 0").select((F.col("tokens") / total[0]).alias("p"))
    low, high = 0.0, 1.0

    def too_flat(t: float, z: float, a: float) -> bool:
        if limit is not None:
            return (1 - t) * math.log(total[1] / total[2]) > math.log(limit)
        return math.log(z) - t * a / z > entropy

    for _ in range(PASSES):
        n = 1 << AT_ONCE
        tried = [low + (high - low) * k / n for k in range(n + 1)]
        # sums of all the exponents that the next halvings can ask for
        sums = share.agg(*[F.sum(F.pow("p", F.lit(t))) for t in tried], *[F.sum(F.pow("p", F.lit(t)) * F.ln("p")) for t in tried]).first()
        flat = [too_flat(t, sums[i], sums[i + n + 1]) for i, t in enumerate(tried)]
        i, j = 0, n
        if not flat[0]:
            return low
        if flat[n]:
            return high
        while j - i > 1:
            mid = (i + j) // 2
            i, j = (mid, j) if flat[mid] else (i, mid)
        low, high = tried[i], tried[j]
    return high


def weights(sources: DataFrame, t: float, budget: float | None = None) -> DataFrame:
    """(src, tokens, weight, epochs) of each source, for a budget of tokens in all; without one the least repeated source has one epoch."""
    total = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    if not total[0]:
        return sources.withColumns({"weight": F.lit(0.0), "epochs": F.lit(1.0)})
    p = F.col("tokens") / total[0]
    z = sources.where("tokens > 0").agg(F.sum(F.pow(p, F.lit(t)))).first()[0]
    top = total[1] / total[0]
    often = F.pow(F.lit(top) / p, F.lit(1 - t)) if budget is None else F.pow(p, F.lit(t)) / z * float(budget) / F.col("tokens")
    epochs = F.when(F.col("tokens") > 0, often).otherwise(1.0)
    # a hair under a whole number, from rounding, is that number
    epochs = F.when(F.abs(epochs - F.round(epochs)) < 1e-9, F.round(epochs)).otherwise(epochs)
    return sources.withColumns({"weight": F.when(F.col("tokens") > 0, F.pow(p, F.lit(t)) / z).otherwise(0.0), "epochs": epochs})


def order_of(epoch: Column, row: Column, seed: int) -> Column:
    """Place of a row in the permutation of an epoch, 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("long"), row), 2)


def cuts(rows: DataFrame, sources: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(src, cut): the last place of the partial epoch.  rows is (src, u, tokens, rest)."""
    state = sources.select("src", F.col("rest"), F.lit(0).cast("long").alias("head"))
    shift, level = 62, rows
    for _ in range(2):
        shift -= bits
        block = F.shiftrightunsigned("u", shift)
        sums = level.groupBy("src", block.alias("block")).agg(F.sum("tokens").alias("n"))
        run = F.sum("n").over(Window.partitionBy("src").orderBy("block"))
        held = sums.withColumn("upto", run).join(state.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s")))
        # the first block that the budget does not hold in whole
        state = held.where("upto > rest").groupBy("src").agg(F.min(F.struct("block", F.expr("rest - (upto - n)").alias("left"))).alias("b")).select("src", F.col("b.left").alias("rest"), F.col("b.block").alias("head"))
        state = c.written(state, "cuts")
        level = level.join(state.select(F.col("src").alias("s"), "head"), F.col("src").eqNullSafe(F.col("s")) & (block == F.col("head"))).drop("s", "head")
    run = F.sum("tokens").over(Window.partitionBy("src").orderBy("u").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = level.withColumn("upto", run).join(state.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s")))
    found = last.where("upto <= rest").groupBy("src").agg(F.max("u").alias("u"))
    # without a document that fits, the cut is just before the block
    return state.select(F.col("src").alias("s"), F.expr(f"shiftleft(head, {shift}) - 1").alias("before")).join(found, F.col("s").eqNullSafe(F.col("src")), "left").select(F.col("s").alias("src"), F.coalesce("u", "before").alias("cut"))


def mix(docs: DataFrame, limit: float | None = LIMIT, entropy: float | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None, budget: float | None = None, add: bool = True) -> tuple[DataFrame, DataFrame]:
    """The mixed rows, and the table of sources.

    Rows have the input's columns and, if ``add``, those of ``ADDED``; reading
    them in order of mix_place (0 to 1) interleaves the sources evenly.  Under a
    ``budget`` (tokens in all) less than the sources hold, rows past it are left out.
    """
    c.ready(docs.sparkSession)
    names = docs.columns
    own = [f"in_{i}" for i in range(len(names))]  # so that no name of the input meets one of ours
    docs = docs.toDF(*own)
    of = lambda name: F.col(own[names.index(name)])
    count = words(of(text_col)) if tokens_col is None else F.coalesce(of(tokens_col), F.lit(0)).cast("long")
    row = F.xxhash64(of(id_col), of(text_col))
    slim = c.written(docs.select(of(source_col).alias("src"), row.alias("row"), count.alias("tokens")), "slim")
    totals = c.written(slim.groupBy("src").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "sources")
    t = exponent(totals, limit, entropy)
    n_sources = totals.count()
    near = F.broadcast if n_sources <= SMALL else lambda df: df  # checked size; beyond it, a shuffled join
    table = weights(totals, t, budget).withColumn("full", F.floor("epochs")).withColumn("rest", (F.col("epochs") - F.col("full")) * F.col("tokens"))
    table = c.written(table, "weights")
    part = table.where("rest > 0").select(F.col("src").alias("s"), "full")
    placed = slim.join(near(part), F.col("src").eqNullSafe(F.col("s"))).select("src", order_of(F.col("full"), F.col("row"), seed).alias("u"), "tokens")
    with c.tables_of_a_step() as keep:
        cut = cuts(placed, table.where("rest > 0"))
        done = table.join(cut.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s")), "left").drop("s")
        done = c.written(done.withColumn("cut", F.coalesce("cut", F.lit(-1).cast("long"))), "mix")
        keep.append(done)
    c.forget(slim, totals, table)

    sources = done.select(F.col("src").alias("_src"), F.col("weight").alias("mix_weight"), F.col("epochs").alias("_epochs"), F.col("full").alias("_full"), F.col("cut").alias("_cut"))
    out = docs.join(near(sources), of(source_col).eqNullSafe(F.col("_src")))
    copies = F.col("_full") + F.when(order_of(F.col("_full"), row, seed) <= F.col("_cut"), 1).otherwise(0)
    out = out.withColumn("_copies", copies).where("_copies > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    if not add:
        return out.select(*[F.col(o).alias(n) for o, n in zip(own, names, strict=True)]), done
    place = (F.col("mix_epoch") + order_of(F.col("mix_epoch"), row, seed) / float(1 << 62)) / F.greatest(F.col("_epochs"), F.lit(1.0))
    out = out.withColumn("mix_place", F.least(place, F.lit(1.0))).withColumn("mix_tokens", count)
    return out.select(*[F.col(o).alias(n) for o, n in zip(own, names, strict=True) if n.lower() not in ADDED], *ADDED), done
