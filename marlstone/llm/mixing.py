"""Mixing sources to target weights by entropy balancing, with DataFrame operations alone.

Each document has a rate r between 0 and 2 (its expected copies). Among all rates that meet a source's token target,
the one closest to 1 in relative entropy is r = min(2, exp(lambda * size / scale)), lambda being the minimiser of the
convex dual  sum phi(lambda x) - lambda T,  phi'(u) = min(2, e^u). Rates depend on source and size alone, so the Newton
steps run over the table of distinct (source, size) with their counts: each is a partly grouped aggregate of that
table, whatever the number of documents. Rates are then rounded to copies: within a source, cumulated fractions are
rounded along the sizes, and a few single copies are added or taken back where the source is off its target.

Defined results: null text has size 0 and takes part with nothing to take. The null source comes last. Equal rows each
have their own copies. A source whose target is twice its size takes every document twice. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.ranking import number_in_order
from marlstone.llm import common

#: Copies of a document at most.
MOST = 2
#: The Newton steps end when each source's sum is within this part of its target, or after so many.
CLOSE, STEPS = 1e-9, 60
#: Single copies added or taken back for each source after rounding.
CORRECTIONS = 6


def targets(sizes: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, cap: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, nulls last, have the weights in turn. They share ``share`` times all sizes by
    weight; a target stops at ``cap`` times its source's size and the others share what it leaves, again by weight.
    That is the level t with sum of min(cap_i, t w_i) equal to the total. It is found as the rule says: share by weight,
    stop who is above, share again among the others; each round is an aggregate, and the level only grows. Sums are
    of whole numbers, so reruns agree. The table has a row a source; no task sees more than its part of it.
    """
    n = sizes.count()
    turned = number_in_order(sizes.withColumn("_null", F.col("source").isNull()).withColumn("_hex", F.hex("source")), ["_null", "_hex"], f"{common.shared_root(sizes.sparkSession)}/marlstone/turns-{uuid.uuid4().hex}", n, 0, "turn")
    ws = F.array(*[F.lit(float(w)) for w in weights])
    s = turned.withColumn("w", F.element_at(ws, F.pmod(F.col("turn"), F.lit(len(weights))).cast("int") + 1)).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    s = common.settle(s.select("source", "source_size", "w", "cap"), "mix-weights")
    total, level, kept = None, 0.0, None
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("w")
        r = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(~capped, F.col("w"))).alias("w"), F.sum(F.when(capped, F.col("cap"))).alias("c"), F.sum(capped.cast("long")).alias("n")).first()
        total = float(share) * (r["all"] or 0)
        if r["n"] == kept or not r["w"]:
            break
        kept, level = r["n"], (total - (r["c"] or 0.0)) / r["w"]
    target = F.least(F.col("cap"), F.lit(level) * F.col("w")) if r["w"] else F.col("cap")
    return s.select("source", "source_size", target.alias("target"))


def _rate(u: Column) -> Column:
    return F.when(u < F.log(F.lit(float(MOST))), F.exp(u)).otherwise(F.lit(float(MOST)))


def solve(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, scale, lam) for cells (source, size, n) and targets: safeguarded Newton steps on the dual.

    The derivative g(lam) = sum n size r - target grows with lam, so each step also narrows a bracket and falls
    back to its middle where the Newton step would leave it.
    """
    scale = cells.filter("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    start = wanted.join(scale.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "scale", F.col("target"), F.lit(0.0).alias("lam"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done"), F.col("source_size"))
    # A target of all that the copies can give is met by lambda at the top of the bracket, without steps.
    full = F.col("target") >= F.lit(MOST * (1 - 1e-12)) * F.col("source_size")
    state = common.settle(start.withColumn("lam", F.when(full, F.lit(1e6)).otherwise(F.col("lam"))).withColumn("done", full), "mix-duals")
    for _ in range(STEPS):
        u = F.col("lam") * F.col("size") / F.col("scale")
        r = _rate(u)
        x = F.col("size") / F.col("scale")
        joined = cells.join(state.filter("not done").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        sums = joined.groupBy("s").agg(F.sum(F.col("n") * F.col("size") * r).alias("got"), F.sum(F.when(r < MOST, F.col("n") * F.col("size") * x * r).otherwise(0.0)).alias("slope"))
        g = F.col("got") - F.col("target")
        low, high = F.when(g < 0, F.col("lam")).otherwise(F.col("low")), F.when(g > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - g / F.col("slope")
        stepped = state.filter("not done").join(sums.withColumnRenamed("s", "k"), F.col("source").eqNullSafe(F.col("k"))).withColumn("low2", low).withColumn("high2", high)
        close = F.abs(g) <= F.lit(CLOSE) * F.greatest(F.col("target"), F.lit(1.0))
        narrow = F.col("high2") - F.col("low2") < 1e-13 * F.greatest(F.abs(F.col("lam")), F.lit(1.0))
        middle = F.when(F.col("high2") >= 1e6, F.greatest(F.col("lam") * 2, F.col("lam") + 1)).when(F.col("low2") <= -1e6, F.least(F.col("lam") * 2, F.col("lam") - 1)).otherwise((F.col("low2") + F.col("high2")) / 2)
        inside = (F.col("slope") > 0) & (newton > F.col("low2")) & (newton < F.col("high2"))
        lam = F.when(close, F.col("lam")).when(inside, newton).otherwise(middle)
        stepped = stepped.select("source", "scale", "target", lam.alias("lam"), F.col("low2").alias("low"), F.col("high2").alias("high"), (close | narrow).alias("done"), "source_size")
        before, state = state, common.settle(state.filter("done").unionByName(stepped), "mix-duals")
        common.drop(before)
        if state.filter("not done").isEmpty():
            break
    # Sums of doubles depend on the order of their parts in the last bits; rounded, reruns agree.
    return state.select("source", "scale", F.round("lam", 10).alias("lam"), "target")


def round_cells(cells: DataFrame, duals: DataFrame) -> DataFrame:
    """(source, size, n, base, extra): every document of a cell has ``base`` copies, ``extra`` of them one more."""
    rated = cells.join(duals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("lam") * F.col("size") / F.col("scale"))).otherwise(F.lit(0.0)))
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    rated = rated.withColumn("base", F.floor("rate")).withColumn("part", F.col("n") * (F.col("rate") - F.col("base"))).withColumn("sum", F.sum("part").over(along))
    extra = F.floor(F.col("sum") + 0.5) - F.floor(F.col("sum") - F.col("part") + 0.5)
    out = common.settle(rated.select("source", "size", "n", "target", "base", F.greatest(F.lit(0), F.least(F.col("n"), extra)).cast("long").alias("extra")), "mix-cells")
    for _ in range(CORRECTIONS):
        taken = F.col("size") * (F.col("base") * F.col("n") + F.col("extra"))
        off = out.groupBy("source").agg((F.max("target") - F.sum(taken)).alias("off")).withColumnRenamed("source", "o")
        seen = out.join(off, F.col("source").eqNullSafe(F.col("o")))
        more = (F.col("off") > 0) & (F.col("base") * F.col("n") + F.col("extra") < MOST * F.col("n"))
        less = (F.col("off") < 0) & (F.col("base") * F.col("n") + F.col("extra") > 0)
        gain = F.abs(F.col("off")) - F.abs(F.abs(F.col("off")) - F.col("size"))
        best = seen.filter((F.col("size") > 0) & (more | less) & (gain > 0)).groupBy("source", "off").agg(F.max_by("size", F.struct(gain.alias("g"), F.col("size").alias("z"))).alias("pick"))
        picks = best.select(F.col("source").alias("p"), "pick", F.signum("off").cast("long").alias("by"))
        moved = out.join(picks, F.col("source").eqNullSafe(F.col("p")) & (F.col("size") == F.col("pick")), "left")
        count = F.col("base") * F.col("n") + F.col("extra") + F.coalesce(F.col("by"), F.lit(0))
        base = F.floor(count / F.col("n"))
        base = F.when(F.col("by").isNull(), F.col("base")).otherwise(F.least(base, F.lit(MOST)))
        moved = moved.withColumn("count", count).withColumn("base", base).select("source", "size", "n", "target", "base", (F.col("count") - F.col("base") * F.col("n")).cast("long").alias("extra"))
        if best.isEmpty():
            break
        before, out = out, common.settle(moved, "mix-cells")
        common.drop(before)
    return out.select("source", "size", "base", "extra")


def mix(documents: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, mark (of the whole row): what the mix takes of each document."""
    common.require(documents, "doc_id", "text", "source")
    rows = common.settle(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", common.word_count().alias("size"), common.row_hash(documents).alias("mark")), "mix-rows")
    cells = common.settle(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    sized = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = common.settle(targets(sized, weights, share), "mix-targets")
    plan = common.settle(round_cells(cells, solve(cells, wanted)), "mix-plan")
    # Which documents of a cell get the extra copy: the first ones in an order by hash.
    ranked = common.spread_rank(rows, ["source", "size"], ["doc_id", "mark"], "rank", parts=max(256, min(65536, rows.count() // 4096)))
    named = plan.withColumnRenamed("source", "s").withColumnRenamed("size", "z")
    whole = wanted.withColumnRenamed("source", "q")
    out = ranked.join(named, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).join(whole, F.col("source").eqNullSafe(F.col("q")))
    copies = (F.col("base") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0)).cast("int")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"), "source", "mark")


def mixed_documents(documents: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """The documents as often as the mix takes them, with their columns."""
    plan = mix(documents, weights, share).filter("copies > 0")
    name = lambda i, m: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), m.cast("string"))
    # Rows that are equal in all columns share a key: one of them stands for all and has the sum of their copies.
    taken = plan.groupBy(name(F.col("doc_id"), F.col("mark")).alias("k")).agg(F.sum("copies").alias("n"))
    return common.keep_keyed(documents, name(F.col("doc_id").cast("long"), common.row_hash(documents)), taken, copies=True)
