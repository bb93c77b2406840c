"""Chat formatting by rotating the perspective of multi-party dialogues, with DataFrame operations alone.

For every participant of a dialogue the whole dialogue is rendered once with that speaker as the assistant; other
speakers become named users, and only the assistant's words carry loss. A rendering is kept as its turns: one row for
each (dialogue, perspective, turn) with the rendered piece and the span of it that is learned from. Joined in the order
of ``turn`` and ``place`` the pieces are the rendering. No row ever holds a whole dialogue, so one that fills a third
of the table is dealt over many tasks like any other rows.

A piece carries its place in the rendering as characters (``at``), so the rendering is settled without being built:
pieces are ranked over ranges of turns, and the lengths of the ranges before are added.

Texts can't forge turns: each ``<|`` of a text is rendered as ``<\\|``, so only rendered markers begin a turn; names are
rendered with one ``_`` for each control character, ``<``, ``|`` and ``>``.

Defined results: system turns belong to every perspective and never carry loss. Null or empty speakers are "anonymous",
null texts are empty. Null conversation ids are one dialogue; null turns come first. Turns that share a number are
ordered by ``place``, a hash of speaker and text; equal rows are rendered each. Dialogues with system turns alone have
no participant and so no rendering. A dialogue of n turns and m speakers has n m pieces, as asked for: where every turn
has its own speaker that is n^2. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm import common

#: The markers of a turn (ChatML).
START, END = "<|im_start|>", "<|im_end|>\n"
ANONYMOUS = "anonymous"
#: Turns of a range in which lengths are added up by one task.
RANGE = 100_000


def _speaker(column: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", F.lit(ANONYMOUS)).otherwise(F.col(column))


def escaped(column: str) -> Column:
    """A text in which no marker can begin."""
    return F.replace(F.col(column), F.lit("<|"), F.lit("<\\|"))


def plain_name(column: str) -> Column:
    return F.regexp_replace(column, r"[\x00-\x1F\x7F<|>]", "_")


def rotate(conversations: DataFrame, speaker_col: str = "role", system: str = "system") -> DataFrame:
    """conv_id, perspective, turn, place, speaker, role, name, piece, at, loss, loss_from, loss_to.

    ``loss_from`` and ``loss_to`` are characters of ``piece`` (from 0, end exclusive), null where nothing is learned.
    """
    turns = common.require(conversations, "conv_id", "turn", "text", *({speaker_col} - {"conv_id", "turn", "text"}))
    turns = turns.select("conv_id", "turn", _speaker(speaker_col).alias("speaker"), common.text_or_empty().alias("raw"))
    turns = turns.withColumn("text", escaped("raw")).withColumn("place", F.md5(F.concat_ws("\n", "speaker", "raw")))
    turns = in_ranges(turns)
    # Settled, so that the join may split the rows of a long dialogue.
    cast = common.settle(turns.filter(F.col("speaker") != system).groupBy("conv_id", "speaker").agg(F.count(F.lit(1)).alias("turns")), "participants")
    cast = cast.select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective"))
    rows = turns.join(cast, F.col("conv_id").eqNullSafe(F.col("conv")))
    role = F.when(F.col("speaker") == system, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    rows = rows.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", plain_name("speaker")))
    head = F.concat(F.lit(START), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", "text", F.lit(END)))
    mine = F.col("role") == "assistant"
    rows = placed(rows.withColumn("length", F.length("piece").cast("long")))
    return rows.select(
        "conv_id", "perspective", "turn", "place", "speaker", "role", "name", "piece", "at", mine.cast("int").alias("loss"),
        F.when(mine, F.length("head")).cast("long").alias("loss_from"), F.when(mine, F.length("piece")).cast("long").alias("loss_to"))


def in_ranges(turns: DataFrame) -> DataFrame:
    """The turns with ``range``: ranges of (conv_id, turn, place) of some RANGE turns, in that order, settled.

    A dialogue of any length is divided over as many ranges as it needs.
    """
    parts = max(1, -(-turns.count() // RANGE))
    dealt = turns.repartitionByRange(parts, F.col("conv_id").isNotNull(), "conv_id", F.col("turn").isNotNull(), "turn", "place") if parts > 1 else turns.repartition(1)
    return common.settle(dealt.withColumn("range", F.spark_partition_id()), "turns")


def placed(rows: DataFrame) -> DataFrame:
    """Adds ``at``, the characters of a rendering before a piece: sums within ranges, shifted by the ranges before."""
    keys = ["conv_id", "perspective"]
    within = Window.partitionBy(*keys, "range").orderBy("turn", "place").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "range").agg(F.sum("length").alias("length"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("range").alias("_r"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("_shift"))
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("range") == F.col("_r"))
    summed = rows.withColumn("_within", F.coalesce(F.sum("length").over(within), F.lit(0)))
    return summed.join(shift, on).withColumn("at", F.col("_within") + F.col("_shift")).drop("_c", "_p", "_r", "_shift", "_within")


def dialogues(rotated: DataFrame) -> DataFrame:
    """Whole renderings of dialogues of ordinary length: conv_id, perspective, rendering, spans (loss_from, loss_to)."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "place", "piece", "loss_from", "loss_to")))
    text = F.aggregate("parts", F.lit(""), lambda a, x: F.concat(a, x["piece"]))
    empty = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<loss_from: bigint, loss_to: bigint>>))")
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["piece"])).cast("long").alias("at"),
        F.when(x["loss_from"].isNull(), a["spans"]).otherwise(F.concat(a["spans"], F.array(F.struct((a["at"] + x["loss_from"]).alias("loss_from"), (a["at"] + x["loss_to"]).alias("loss_to"))))).alias("spans"))
    return rotated.groupBy("conv_id", "perspective").agg(parts.alias("parts")).select("conv_id", "perspective", text.alias("rendering"), F.aggregate("parts", empty, step, lambda a: a["spans"]).alias("spans"))
