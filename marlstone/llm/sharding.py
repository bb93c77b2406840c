"""Sharding by a minimax contiguous partition, with DataFrame operations alone.

Rows with equal texts form an atomic group. Groups stand in the order of their texts' SHA-256, so a row knows its
place from its own text and seven cut digests are all that has to reach the rows: no join, and a text that a third of
the rows share costs nothing extra. The smallest capacity for which the greedy walk needs no more than the given
number of shards is searched over distributed prefix sums, and the cuts are those of that walk. A group larger than an
even share decides the capacity alone, and the walk would then leave the last shards empty: such a group has a shard of its
own, and the same search runs again on what lies before and after it, for the shards that are left.

Defined results: null text has size 1 and stands with the empty text (CRC 0). Repeated rows each have a slot. Shards
that get no group stay empty. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.ranking import number_in_order
from marlstone.llm import common
from marlstone.sources import files

#: Buckets of the first 16 bits of a digest; the driver holds a sum for each (65,536 numbers at most).
BUCKET_BITS = 16
#: Each round of the search divides the capacities that are left by this, as a round is a pass over the table and not one
#: step: halving tries one capacity a pass, this many share it. As many rows at most are broadcast and come back.
PROBES = 511
#: Rows that one task numbers.
RANGE = 16_384


def size_of(column: str = "text") -> Column:
    return (F.octet_length(common.text_or_empty(column)) + 1).cast("long")


def _bucket(digest: str) -> Column:
    return F.conv(F.substring(digest, 1, BUCKET_BITS // 4), 16, 10).cast("int")


class PrefixSums:
    """Sums of group sizes up to each group in digest order: coarse ones on the driver, fine ones in a table."""

    def __init__(self, groups: DataFrame) -> None:
        within = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
        # In ranges of buckets, so that a probe for some of them reads few files.
        sized = groups.withColumn("bucket", _bucket("digest")).repartitionByRange("bucket").withColumn("up_to", F.sum("size").over(within))
        self.table = common.settle(sized.select("bucket", "digest", "size", "up_to"), "group-sums")
        self.spark: SparkSession = groups.sparkSession
        rows = self.table.groupBy("bucket").agg(F.sum("size").alias("s"), F.max("size").alias("m")).collect()
        self.buckets, self.before, self.total = [], [], 0
        for r in sorted(rows, key=lambda r: r["bucket"]):
            self.buckets.append(r["bucket"])
            self.before.append(self.total)
            self.total += r["s"]
        self.largest = max((r["m"] for r in rows), default=0)
        #: Stretches that are known: where they start, in order, and (start, end, digest of the group that ends at the start).
        self.starts: list[int] = []
        self.known: dict[int, tuple[int, int, str]] = {}

    def ends(self, limits: set[int]) -> dict[int, tuple[int, str | None, int]]:
        """For each limit the largest prefix sum that is no larger, the digest of the group where it ends, and the next sum."""
        out = {x: (self.total, None, self.total) for x in limits if x >= self.total}
        asked = []
        for x in limits - out.keys():
            at = bisect_right(self.starts, x) - 1
            if at >= 0 and x < self.known[self.starts[at]][1]:
                start, end, digest = self.known[self.starts[at]]
                out[x] = (start, digest, end)
                continue
            i = bisect_right(self.before, x) - 1
            asked.append((x, self.buckets[i], x - self.before[i], self.before[i]))
        if asked:
            values = ",".join(f"({x}L,{b},{y}L)" for x, b, y, _ in asked)
            probes = self.spark.sql(f"SELECT * FROM VALUES {values} AS t(x, b, y)")
            met = self.table.filter(F.col("bucket").isin(sorted({b for _, b, _, _ in asked})))
            found = met.join(F.broadcast(probes), F.col("bucket") == F.col("b")).groupBy("x").agg(
                F.max(F.when(F.col("up_to") <= F.col("y"), F.struct("up_to", "digest"))).alias("last"), F.min(F.when(F.col("up_to") > F.col("y"), F.col("up_to"))).alias("next"))
            got = {r["x"]: r for r in found.collect()}
            for x, _, _, before in asked:
                last, after = got[x]["last"], got[x]["next"]
                out[x] = (before + (last["up_to"] if last else 0), last["digest"] if last else None, before + after)
                if last and out[x][0] not in self.known:
                    insort(self.starts, out[x][0])
                    self.known[out[x][0]] = (out[x][0], before + after, last["digest"])
        return out

    def larger_than(self, size: int) -> list[tuple[int, int]]:
        """(sum before it, size) of each group over a size that few can have: total / size rows come back at most."""
        before = dict(zip(self.buckets, self.before, strict=True))
        rows = self.table.filter(F.col("size") > F.lit(size)).select("bucket", "up_to", "size").collect()
        return sorted((before[r["bucket"]] + r["up_to"] - r["size"], r["size"]) for r in rows)

    def walk(self, capacities: list[int], shards: int, segments: list[tuple[int, int]]) -> dict[int, list[list[int]]]:
        """The greedy walk over each segment (from, to) for many capacities at once: where shards end, by segment.

        Capacities for which the segments need more shards than there are, or that a group exceeds, are missing.
        """
        ends: dict[int, list[list[int]]] = {c: [[]] for c in capacities}
        at = {c: segments[0][0] for c in capacities}
        done: dict[int, list[list[int]]] = {}
        for _ in range(shards):
            limits = {c: min(at[c] + c, segments[len(ends[c]) - 1][1]) for c in at}
            found = self.ends(set(limits.values()))
            for c, limit in limits.items():
                end = found[limit][0]
                if end <= at[c]:
                    del at[c]
                    continue
                at[c] = end
                ends[c][-1].append(end)
                if end == segments[len(ends[c]) - 1][1]:
                    if len(ends[c]) == len(segments):
                        done[c] = ends[c]
                        del at[c]
                    else:
                        at[c] = segments[len(ends[c])][0]
                        ends[c].append([])
            if not at:
                break
        return done


def smallest_capacity(sums: PrefixSums, shards: int, segments: list[tuple[int, int]] | None = None, largest: int | None = None) -> tuple[int, list[list[int]]]:
    """The smallest capacity for which the greedy walk over the segments needs no more than ``shards``, and where they end."""
    segments = segments or [(0, sums.total)]
    largest, total = sums.largest if largest is None else largest, sum(b - a for a, b in segments)
    # A shard more for each further segment is what starting anew may cost, so an even share of the others is enough.
    low, high = max(1, -(-total // shards)), -(-total // max(1, shards - len(segments) + 1)) + largest
    best: tuple[int, list[list[int]]] = (high, [])
    while low <= high:
        tries = sorted({low + (high - low) * i // PROBES for i in range(PROBES + 1)}) if high - low > PROBES else list(range(low, high + 1))
        done = sums.walk(tries, shards, segments)
        if not done:  # feasibility grows with the capacity and the largest try isn't feasible
            break
        best = (min(done), done[min(done)])
        less = [c for c in tries if c < best[0]]
        low, high = (less[-1] + 1 if less else best[0]), best[0] - 1
    return best


def minimax_ends(sums: PrefixSums, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and where the shards end.

    While the capacity is that of one group over an even share, the group has a shard of its own and the search goes on
    with the segments around it. Each segment then has the shards that the walk gave it, what is left over goes where
    shards are fullest, and a last search in each segment makes its shards as small as they can be.
    """
    large = sums.larger_than(sums.total // shards)  # fewer than there are shards
    capacity, ends = smallest_capacity(sums, shards)
    least, alone, left, segments = capacity, [], shards, [(0, sums.total)]
    while True:
        size = sum(b - a for a, b in segments)
        mine = next((g for g in large if g not in alone and g[1] == least and g[1] * left > size), None)
        if mine is None:
            break
        alone.append(mine)
        segments = [(x, y) for a, b in segments for x, y in ([(a, mine[0]), (mine[0] + mine[1], b)] if a <= mine[0] < b else [(a, b)]) if y > x]
        left -= 1
        if not segments:
            break
        largest = max((n for start, n in large if (start, n) not in alone), default=min(sums.largest, sums.total // shards))
        least, ends = smallest_capacity(sums, left, segments, largest)
    if not alone:
        return capacity, ends[0]
    cuts = [x for start, n in alone for x in (start, start + n)]
    count = [len(e) for e in ends] if segments else []
    while sum(count) < left and segments:
        fullest = max(range(len(segments)), key=lambda i: (segments[i][1] - segments[i][0]) / count[i])
        count[fullest] += 1
    for segment, n in zip(segments, count, strict=True):
        cuts += smallest_capacity(sums, n, [segment], min(least, segment[1] - segment[0]))[1][0]
    return capacity, sorted({c for c in cuts if c})


def cut_digests(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The capacity, and the last digest of each shard but the last that has groups."""
    sums = PrefixSums(groups)
    if not sums.total:
        return 0, []
    capacity, ends = minimax_ends(sums, shards)
    inner = sorted({e for e in ends if 0 < e < sums.total})
    found = sums.ends(set(inner))
    cuts = []
    for e in inner:
        digest = found[e][1]
        if digest is None:  # the shard ends with the bucket before
            i = bisect_right(sums.before, e) - 2
            digest = sums.table.filter(F.col("bucket") == sums.buckets[i]).agg(F.max("digest")).first()[0]
        cuts.append(digest)
    return capacity, cuts


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), capacity.

    ``slot`` counts a shard's rows from 0 without gaps, in the order of digest and id. Shards are stretches of that order,
    so the rows are numbered once over ranges of it, a group of any size over as many as it needs.
    """
    docs, spark = common.require(documents, "doc_id", "text"), documents.sparkSession
    text = common.text_or_empty()
    rows = common.settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of().alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest")), "shard-rows")
    capacity, cuts = cut_digests(rows.groupBy("digest").agg(F.sum("size").alias("size")), shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("digest") > F.lit(cut)).cast("int")
    counts = {r["shard"]: r["count"] for r in rows.groupBy(shard.alias("shard")).count().collect()}
    first, before = F.lit(0), 0
    for k in sorted(counts):
        first, before = F.when(F.col("shard") == k, F.lit(before)).otherwise(first), before + counts[k]
    placed = number_in_order(rows, ["digest", "doc_id"], files.scratch(spark, "shard-order"), sum(counts.values()), 0, "place", RANGE).withColumn("shard", shard)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"))


def write_shards(documents: DataFrame, path: str, shards: int = 8) -> None:
    """Writes the documents to ``path/shard=N``; equal texts lie in one shard."""
    cuts = cut_digests(documents.groupBy(F.sha2(common.text_or_empty(), 256).alias("digest")).agg(F.sum(size_of()).alias("size")), shards)[1]
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.sha2(common.text_or_empty(), 256) > F.lit(cut)).cast("int")
    documents.withColumn("shard", shard).write.partitionBy("shard").parquet(path)
