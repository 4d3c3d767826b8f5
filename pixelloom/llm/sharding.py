"""Sharding by balanced label propagation, with counts of rows at most one apart (law `rows`).

Documents of equal text are neighbours; an edge runs from each to the hub of its group. Every document
starts in a shard drawn from its doc_id. In each round the hubs take the open shard where most of their
group lies and ask to move there; what a shard may take in is its quota of rows less what it holds, and
if more is asked for, a share of the hubs drawn by hash goes first. A shard with less than a twentieth of its quota left is
closed. Hubs of a group that holds more than a PIECES-th of all rows are split into pieces, which move
on their own, so that no group lands in one task and a group larger than a shard can fill several.
At last each shard gives up what it holds over its exact target, documents without neighbours first.

Results: every row of the input with shard and a slot that counts from 0 in each shard without gaps.
A null text has no bytes and equals the empty text; null doc_ids are placed like any value; repeated
rows each get a slot of their own. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

PIECES = 1024
BUCKETS = 1024


def _draw(modulus, *cols):
    return F.pmod(F.xxhash64(*cols), F.lit(modulus) if isinstance(modulus, int) else modulus).cast("int")


def _propagate(weights: DataFrame, pieces: DataFrame, total: int, shards: int, rounds: int) -> DataFrame | None:
    """Labels (grp, piece, n, label) of the pieces that found room."""
    cap = total / shards
    load = dict.fromkeys(range(shards), 0)
    labels = None
    for i in range(rounds):
        spark = weights.sparkSession
        room = {s: cap - load[s] for s in load if cap - load[s] >= max(1.0, 0.05 * cap)}
        if not room:
            break
        left = pieces if labels is None else pieces.join(labels.select("grp", "piece"), ["grp", "piece"], "left_anti")
        votes = weights.join(left.select("grp", "piece"), ["grp", "piece"], "left_semi").select("grp", "shard", "w")
        if labels is not None:
            votes = votes.unionByName(labels.select("grp", F.col("label").alias("shard"), F.col("n").alias("w")))
        open_shards = spark.createDataFrame([(s, float(r)) for s, r in room.items()], "shard int, room double")
        sums = votes.groupBy("grp", "shard").agg(F.sum("w").alias("w"))
        # groups that hold nothing in an open shard move to one drawn by hash
        drawn = sorted(room)
        best = sums.join(F.broadcast(open_shards), "shard", "left").groupBy("grp").agg(
            F.max(F.when(F.col("room").isNotNull(), F.struct("w", F.xxhash64("grp", "shard").alias("tie"), "shard"))).alias("top")
        )
        spare = F.element_at(F.array(*[F.lit(s) for s in drawn]), _draw(len(drawn), F.col("grp"), F.lit(i)) + 1)
        best = best.select("grp", F.coalesce(F.col("top.shard"), spare).cast("int").alias("label"))
        asked = materialise(left.join(best, "grp"), f"asked{i}")
        want = {r["label"]: r["n"] for r in asked.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        if not want:
            break
        share = spark.createDataFrame([(s, min(1.0, room[s] / w)) for s, w in want.items()], "label int, share double")
        luck = _draw(1 << 20, F.col("grp"), F.col("piece"), F.lit(i + 101)) / float(1 << 20)
        took = asked.join(F.broadcast(share), "label").filter(luck < F.col("share")).select("grp", "piece", "n", "label")
        labels = materialise(took if labels is None else labels.unionByName(took), f"labels{i}")
        load |= {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        if all(w <= room[s] for s, w in want.items()):
            break
    return labels


def _places(counts: dict[tuple[int, int], int], total: int, shards: int) -> list[tuple]:
    """Runs of ranks (shard, bucket, first, end, new shard, slot of the first) that meet the targets exactly."""
    target = [total // shards + (s < total % shards) for s in range(shards)]
    filled, runs, over = [0] * shards, [], []
    for (s, b), n in sorted(counts.items(), key=lambda x: (x[0][0], -x[0][1])):  # linked buckets have the higher numbers
        stay = min(n, target[s] - filled[s])
        if stay:
            runs.append((s, b, 0, stay, s, filled[s]))
            filled[s] += stay
        if n > stay:
            over.append((s, b, stay, n))
    to = 0
    for s, b, first, end in over:
        while first < end:
            while filled[to] == target[to]:
                to += 1
            n = min(end - first, target[to] - filled[to])
            runs.append((s, b, first, first + n, to, filled[to]))
            filled[to] += n
            first += n
    return runs


def balanced_shards(docs: DataFrame, shards: int = 16, rounds: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, grp, linked, shard, slot of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("grp"),
    )
    base = materialise(base, "nodes")
    total = base.count()
    big = base.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * PIECES > max(total, PIECES))
    big = big.select("grp", F.ceil(F.col("n") * PIECES / F.lit(max(total, 1))).cast("int").alias("k"))  # fewer than PIECES rows
    nodes = base.join(F.broadcast(big), "grp", "left").select(
        *base.columns,
        F.coalesce(_draw(F.col("k"), F.col("doc_id"), F.lit(3)), F.lit(0)).alias("piece"),
        F.col("k").isNotNull().alias("split"),
        _draw(shards, F.col("doc_id"), F.lit(5)).alias("start"),
    )
    nodes = materialise(nodes, "pieces")
    weights = nodes.groupBy("grp", "piece", "split", F.col("start").alias("shard")).agg(F.count(F.lit(1)).alias("w"))
    sizes = weights.groupBy("grp", "piece").agg(F.sum("w").alias("n"), F.max("split").alias("split")).filter("n > 1 OR split")
    pieces = materialise(sizes.select("grp", "piece", "n"), "hubs")
    weights = materialise(weights.join(pieces, ["grp", "piece"], "left_semi").select("grp", "piece", "shard", "w"), "edges")
    labels = _propagate(weights, pieces, total, shards, rounds)
    hubs = pieces.select("grp", "piece", F.lit(True).alias("linked"))
    if labels is None:
        hubs = hubs.withColumn("label", F.lit(None).cast("int"))
    else:
        hubs = hubs.join(labels.select("grp", "piece", "label"), ["grp", "piece"], "left")
    placed = nodes.join(hubs, ["grp", "piece"], "left").select(
        *base.columns,
        "piece",
        F.coalesce("linked", F.lit(False)).alias("linked"),
        F.coalesce("label", "start").alias("old"),
    )
    placed = placed.withColumn("bucket", F.when(F.col("linked"), BUCKETS + _draw(BUCKETS, F.col("grp"), F.col("piece"))).otherwise(_draw(BUCKETS, F.col("doc_id"), F.lit(7))))
    placed = materialise(placed, "placed")
    counts = {(r["old"], r["bucket"]): r["n"] for r in placed.groupBy("old", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 * BUCKETS * shards at most
    runs = spark.createDataFrame(_places(counts, total, shards), "old int, bucket int, first long, end long, shard int, slot0 long")
    rank = F.row_number().over(Window.partitionBy("old", "bucket").orderBy("grp", "piece", "doc_id")) - 1
    ranked = placed.withColumn("rank", rank).join(F.broadcast(runs), ["old", "bucket"])
    return ranked.filter("rank >= first AND rank < end").select(
        "doc_id", "size", "text_crc32", "grp", "linked", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = balanced_shards(table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
