"""Sharding by balanced label propagation.

Documents that belong together are members of a hub (equal texts, here; a document may have several),
so a group of n costs n rows and never n squared links. Each round counts every hub's members by
shard, lets each document propose its best shard, and accepts proposals under quotas: between two
shards as many may move one way as the other, and beyond that only what the target has room for. The
proposals with the largest gains go first; where a quota cuts through a level of gains, a seeded hash
draws. A document that a shard refused proposes its next best one in the round after, so a hub larger
than a shard fills whole shards in turn. Rounds end when few documents move. The capacity is the even share of all rows, so unlinked documents, placed last, fill every
shard to counts at most one apart (law ``rows``); what a shard cannot hold goes with them.

Only DataFrame operations: per-hub counts with partial aggregates, a table of at most
``n_shards**2 * 64`` flow levels, and global places from range-partitioned tables. The driver sees
``n_shards`` counts.

Nulls, ties, odd rows: a null text is empty (size 1, checksum 0); rows that repeat, or have null
ids, are documents of their own; a hub's tie between shards is broken by a hash of hub and round, alike
for all its members; with fewer rows than shards some shards are empty. An empty table gives an empty
result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onsetlab.llm.text import text_key, whole
from onsetlab.staging import drop_staged, staged, with_position

SHARDS = 8
#: Rounds at most; they end before where no more than a linked document in so many moves.
ROUNDS, STILL = 12, 500
#: A hub's vote for a shard is its members there, in units above the tie-breaking hash.
UNIT = 1 << 16


def _propose(members: DataFrame, state: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """row_id, shard, refused, target and gain: where each linked document would rather be, of shards that have not refused it."""
    placed = members.join(state, "row_id")
    counts = placed.groupBy("hub").agg(*[F.count_if(F.col("shard") == j).alias(f"c{j}") for j in range(n_shards)])
    votes = counts.select(
        "hub",
        *[(F.col(f"c{j}") * UNIT + F.pmod(F.xxhash64("hub", F.lit(j), F.lit(seed)), F.lit(UNIT))).alias(f"c{j}") for j in range(n_shards)],
    )
    sums = [F.sum(f"c{j}").alias(f"c{j}") for j in range(n_shards)]
    # Written first: a join of two plain shuffles can be split where a hub holds very many documents.
    votes = staged(votes, "shard-votes")
    scored = placed.join(votes, "hub").groupBy("row_id", "shard", "refused").agg(*sums, F.count("*").alias("hubs"))
    # A document counts itself once, not in each of its hubs.
    own_more = (F.col("hubs") - 1) * UNIT
    scored = scored.withColumns({f"c{j}": F.col(f"c{j}") - F.when(F.col("shard") == j, own_more).otherwise(0) for j in range(n_shards)})
    free = lambda j: F.when(F.col("refused").bitwiseAND(F.lit(1 << j).cast("long")) == 0, F.col(f"c{j}")).otherwise(-1)
    best = F.greatest(*[F.struct(free(j).alias("score"), F.lit(j).alias("target")) for j in range(n_shards)])
    own = F.element_at(F.array(*[F.col(f"c{j}") for j in range(n_shards)]), F.col("shard") + 1)
    scored = scored.withColumn("best", best)
    return scored.select(
        "row_id", "shard", "refused", F.col("best.target").alias("target"), (F.col("best.score") - own).alias("gain")
    )


def _accept(proposals: DataFrame, capacity: int, seed: int) -> DataFrame:
    """The state after the proposals that fit the quotas, with what moved; a move forgets earlier refusals."""
    level = F.floor(F.log2(F.col("gain"))).cast("int")
    moves = F.col("target") != F.col("shard")
    flow = proposals.filter(moves).groupBy("shard", "target", level.alias("level")).agg(F.count("*").alias("n"))
    held = proposals.groupBy(F.col("shard").alias("target")).agg(F.count("*").alias("held"))
    pairs = flow.groupBy("shard", "target").agg(F.sum("n").alias("m"))
    back = pairs.select(F.col("shard").alias("target"), F.col("target").alias("shard"), F.col("m").alias("back"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    more = F.col("m") - F.least("m", zero("back"))
    into = Window.partitionBy("target")
    room = F.greatest(F.lit(capacity) - zero("held"), F.lit(0))
    quota = F.least("m", zero("back")) + F.least(
        F.col("more"), F.floor(F.coalesce(F.try_divide(room * F.col("more"), F.sum("more").over(into)), F.lit(0)))
    )
    pairs = (
        pairs.join(back, ["shard", "target"], "left").join(held, "target", "left")
        .withColumn("more", more).withColumn("quota", quota).select("shard", "target", "quota")
    )
    first = Window.partitionBy("shard", "target").orderBy(F.desc("level"))
    before = F.sum("n").over(first) - F.col("n")
    share = (F.col("quota") - F.col("before")) / F.col("n")
    levels = flow.join(pairs, ["shard", "target"]).withColumn("before", before)
    levels = levels.select("shard", "target", "level", share.alias("share"))
    drawn = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    # At most n_shards**2 * 64 rows, whatever the data
    tried = proposals.withColumn("level", level).join(F.broadcast(levels), ["shard", "target", "level"], "left")
    goes = moves & (drawn < F.coalesce("share", F.lit(0.0)))
    also = F.col("refused").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("target")))
    refused = F.when(goes, F.lit(0).cast("long")).when(moves, also).otherwise(F.col("refused"))
    shard = F.when(goes, F.col("target")).otherwise(F.col("shard"))
    return tried.select("row_id", shard.alias("shard"), refused.alias("refused"), goes.alias("moved"))


def propagate(members: DataFrame, total: int, n_shards: int = SHARDS, rounds: int = ROUNDS, seed: int = 11) -> DataFrame:
    """row_id and shard of every linked document, from ``members`` (row_id, hub) and the number of all documents."""
    start = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(n_shards)).cast("int")
    if n_shards > 63:
        raise ValueError("at most 63 shards")  # refusals are bits of a long
    none = F.lit(0).cast("long")
    state = members.select("row_id").distinct().withColumns({"shard": start, "refused": none, "moved": F.lit(True)})
    state = staged(state, "shard-state")
    for k in range(rounds):
        placed = state.select("row_id", "shard", "refused")
        proposals = staged(_propose(members, placed, n_shards, seed + 1 + k), "shard-proposals")
        moved = staged(_accept(proposals, total // n_shards, seed + 1 + k), "shard-state")
        drop_staged(proposals)
        drop_staged(state)
        state = moved
        linked, moves = state.agg(F.count("*"), F.count_if("moved")).first()
        if moves * STILL <= linked:
            break
    return state.select("row_id", "shard")


def place(rows: DataFrame, state: DataFrame, total: int, n_shards: int = SHARDS) -> DataFrame:
    """Give every row of ``rows`` (row_id, text_key, ...) its shard and slot, counts at most one apart."""
    linked = rows.join(state, "row_id")
    at = with_position(linked, ["shard", "text_key", "row_id"], "at", "shard-linked")
    held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # n_shards rows
    quota = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    begin = [sum(held.get(i, 0) for i in range(j)) for j in range(n_shards)]
    kept = [min(held.get(j, 0), quota[j]) for j in range(n_shards)]
    free = [sum(quota[i] - kept[i] for i in range(j + 1)) for j in range(n_shards)]
    pick = lambda values, at: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), at)

    at = at.withColumn("slot", F.col("at") - pick(begin, F.col("shard") + 1)).drop("at")
    stays = F.col("slot") < pick(kept, F.col("shard") + 1)
    unlinked = rows.join(state, "row_id", "left_anti")
    rest = unlinked.unionByName(at.filter(~stays).drop("shard", "slot"))
    rest = with_position(rest, ["text_key", "row_id"], "at", "shard-rest")
    shard = sum(((F.col("at") >= F.lit(f).cast("long")).cast("int") for f in free), F.lit(0))
    rest = rest.withColumn("shard", shard)
    offset = [kept[j] - (free[j - 1] if j else 0) for j in range(n_shards)]
    rest = rest.withColumn("slot", F.col("at") + pick(offset, F.col("shard") + 1)).drop("at")
    return at.filter(stays).unionByName(rest)


def shards(docs: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, text_key, shard and slot; equal texts are linked."""
    rows = staged(
        docs.select(
            "doc_id",
            (F.octet_length(whole("text")) + 1).cast("long").alias("size"),
            F.crc32(whole("text").cast("binary")).alias("text_crc32"),
            text_key("text").alias("text_key"),
        ).withColumn("row_id", F.monotonically_increasing_id()),
        "shard-rows",
    )
    total = rows.count()
    hubs = rows.groupBy(F.col("text_key").alias("hub")).agg(F.count("*").alias("n")).filter("n > 1").select("hub")
    hubs = staged(hubs, "shard-hubs")
    members = staged(rows.select("row_id", F.col("text_key").alias("hub")).join(hubs, "hub"), "shard-members")
    return place(rows, propagate(members, total, n_shards, rounds), total, n_shards).drop("row_id")


def query(docs: DataFrame) -> DataFrame:
    return shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
