"""Operator 4: balanced label propagation of linked documents over shards (DataFrame functions only)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.common import dense_rank_slots, discard, hot_join, hot_keys, materialize, read_table


def _by_number(number: Column, values: list[int]) -> Column:
    """values[number] for a short list."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), number.cast("int") + 1)


def _shard_sizes(state: DataFrame, n_shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("weight").alias("n")).collect()}  # n_shards rows
    return [found.get(s, 0) for s in range(n_shards)]


def propagate(members: DataFrame, start: DataFrame, n_shards: int, total: int, rounds: int | None = None, slack: float = 0.25, buckets: int = 1024) -> DataFrame:
    """Move nodes towards the shards of the nodes that they share groups with: (node, shard).

    members(node, group) are the links: nodes of one group are neighbours; start(node, shard,
    weight) is any placement of nodes that stand for `weight` rows each; `total` is the number
    of all rows, those without links included, which make way later. A round sums each group's weights by
    shard, lets every node wish for the shard that holds most of its neighbours among those with
    room, and admits the wishes of the largest gain while the shard stays under its quota: the mean size of a shard or, where
    most rows are linked, (1 + slack) times the mean number of linked rows. Admission goes by buckets of hashed nodes under a running
    sum, so it needs one row a bucket.

    A node's own shard is counted with the node itself, and between equal shards a hash of group
    and shard decides (a shard without room loses), so all nodes of a group go one way: two
    halves never change places. Where every node is in one group, a round raises the sum of the
    squared counts of groups by shard, so the default, rounds until no node moves, ends. Links
    through several groups a node may go in circles: give `rounds` for these. A group of many
    rows meets in few nodes where rows that start together are one node.
    """
    linked = start.agg(F.sum("weight")).first()[0] or 0
    quota = max(1, int(max(total, linked * (1 + slack)) / n_shards))
    state, owned = start, None
    for k in itertools.count() if rounds is None else range(rounds):
        sizes = _shard_sizes(state, n_shards)
        room = [max(0, quota - s) for s in sizes]
        if not any(room):
            break
        placed = members.join(state, "node")
        tally = placed.groupBy("group", "shard").agg(F.sum("weight").alias("n")).select("group", F.col("shard").alias("to"), "n")
        options = placed.join(tally, "group").groupBy("node", "weight", "shard", "to").agg(F.sum("n").alias("n"), F.min(F.xxhash64("group", "to")).alias("order"))
        other = F.col("to") != F.col("shard")
        fits = F.col("weight") <= _by_number(F.col("to"), room)
        best = options.groupBy("node", "weight", "shard").agg(
            F.max(F.when(~other, F.struct("n", "order"))).alias("own"), F.max(F.when(other & fits, F.struct("n", "order", "to"))).alias("best")
        )
        gain = F.col("best.n") - F.col("own.n")
        tie = (gain == 0) & ((F.col("best.order") > F.col("own.order")) | (_by_number(F.col("shard"), room) == 0))
        wish = best.where(F.col("best").isNotNull() & ((gain > 0) | tie)).select(
            "node", "weight", F.col("best.to").alias("to"),
            (F.floor(F.log2(gain + 1)) * -buckets + F.pmod(F.xxhash64("node", F.lit(k)), F.lit(buckets))).cast("long").alias("turn"),
        )
        wish = materialize(wish, "wishes")
        in_turn = Window.partitionBy("to").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
        admitted = wish.groupBy("to", "turn").agg(F.sum("weight").alias("n")).withColumn("upto", F.sum("n").over(in_turn))
        admitted = admitted.where(F.col("upto") <= _by_number(F.col("to"), room)).select("to", "turn")
        moves = wish.join(admitted, ["to", "turn"]).select("node", "to")
        new = state.join(moves, "node", "left").select("node", F.coalesce("to", "shard").alias("shard"), "weight", F.col("to").isNotNull().alias("moved"))
        new = materialize(new, "placement")
        moved = new.where("moved").count()
        discard(wish)
        if owned is not None:
            discard(owned)
        owned, state = new, new.select("node", "shard", "weight")
        if not moved:
            break
    return state.select("node", "shard")


def assign_shards(docs: DataFrame, n_shards: int = 8, rounds: int | None = None) -> DataFrame:
    """Put docs(doc_id, text) into shards whose row counts differ by one at most, keeping equal texts together.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('rows'), shard, slot (gapless
    from 0 in each shard), grown_shard (null), n_links (rows of the same text, itself
    excluded). The rows of a text that start in one shard are one node of the propagation, so
    a text of very many rows is n_shards nodes. Rows over a shard's exact target then move to
    shards under theirs: unlinked rows first, then whole stretches of texts. A group larger than
    a shard is spread over several. Where a row goes depends on doc_id and text only. Null texts
    have size 1, crc 0 and no links; texts of any length are only hashed; null and repeated
    doc_ids and repeated rows are placed as rows of their own; other columns are not read; an
    empty table gives no rows.
    """
    raw = F.encode("text", "UTF-8")
    rows = docs.select("doc_id", "text").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"), F.md5(raw).alias("group"),
    )
    start = F.pmod(F.xxhash64("doc_id", F.coalesce("group", F.lit(""))), F.lit(n_shards)).cast("int")
    rows = materialize(rows.withColumn("start", start), "rows")
    total = rows.count()
    classes = rows.groupBy("group", "start").agg(F.count(F.lit(1)).alias("weight"))
    linked = classes.where(F.col("group").isNotNull()).groupBy("group").agg(F.sum("weight").alias("n")).where("n > 1")
    nodes = classes.join(linked, "group").select(F.concat_ws("/", "group", "start").alias("node"), "group", "start", "weight", "n")
    nodes = materialize(nodes, "nodes")
    hot = hot_keys(rows, "group")
    state = propagate(nodes.select("node", "group"), nodes.select("node", F.col("start").alias("shard"), "weight"), n_shards, total, rounds)
    final = nodes.join(state, "node").select("group", "start", "shard", (F.col("n") - 1).alias("n_links"))
    placed = hot_join(rows, final, ["group", "start"], "group", hot, "left")
    placed = placed.withColumn("shard", F.coalesce("shard", "start")).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    placed = materialize(placed.drop("start"), "placed")

    # exact sizes: rows ranked past a shard's target fill the places that other shards lack
    loose = (F.col("n_links") == 0).cast("int")
    counts = {(r["shard"], r["loose"]): r["n"] for r in placed.groupBy("shard", loose.alias("loose")).agg(F.count(F.lit(1)).alias("n")).collect()}
    firm = [counts.get((s, 0), 0) for s in range(n_shards)]
    held = [firm[s] + counts.get((s, 1), 0) for s in range(n_shards)]
    target = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    over = [max(0, held[s] - target[s]) for s in range(n_shards)]
    under = [max(0, target[s] - held[s]) for s in range(n_shards)]
    over_before = [sum(over[:s]) for s in range(n_shards)]
    under_before = [sum(under[:s]) for s in range(n_shards)]
    # numbered by text and then doc_id; a text of very many rows has hashes all over, every other text one
    spread = F.when(F.col("group").isin(hot), F.xxhash64("doc_id", "group")).otherwise(F.xxhash64("group"))
    place_of = F.when(loose == 1, F.xxhash64("doc_id", "text_crc32")).otherwise(spread)
    ranked = dense_rank_slots(
        placed.withColumn("loose", loose).withColumn("place_of", place_of), ["shard", "loose"], ["place_of", "group", "doc_id", "text_crc32"], "rank", total=total, by="place_of"
    )
    rank = F.col("rank") + F.when(F.col("loose") == 1, _by_number(F.col("shard"), firm)).otherwise(F.lit(0))
    ranked = ranked.withColumn("rank", rank)
    spill = F.col("rank") >= _by_number(F.col("shard"), target)
    place = _by_number(F.col("shard"), over_before) + F.col("rank") - _by_number(F.col("shard"), target)
    to, slot = F.col("shard"), F.col("rank")
    for s in range(n_shards):
        here = spill & (F.col("place") >= under_before[s]) & (F.col("place") < under_before[s] + under[s])
        to = F.when(here, F.lit(s)).otherwise(to)
        slot = F.when(here, F.lit(held[s]) + F.col("place") - under_before[s]).otherwise(slot)
    return ranked.withColumn("place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), to.cast("int").alias("shard"), slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "n_links",
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of equal row counts, equal texts together."""
    return assign_shards(read_table(spark, sf_dir, "documents"), 8)
