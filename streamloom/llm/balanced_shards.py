"""Sharding by balanced label propagation: linked documents (equal texts) move together, sizes stay even.

Documents start in shards by rank in a hashed order, so the numbers of rows differ by one at most. In every round each
group of linked documents counts its members by shard; members outside the group's largest shards, as many as it fills,
want to move there. Quotas come from a shards x shards table: rings of wishes are exchanged, and a shard takes in as many
as leave it or can be given back: documents without links, or single members of other groups that are not at their goal.
Those go where documents left. Every round keeps the sizes; cut links only become fewer. Rounds go on until nobody
has moved in several of them with different goals.

Defined results: null text has no bytes (size 16, crc32 0) and equals empty text; repeated rows are rows of their own,
linked by their text; an empty table gives an empty result. Law `rows`: counts differ by one at most; `grown_shard` is
null. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from streamloom.llm.common import ranked, shuffled_order, stored

SHARDS = 40
#: Rounds without a move, each with other goals among equal parts, before the rest counts as unmovable.
IDLE = 4


def _pick(index: Column, values: list[int]) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), index)


def _table(rows: list, shards: int) -> list[int]:
    out = [0] * shards
    for r in rows:
        out[r["shard"]] = r["n"]
    return out


def _cycle(left: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Wishes that form a ring of shards, or none."""
    goes: dict[int, list[int]] = {}
    for (a, b), n in sorted(left.items()):
        if n:
            goes.setdefault(a, []).append(b)
    while any(b not in goes for to in goes.values() for b in to):
        goes = {a: kept for a, to in goes.items() if (kept := [b for b in to if b in goes])}
    path = [min(goes)] if goes else []
    while path:
        if (after := goes[path[-1]][0]) in path:
            ring = path[path.index(after) :]
            return list(zip(ring, [*ring[1:], after], strict=True))
        path.append(after)
    return []


def _quotas(wants: dict[tuple[int, int], int], spare: list[int], single: list[int]) -> dict[tuple[int, int], int]:
    """How many may go from shard to shard: rings of wishes first, then whatever finds room at its goal. A shard has room
    for those that leave it, its unlinked documents, and its single members that want to leave but may not."""
    left, quota = dict(wants), dict.fromkeys(wants, 0)
    into, out = [0] * len(spare), [0] * len(spare)

    def take(edges: list, n: int) -> int:
        for a, b in edges:
            left[a, b] -= n
            quota[a, b] += n
            out[a] += n
            into[b] += n
        return n

    while ring := _cycle(left):
        take(ring, min(left[e] for e in ring))
    moved = 1
    while moved:
        moved = 0
        for e in sorted(left, key=lambda e: (-left[e], e)):
            b = e[1]
            moved += take([e], min(left[e], spare[b] + max(out[b], single[b]) - into[b]))
    return quota


def _round(state: DataFrame, shards: int, rows: int, turn: int, closed: set[int]) -> tuple[DataFrame | None, set[int]]:
    """The next state, or None when nobody can move, and the shards that were wanted. Rows (node, group, shard, order);
    group is null without links. Half of the groups, by turn, take no goal from `closed`."""
    loose = state.where("group IS NULL")
    spare = _table(loose.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect(), shards)  # a number a shard
    votes = state.where("group IS NOT NULL").groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    # A group has at most one row a shard here. Its goals are its largest parts, as many as it fills.
    whole = Window.partitionBy("group")
    largest = whole.orderBy("closed", F.desc("n"), "tie", "shard")
    each = max(1, rows // shards)
    votes = votes.withColumn("closed", F.col("shard").isin(sorted(closed)) & (F.pmod(F.xxhash64("group", F.lit(turn)), F.lit(2)) == 0) if closed else F.lit(False))
    votes = votes.withColumn("tie", F.xxhash64("group", "shard", F.lit(turn)))
    is_goal = ~F.col("closed") & (F.row_number().over(largest) <= F.ceil(F.sum("n").over(whole) / each))
    votes = votes.withColumn("goal", is_goal)
    room = F.when(F.col("goal"), F.greatest(F.lit(each) - F.col("n"), F.lit(1)))
    votes = votes.withColumn("stop", F.sum(room).over(largest.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    votes = votes.withColumn("weakest", F.min(F.when(F.col("goal"), F.col("n"))).over(whole)).withColumn(
        "goals", F.sort_array(F.collect_list(F.when(F.col("goal"), F.struct("stop", "shard"))).over(whole))
    )
    # Members of smaller parts want to join the goals, dealt by the room the group has there.
    wanting = votes.where(~F.col("goal") & (F.col("n") <= F.col("weakest"))).select("group", "shard", F.col("n").alias("part"), "goals")
    dealt = F.pmod(F.xxhash64("node", F.lit(turn)), F.element_at("goals", -1)["stop"])
    wished = state.join(wanting, ["group", "shard"]).withColumn("dealt", dealt)
    to = F.get(F.filter("goals", lambda g: g["stop"] > F.col("dealt")), 0)["shard"]
    movers = stored(wished.select("node", "order", "shard", to.alias("to"), (F.col("part") == 1).alias("single")), "shards-movers")
    wishes = movers.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n"), F.count_if("single").alias("s")).collect()  # shards x shards numbers
    single = [sum(r["s"] for r in wishes if r["shard"] == i) for i in range(shards)]
    quota = _quotas({(r["shard"], r["to"]): r["n"] for r in wishes}, spare, single)
    wanted = {b for _, b in quota}
    if not sum(quota.values()):
        return None, wanted
    gain = [0] * shards
    for (a, b), n in quota.items():
        gain[a] -= n
        gain[b] += n
    allowed = _pick(F.col("shard") * shards + F.col("to"), [quota.get((a, b), 0) for a in range(shards) for b in range(shards)])
    count = sum(r["n"] for r in wishes)
    moved = ranked(movers, ["shard", "to"], "order", ["node"], rank="place", rows=count).where(F.col("place") < allowed)
    moved = stored(moved.select("node", "to"), "shards-moved")
    # Documents without links, then single members that stayed, leave the shards that gained, in order, for those that lost.
    gives = [max(0, g) for g in gain]
    takes = [max(0, -g) for g in gain]
    begins = [sum(gives[:i]) for i in range(shards)]
    stops = F.array(*[F.lit(sum(takes[: i + 1])).cast("long") for i in range(shards)])
    half = F.shiftright("order", 1)
    stayed = movers.where("single").join(moved, "node", "left_anti").select("node", "shard", (half + F.lit(1 << 59)).alias("order"))
    fillers = loose.select("node", "shard", half.alias("order")).unionByName(stayed)
    seats = ranked(fillers, ["shard"], "order", ["node"], rank="place", rows=max(1, sum(spare) + sum(single)))
    given = seats.where(F.col("place") < _pick(F.col("shard"), gives)).select(
        "node", F.size(F.filter(stops, lambda x: x <= _pick(F.col("shard"), begins) + F.col("place"))).cast("int").alias("to")
    )
    changes = moved.unionByName(given)
    return state.join(changes, "node", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), wanted


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row. Every round with moves gathers groups further, so rounds end."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(
        F.col("doc_id").cast("long"),
        (F.length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("key"),
    ).withColumn("order", shuffled_order(F.col("doc_id"), F.hex("key")))
    slim = stored(slim, "shards-docs")
    rows = slim.count()
    nodes = stored(ranked(slim, [], "order", ["doc_id", "key"], rank="node", rows=rows), "shards-nodes")
    linked = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key", F.col("key").alias("group"))
    state = nodes.select("node", "key", "order", (F.col("node") % shards).cast("int").alias("shard")).join(linked, "key", "left").drop("key")
    state = stored(state, "shards-state")
    turn, idle, closed = 0, 0, set()
    while idle < IDLE:
        after, wanted = _round(state, shards, rows, turn, closed)
        turn += 1
        if after is not None:
            state, idle, closed = stored(after, "shards-state"), 0, set()
        elif wanted or closed:
            idle, closed = idle + 1, wanted  # no room there: some groups try their other shards
        else:
            break
    placed = ranked(state.drop("group"), ["shard"], "order", ["node"], rank="slot", rows=rows)
    return nodes.drop("order").join(placed.select("node", "shard", "slot"), "node").select("doc_id", "size", "text_crc32", "shard", "slot")


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    return assigned(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
