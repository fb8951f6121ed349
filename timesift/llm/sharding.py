"""Balanced label propagation of documents over shards. DataFrame functions only.

Documents with equal texts are linked. They start where their hash puts them; in each round the documents of a cut group
move to the shard that holds most of it, as far as that shard's quota has room, until nothing moves. Groups that have come together
stay, as far as their shard's even share holds them; what has not settled is placed group by group into the room left, and a group
larger than a shard in few parts. Documents without links then fill what room is left, so that shards end near equal in
bytes and few links are cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timesift.llm.common import bucket_count, cut_lineage, running_sum

SHARDS, OVERHEAD = 40, 16
BOULDER = 16
"""A document or group of more than 1/``BOULDER`` of a shard's even share is placed by itself; there are at most ``SHARDS * BOULDER``."""
SLACK = 1 / 256
"""A group stays whole where it exceeds a shard's even share by no more than this part of it."""
QUOTA, ROUNDS = 1 / 16, 12
"""How much more than its even share a shard may hold while documents move, and after how many rounds what has not settled is placed."""


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, g, u``: bytes of the text and 16 more, its checksum, its group and an even order number."""
    raw = F.col("text").cast("binary")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit("").cast("binary"))).cast("long").alias("text_crc32"),
        F.md5(raw).alias("g"), F.xxhash64(doc_id, F.md5(raw)).alias("u"))


def _bucket(n: int) -> Column:
    """Even buckets that rise with the order number ``u``."""
    return F.floor((F.col("u") / F.lit(float(1 << 64)) + F.lit(0.5)) * F.lit(n))


def fill(rows: DataFrame, room: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``shard``: consecutive stretches of ``u`` order, each as long as its shard's ``room(shard, room)``.

    Room is scaled so that all of it is used; a row goes where its middle lies.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    gaps = sorted((r["shard"], float(r["room"])) for r in room.collect())  # one row a shard
    placed = running_sum(rows.withColumn("one", F.lit(1)), ["one"], _bucket(n), [F.col("u"), F.col("doc_id")], {"before": F.col("size")})
    return placed.withColumn("shard", _stretch(gaps, total)).drop("one", "before")


def _stretch(gaps: list[tuple[int, float]], total: float) -> Column:
    """The shard in which the middle of ``size`` bytes after ``before`` lies, when ``gaps`` of (shard, room) share ``total`` bytes."""
    all_room = sum(g for _, g in gaps if g > 0)
    if all_room <= 0:
        gaps, all_room = [(s, 1.0) for s, _ in gaps], float(len(gaps))
    edges, shards, at = [], [], 0.0
    for s, g in gaps:
        if g > 0:
            at += g / all_room * total
            edges.append(at)
            shards.append(s)
    middle = F.col("before") + F.col("size") / 2
    shard = F.lit(shards[-1])
    for edge, s in reversed(list(zip(edges[:-1], shards[:-1], strict=True))):
        shard = F.when(middle < F.lit(edge), F.lit(s)).otherwise(shard)
    return shard.cast("int")


def lay(rows: DataFrame, groups: DataFrame, loads: DataFrame, mean: float, n: int) -> DataFrame:
    """``rows`` of few ``groups(g, size)`` with ``shard``: group after group, largest first, into the largest rooms, as few as hold them all."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    gaps, left = [], float(total)
    for s, room in sorted(((r["shard"], mean - r["load"]) for r in loads.collect()), key=lambda x: (-x[1], x[0])):  # one row a shard
        if left > 0 and room > 0:
            gaps.append((s, min(room, left)))
            left -= room
    before = Window.orderBy(F.col("size").desc(), "g").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("g", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    within = running_sum(rows, ["g"], _bucket(n), [F.col("u"), F.col("doc_id")], {"before": F.col("size")})
    placed = within.join(starts, "g").withColumn("before", F.col("before") + F.col("start"))
    return placed.withColumn("shard", _stretch(gaps or [(0, 1.0)], total)).drop("before", "start")


def place_boulders(rows: DataFrame, loads: DataFrame, names: Sequence[str], most: float | None = None) -> DataFrame:
    """``names, size, u, shard`` of ``rows``, few by their size, each to the shard with the least load so far, largest first: one fold over one array.

    ``shard`` is null for a row that would lift that load over ``most``.
    """
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("size", "u", *names)), asc=False).alias("r"))
    start = loads.agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "load"))), lambda x: x["load"]).alias("l"))

    def put(state: Column, row: Column) -> Column:
        least = F.array_min(state["l"])
        fits = F.lit(True) if most is None else least + row["size"] <= F.lit(most)
        s = F.when(fits, F.array_position(state["l"], least).cast("int") - 1)
        return F.struct(
            F.transform(state["l"], lambda v, i: v + F.when(i == s, row["size"]).otherwise(F.lit(0))).alias("l"),
            F.concat(state["s"], F.array(s)).alias("s"))

    first = F.struct(F.col("l").alias("l"), F.array().cast("array<int>").alias("s"))
    chosen = listed.withColumn("l", start.scalar()).withColumn("s", F.aggregate("r", first, put)["s"])
    flat = chosen.select(F.explode(F.arrays_zip("r", "s")).alias("x"))
    return flat.select(*[F.col(f"x.r.{c}").alias(c) for c in (*names, "size", "u")], F.col("x.s").alias("shard"))


def _loads(names: DataFrame, *placed: DataFrame) -> DataFrame:
    """``shard, load`` of each shard of ``names``: the bytes of all ``placed(shard, size)``."""
    parts = [p.groupBy("shard").agg(F.sum("size").alias("load")) for p in placed]
    both = names.select("shard", F.lit(0).cast("long").alias("load"))
    for p in parts:
        both = both.unionByName(p.filter("shard IS NOT NULL"))
    return cut_lineage(both.groupBy("shard").agg(F.sum("load").alias("load")), 1)


def fill_room(rows: DataFrame, names: DataFrame, mean: float, n: int, *placed: DataFrame) -> DataFrame:
    """``rows`` with ``shard``, into the room that ``placed`` leaves: the coarser first, so that the finer even out what they miss."""
    def room(*there: DataFrame) -> DataFrame:
        return _loads(names, *there).select("shard", F.greatest(F.lit(0.0), F.lit(mean) - F.col("load")).alias("room"))
    fine = F.col("size") <= F.lit(mean / BOULDER ** 2)
    coarse = cut_lineage(fill(rows.filter(~fine), room(*placed), n))
    return coarse.unionByName(fill(rows.filter(fine), room(*placed, coarse), n))


def cut_giants(linked: DataFrame, groups: DataFrame, names: DataFrame, mean: float, n: int) -> DataFrame:
    """Rows of groups larger than a shard, with ``shard``: in as few parts as they need."""
    giants = groups.filter(F.col("size") > mean * (1 + SLACK))
    return cut_lineage(lay(linked.join(giants.select("g"), "g", "left_semi"), giants, _loads(names), mean, n))


def settled_groups(moved: DataFrame, names: DataFrame, mean: float, n: int, *placed: DataFrame) -> DataFrame:
    """``g, shard, size`` of the groups that lie whole in one shard, as many as its even share holds beside ``placed``."""
    parts = moved.groupBy("g", "shard").agg(F.sum("size").alias("size"))
    homes = parts.groupBy("g").agg(F.first("shard").alias("shard"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts")).filter(
        "parts = 1").select("g", "shard", "size").withColumn("u", F.xxhash64("g"))
    homes = cut_lineage(homes)
    ordered = running_sum(homes, ["shard"], _bucket(n), [F.col("u"), F.col("g")], {"before": F.col("size")})
    room = _loads(names, *placed).select("shard", (F.lit(mean * (1 + SLACK)) - F.col("load")).alias("room"))
    return cut_lineage(ordered.join(room, "shard").filter(F.col("before") + F.col("size") <= F.col("room")).select("g", "shard", "size"))


def place_groups(linked: DataFrame, groups: DataFrame, names: DataFrame, mean: float, n: int, *before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``linked`` with ``shard``, beside what lies there ``before``: (those of groups that lie whole in one shard, those of cut groups).

    Large groups are placed largest first while they fit, and cut where no shard has room for them. Small
    ones then fill the room in stretches of whole groups.
    """
    n_rows = groups.count()
    large = groups.filter(F.col("size") > mean / BOULDER).withColumn("u", F.xxhash64("g"))
    small = groups.filter(F.col("size") <= mean / BOULDER).withColumn("u", F.xxhash64("g")).withColumn("doc_id", F.lit(0))
    placed = cut_lineage(place_boulders(large, _loads(names, *before), ["g"], mean * (1 + SLACK)), SHARDS)
    rest = placed.filter("shard IS NULL").select("g", "size")
    cut = linked.limit(0).withColumn("shard", F.lit(0))
    if not rest.isEmpty():
        cut = cut_lineage(lay(linked.join(rest.select("g"), "g", "left_semi"), rest, _loads(names, placed, *before), mean, n).select(*cut.columns))
    filled = fill_room(small, names, mean, n, cut, placed, *before)
    homes = cut_lineage(placed.filter("shard IS NOT NULL").select("g", "shard").unionByName(filled.select("g", "shard")), n_rows)
    return linked.join(homes, "g"), cut


def propagate(linked: DataFrame, others: DataFrame, shards: int, mean: float, rounds: int | None = None) -> DataFrame:
    """Moves of ``linked(doc_id, size, text_crc32, g, u, shard)`` towards the shard that holds most of their group.

    A round: bytes by (group, shard), added before the shuffle; each group's heaviest shard that has room;
    movers in ``u`` order while the sum of their sizes fits the target's room, beside the loads of ``others``.
    Who does not fit stays and tries again. Rows move to larger parts only, so the rounds end; they do when nothing moves, or after ``rounds``.
    """
    keep = ["doc_id", "size", "text_crc32", "g", "u", "shard"]
    n_rows = linked.count()
    n = bucket_count(n_rows)
    names = linked.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    while n_rows and rounds != 0:
        rounds = None if rounds is None else rounds - 1
        held = cut_lineage(linked.groupBy("g", "shard").agg(F.sum("size").alias("held")), n_rows)
        loads = _loads(names, held.select("shard", F.col("held").alias("size")), others.select("shard", F.col("load").alias("size")))
        room = cut_lineage(loads.select("shard", (F.lit(mean) - F.col("load")).alias("room")), shards)
        # The heaviest shard of a group is its home while it has room or nothing comes to it.
        best = held.join(room, "shard").groupBy("g").agg(
            F.max_by("shard", F.struct("held", F.hash("g", "shard"))).alias("top"),
            F.max_by("shard", F.when(F.col("room") > 0, F.struct("held", F.hash("g", "shard")))).alias("open"),
            F.max_by("room", F.struct("held", F.hash("g", "shard"))).alias("top_room"), F.count(F.lit(1)).alias("spread"))
        wish = cut_lineage(best.filter("spread > 1").select("g", F.when(F.col("top_room") > 0, F.col("top")).otherwise(F.col("open")).alias("to"),
                                                            F.col("top").alias("top")).filter("`to` IS NOT NULL"), n_rows)
        # Who already lies in the group's heaviest shard stays, and so does who would move to a smaller part.
        part = held.select("g", F.col("shard").alias("to"), F.struct("held", F.hash("g", "shard")).alias("goal"))
        ways = held.join(wish, "g").join(part, ["g", "to"]).filter("shard != `to` AND shard != top").filter(
            F.struct("held", F.hash("g", "shard")) < F.col("goal")).select("g", "shard", "to")
        wished = linked.join(cut_lineage(ways, n_rows), ["g", "shard"], "left")
        movers = wished.filter("`to` IS NOT NULL")
        placed = running_sum(movers, ["to"], _bucket(n), [F.col("u"), F.col("doc_id")], {"before": F.col("size")})
        moved = placed.join(room.toDF("to", "room"), "to").withColumn("fits", F.col("before") + F.col("size") <= F.col("room"))
        moved = cut_lineage(moved.select("fits", *keep, "to"), n_rows)
        if moved.filter("fits").isEmpty():
            break
        stays = wished.filter("`to` IS NULL").select(*keep)
        linked = cut_lineage(stays.unionByName(moved.withColumn("shard", F.when(F.col("fits"), F.col("to")).otherwise(F.col("shard"))).select(*keep)), n_rows)
    return linked


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row of ``docs(doc_id, text)``.

    The law is ``bytes``: shards end near equal in bytes, as near as whole documents allow. Null texts have
    size 16, the checksum of no bytes, and no links; empty texts are equal texts. A group larger than a shard
    is cut into as few parts as room allows, and so is one that no shard has room for; all others stay whole. Repeated rows are equal texts. Slots count from 0 in each shard. An empty
    table returns none. Very long texts count with their bytes; only the two named columns are read, whatever others are called.
    """
    rows = cut_lineage(measured(docs))
    n_rows, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    mean, n = (total or 0) / shards, bucket_count(n_rows)
    names = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    grouped = rows.filter("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    groups = cut_lineage(grouped.filter("n > 1").select("g", "size"), n_rows)
    keep = ["doc_id", "size", "text_crc32", "u", "shard"]
    linked = cut_lineage(rows.join(groups.select("g"), "g", "left_semi"), n_rows)
    giants = cut_giants(linked, groups, names, mean, n)
    movable = groups.filter(F.col("size") <= mean * (1 + SLACK))
    started = cut_lineage(linked.join(movable.select("g"), "g", "left_semi").withColumn("shard", _bucket(shards).cast("int")), n_rows)
    settled = settled_groups(propagate(started, _loads(names, giants), shards, mean * (1 + QUOTA), ROUNDS), names, mean, n, giants)
    there = cut_lineage(linked.join(settled.select("g", "shard"), "g").select(*keep), n_rows)
    rest = cut_lineage(movable.join(settled.select("g"), "g", "left_anti"), n_rows)
    whole, cut = place_groups(linked.join(rest.select("g"), "g", "left_semi"), rest, names, mean, n, giants, there)
    whole = cut_lineage(whole.select(*keep).unionByName(there), n_rows)
    cut = cut.select("g", *keep).unionByName(giants.select("g", *keep))
    moved = propagate(cut_lineage(cut, n_rows), _loads(names, whole), shards, mean)
    linked = cut_lineage(whole.unionByName(moved.select(*keep)), n_rows)
    alone = cut_lineage(rows.filter("g IS NULL").unionByName(rows.join(groups.select("g"), "g", "left_anti").filter("g IS NOT NULL")).drop("g"), n_rows)
    heavy = F.col("size") > F.lit(mean / BOULDER)
    boulders = cut_lineage(place_boulders(alone.filter(heavy), _loads(names, linked), ["doc_id", "text_crc32"]).select(*keep), shards)
    small = fill_room(alone.filter(~heavy), names, mean, n, linked, boulders).select(*keep)
    placed = cut_lineage(linked.unionByName(boulders).unionByName(small), n_rows)
    slotted = running_sum(placed, ["shard"], _bucket(max(1, n // 16)), [F.col("u"), F.col("doc_id")], {"slot": F.lit(1).cast("long")})
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                          F.lit(None).cast("int").alias("grown_shard"))


def cut_links(sharded: DataFrame, docs: DataFrame) -> DataFrame:
    """``groups, whole``: how many groups of equal texts there are, and how many lie in one shard."""
    g = docs.filter("text IS NOT NULL").select(F.col("doc_id"), F.md5(F.col("text").cast("binary")).alias("g"))
    per = sharded.select("doc_id", "shard").join(g, "doc_id").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shard").alias("s"))
    return per.filter("n > 1").agg(F.count(F.lit(1)).alias("groups"), F.sum((F.col("s") == 1).cast("long")).alias("whole"))
