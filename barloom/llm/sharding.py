"""Consistent-hash sharding with virtual nodes and bounded loads (operator 3), in DataFrame functions only.

Keys and the virtual nodes of the shards lie on one ring; a key's home is the
next virtual node clockwise. A shard takes as many rows as the law ``rows``
gives it (counts at most one apart, together all rows); the keys of a full shard
continue clockwise to the next virtual nodes with room. Who continues where
follows from row counts of the ring's arcs alone: a table whose size is set by
``shards``, ``replicas`` and ``CELLS`` and not by the data. On it, overflow and
room are two divisions of one line, so the flow around the ring is a running sum
started where it is lowest, and each key finds its place by its number in its arc.

Cases: a null text has size 16 and the checksum of no bytes; a null id is a key
like any other; equal rows are told apart by a copy number, so they spread over
the ring too; an empty table gives an empty result; other columns are not read.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import written

#: Cells that the ring is cut into to number the keys of an arc in parallel; rows of equal copies made at once.
CELLS, COPIES = 4096, 1 << 16


def _position(*key) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 32)


def virtual_nodes(spark, shards: int, replicas: int) -> DataFrame:
    """(node, shard, replica, at): node counts clockwise."""
    ring = spark.range(shards * replicas).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("replica"))
    ring = ring.withColumn("at", _position(F.lit("node"), "shard", "replica"))
    return ring.select((F.row_number().over(W.orderBy("at", "shard", "replica")) - 1).cast("int").alias("node"), "shard", "replica", "at")


def _homes(nodes: DataFrame, spark) -> DataFrame:
    """For each cell the nodes in it, clockwise, and then the first one after it."""
    inside = nodes.groupBy(F.floor(F.col("at") / (2**32 // CELLS)).cast("int").alias("cell")).agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("nodes"))
    cells = spark.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(F.broadcast(inside), "cell", "left")
    later = F.first(F.when(F.col("nodes").isNotNull(), F.col("nodes")[0]["node"]), ignorenulls=True).over(W.orderBy("cell").rowsBetween(1, W.unboundedFollowing))
    return cells.select("cell", F.coalesce("nodes", F.array().cast("array<struct<at:bigint,node:int>>")).alias("nodes"), F.coalesce(later, F.lit(0)).alias("later"))


def keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, copy) of each row of docs; copy tells equal rows apart."""
    raw = F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")
    each = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    counted = each.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    last = F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1
    return blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, last))).select("id", "size", "text_crc32", "copy")


def plan(arcs: DataFrame, nodes: DataFrame, shards: int, replicas: int) -> DataFrame:
    """For each node, which of its keys (by their number in the arc) go to which shard, and from which slot on.

    arcs: (node, n), the rows whose home a node is.
    """
    ring = nodes.join(F.broadcast(arcs), "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of_shard = W.partitionBy("shard")
    total = F.sum("n").over(W.partitionBy())
    room = F.floor(total / shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    ring = ring.withColumn("room", room).withColumn("before", F.coalesce(F.sum("n").over(of_shard.orderBy("node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ring = ring.withColumn("home", F.greatest(F.lit(0), F.least("n", F.col("room") - F.col("before"))))
    spare = F.greatest(F.lit(0), F.col("room") - F.sum("n").over(of_shard))
    ring = ring.withColumn("excess", F.col("n") - F.col("home"))
    ring = ring.withColumn("spare", F.floor(spare / replicas) + F.when(F.row_number().over(of_shard.orderBy("node")) <= spare % replicas, 1).otherwise(0))
    ring = ring.withColumn("level", F.sum(F.col("excess") - F.col("spare")).over(W.orderBy("node")))
    lowest = F.min(F.struct("level", "node")).over(W.partitionBy())["node"]
    ring = ring.withColumn("turn", F.pmod(F.col("node") - lowest - 1, F.lit(shards * replicas)))
    start = lambda what: F.coalesce(F.sum(what).over(W.orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ring = ring.withColumn("excess_from", start("excess")).withColumn("spare_from", start("spare"))
    from_node = ring.where("excess > 0").select(F.col("excess_from").alias("cut"), F.struct("node", (F.col("home") - F.col("excess_from")).alias("shift")).alias("source"), F.lit(None).cast("int").alias("shard"))
    to_node = ring.where("spare > 0").select(F.col("spare_from").alias("cut"), F.lit(None).cast("struct<node:int,shift:bigint>").alias("source"), "shard")
    along = W.orderBy("cut").rangeBetween(W.unboundedPreceding, 0)
    # a node's overflow and a shard's room can begin at one cut; both then hold from there
    pieces = from_node.unionByName(to_node)
    pieces = pieces.select("cut", F.last("source", True).over(along).alias("source"), F.last("shard", True).over(along).alias("shard")).distinct()
    pieces = pieces.withColumn("to", F.lead("cut").over(W.orderBy("cut")))
    end = ring.agg(F.sum("excess").alias("end"))
    pieces = pieces.join(F.broadcast(end), F.lit(True)).select(F.col("source.node").alias("node"), (F.col("cut") + F.col("source.shift")).alias("from"), (F.coalesce("to", "end") + F.col("source.shift")).alias("to"), "shard", F.lit(1).alias("kind"), "cut")
    stay = ring.where("home > 0").select("node", F.lit(0).cast("long").alias("from"), F.col("home").alias("to"), "shard", F.lit(0).alias("kind"), F.col("turn").cast("long").alias("cut"))
    parts = stay.unionByName(pieces)
    slot = F.coalesce(F.sum(F.col("to") - F.col("from")).over(of_shard.orderBy("kind", "cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("slot", slot).groupBy("node").agg(F.collect_list(F.struct("from", "to", "shard", "slot")).alias("parts"))


def assign(docs: DataFrame, shards: int = 40, replicas: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs."""
    spark = docs.sparkSession
    nodes = written(virtual_nodes(spark, shards, replicas))
    key = keys(docs, id_col, text_col).withColumn("at", _position(F.lit("key"), "id", "size", "text_crc32", "copy"))
    key = key.withColumn("cell", F.floor(F.col("at") / (2**32 // CELLS)).cast("int"))
    key = key.join(F.broadcast(written(_homes(nodes, spark))), "cell")
    ahead = F.filter("nodes", lambda x: x["at"] >= F.col("at"))
    key = key.withColumn("node", F.coalesce(F.get(ahead, F.lit(0))["node"], "later")).drop("nodes", "later")
    number = F.row_number().over(W.partitionBy("cell", "node").orderBy("at", "id", "size", "text_crc32", "copy"))
    key = written(key.withColumn("number", number - 1))
    # cell 0 also holds the keys before the first node: an arc may wrap, its cells are taken in order all the same
    arcs = written(key.groupBy("node", "cell").agg(F.count("*").alias("n")))
    first = arcs.select("node", "cell", F.coalesce(F.sum("n").over(W.partitionBy("node").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    places = written(plan(arcs.groupBy("node").agg(F.sum("n").alias("n")), nodes, shards, replicas))
    key = key.join(F.broadcast(first), ["node", "cell"]).join(F.broadcast(places), "node")
    key = key.withColumn("i", F.col("number") + F.col("offset"))
    part = F.filter("parts", lambda x: (x["from"] <= F.col("i")) & (F.col("i") < x["to"]))[0]
    key = key.withColumn("part", part)
    slot = F.col("part.slot") + F.col("i") - F.col("part.from")
    return key.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("part.shard").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
