"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.llm.common import shared_dir, utf8, written

CELL_BITS = 14  # the ring's equal cells, in which a key looks up its virtual node


def ring_arcs(spark: SparkSession, shards: int, virtual: int) -> DataFrame:
    """(arc, shard, low, high): the keys in (low, high] belong to the virtual node at high; the last wraps around.

    Has shards x virtual + 1 rows, whatever the data.
    """
    nodes = spark.range(shards * virtual).select((F.col("id") % shards).cast("int").alias("shard"), F.xxhash64(F.lit("node"), (F.col("id") % shards), F.floor(F.col("id") / shards)).alias("high"))
    low = F.lag("high").over(Window.orderBy("high", "shard"))
    first = nodes.agg(F.min(F.struct("high", "shard")).getField("shard").alias("shard"), F.max("high").alias("low"))
    most = F.lit((1 << 63) - 1)
    return (
        nodes.withColumn("low", low)
        .select("shard", "low", "high")
        .union(first.select("shard", "low", most))
        .select((F.row_number().over(Window.orderBy("high", "shard")) - 1).cast("int").alias("arc"), "shard", "low", "high")
    )


def _pieces(arcs: DataFrame) -> DataFrame:
    """(cell, arc, low, high): the parts of the arcs in each cell of the ring."""
    shift = 64 - CELL_BITS
    first = F.when(F.col("low").isNull(), F.lit(-(1 << (CELL_BITS - 1)))).otherwise(F.shiftright("low", shift)).cast("int")
    return arcs.select("arc", "low", "high", F.explode(F.sequence(first, F.shiftright("high", shift).cast("int"))).alias("cell"))


def _place(arcs: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """(arc, shard, from_rank, n, slot): which ranks of an arc go to which shard, and their first slot there.

    Every shard takes its own arcs' keys in ring order until it is full. What is left goes on clockwise, arc by arc in
    ring order, to the next shards with room. All tables here have a row an arc; the fold runs over those that overflow.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    room = F.floor(F.col("total") / F.lit(shards)) + F.when(F.col("shard") < F.col("total") % shards, 1).otherwise(0)
    own = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    taken = (
        arcs.join(counts, "arc", "left").crossJoin(F.broadcast(total))  # one row
        .select("arc", "shard", F.coalesce("n", F.lit(0)).alias("n"), room.alias("room"))
        .withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)))
        .withColumn("kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("room") - F.col("before"))))
    )
    state = taken.agg(
        F.array_sort(F.collect_list(F.struct("arc", "shard", "n", "kept"))).alias("ring"),
        F.array_sort(F.collect_list(F.when(F.col("n") > F.col("kept"), F.struct("arc", "n", "kept")))).alias("over"),
    ).crossJoin(F.broadcast(taken.groupBy("shard").agg(F.max("room").alias("room"), F.sum("kept").alias("kept")).agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", (F.col("room") - F.col("kept")).alias("free")))), lambda s: s["free"]).alias("free"))))  # one row
    start = F.struct(F.col("free").alias("free"), F.expr("cast(array() as array<struct<arc:int,shard:int,from_rank:bigint,n:bigint>>)").alias("moved"))

    def give(state, arc):
        owners = F.transform("ring", lambda r: r["shard"])
        clockwise = F.array_distinct(F.concat(F.slice(owners, arc["arc"] + 1, F.greatest(F.lit(1), F.size(owners) - arc["arc"])), owners))
        begin = F.struct(state["free"].alias("free"), state["moved"].alias("moved"), (arc["n"] - arc["kept"]).alias("left"), arc["kept"].alias("from_rank"))

        def step(s, shard):
            n = F.least(s["left"], F.element_at(s["free"], shard + 1))
            return F.when(n <= 0, s).otherwise(
                F.struct(
                    F.transform(s["free"], lambda x, i: F.when(i == shard, x - n).otherwise(x)).alias("free"),
                    F.concat(s["moved"], F.array(F.struct(arc["arc"].alias("arc"), shard.alias("shard"), s["from_rank"].alias("from_rank"), n.alias("n")))).alias("moved"),
                    (s["left"] - n).alias("left"),
                    (s["from_rank"] + n).alias("from_rank"),
                )
            )

        return F.aggregate(clockwise, begin, step, lambda s: F.struct(s["free"].alias("free"), s["moved"].alias("moved")))

    moved = state.select(F.inline(F.aggregate("over", start, give, lambda s: s["moved"])))
    stays = taken.where("kept > 0").select("arc", "shard", F.lit(0).cast("long").alias("from_rank"), F.col("kept").alias("n"))
    slots = Window.partitionBy("shard").orderBy("arc", "from_rank").rowsBetween(Window.unboundedPreceding, -1)
    return stays.union(moved.select("arc", "shard", "from_rank", "n")).withColumn("slot", F.coalesce(F.sum("n").over(slots), F.lit(0)))


def assign_shards(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, virtual: int = 128) -> DataFrame:
    """Every row of docs (under `row`) with size, text_crc32, shard and slot.

    A document's id is hashed to the ring, and the next virtual node clockwise tells its shard. No shard takes more than
    its load: the shards' counts differ by one at most. Keys beyond a full shard's load continue clockwise, so one more
    shard moves its own share and what overflows, not everything. Slots number a shard's rows without gaps from 0.

    Only counts meet in one place: a row for each piece of an arc, bounded by shards, virtual nodes and cells. Rows get
    their rank in a window over an arc's piece, in 16 slices by a hash of the content, so that rows that share an id but
    not the text are spread. Null ids stand at one place of the ring, null texts have size 8 and checksum 0; repeated
    rows get slots of their own. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    arcs = written(ring_arcs(spark, shards, virtual), f"{folder}/ring")
    text = utf8(text_col)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry or docs.columns)).alias("row"), F.xxhash64(F.col(id_col).cast("string")).alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("cell", F.shiftright("key", 64 - CELL_BITS).cast("int")).withColumn("slice", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(16)).cast("int"))
    parts = F.broadcast(_pieces(arcs))  # 2^CELL_BITS cells and an end for each arc
    found = rows.join(parts, (rows["cell"] == parts["cell"]) & (parts["low"].isNull() | (rows["key"] > parts["low"])) & (rows["key"] <= parts["high"])).drop(parts["cell"])
    unit = ["arc", "cell", "slice"]
    units = written(found.groupBy(*unit).agg(F.count("*").alias("n")), f"{folder}/units")
    inner = Window.partitionBy("arc").orderBy("cell", "slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(_place(arcs, units.groupBy("arc").agg(F.sum("n").alias("n")), shards), f"{folder}/placed")
    spans = (
        units.withColumn("first", F.coalesce(F.sum("n").over(inner), F.lit(0)))
        .join(placed.withColumnRenamed("n", "taken"), "arc")
        .where((F.col("from_rank") < F.col("first") + F.col("n")) & (F.col("first") < F.col("from_rank") + F.col("taken")))
        .groupBy(*unit, "first")
        .agg(F.collect_list(F.struct("shard", "from_rank", "taken", "slot")).alias("spans"))  # at most one a shard
    )
    rank = F.row_number().over(Window.partitionBy(*unit).orderBy("key", "text_crc32", "size")) - 1
    return (
        found.select("row", "size", "text_crc32", "arc", "cell", "slice", "key")
        .withColumn("rank", rank)
        .join(spans, unit)
        .withColumn("rank", F.col("first") + F.col("rank"))
        .withColumn("span", F.element_at(F.filter("spans", lambda s: (s["from_rank"] <= F.col("rank")) & (F.col("rank") < s["from_rank"] + s["taken"])), 1))
        .select("row", "size", "text_crc32", F.col("span.shard").alias("shard"), (F.col("span.slot") + F.col("rank") - F.col("span.from_rank")).cast("long").alias("slot"))
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents on 24 shards of equal row counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    put = assign_shards(docs, 24, carry=["doc_id"])
    return put.select("row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
