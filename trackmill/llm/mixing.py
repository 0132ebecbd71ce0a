"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.llm.common import WORD, shared_dir, written


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: list[str], seed: int) -> DataFrame:
    """Rows with their size and their place: bins of like size, in them sixteen slices by a hash of the id."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    bits = F.bin("size")
    key = F.coalesce(F.concat(F.lit("a"), F.col(source_col)), F.lit("b"))
    return (
        docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), key.alias("key"), size.alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("mark"))
        .withColumn("bin", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(F.concat(bits, F.lit("000")), 2, 3)))
        .withColumn("slice", F.substring("mark", 1, 1))
    )


def source_targets(sources: DataFrame, weights: list[float], most: float) -> DataFrame:
    """(key, source_size, target) of sources with (key, source_size): one row a source.

    The weights repeat over the sources in code point order. Sources whose share is above most times their size stop
    there; sorted by size over weight they come first, so the level of the others follows from running sums.
    """
    everything = Window.partitionBy()
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights))) + 1).cast("int"))
    upto = Window.orderBy("limit_level", "key").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("limit_level", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("limit_level"), F.struct("limit_level", "key", "level"))).over(everything).getField("level"))
        .select("key", "source_size", F.when(F.col("level").isNull() | (F.col("limit_level") < F.col("level")), F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))
    )


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None, weights: tuple = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 17) -> DataFrame:
    """Every row of docs with size, source_size, target and copies: how often the mix takes it.

    A source shares all words by its weight, at most `most` times its own. Within a source the documents stand in bins
    of like size; the expected copies (target over source_size, the same for each) are summed up along that order from
    one random offset, and a document is taken once for each whole number that its stretch crosses. Like sizes stand
    together, so the words taken come near the target. The running sum is a rank: the rows before the document's cell
    (source, bin and slice) come from counts, those within from a window over the cell, so no source is one task.

    Sizes count words; null and empty texts have size 0 and are taken like others, a null source is one more source,
    last in order. The offset and the order follow from the seed and the ids, so reruns agree; equal rows share their
    copies in either order. Any further columns go through under `row` (carry: which, all by default). An empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    rows = _sized(docs, id_col, text_col, source_col, carry or docs.columns, seed)
    cells = written(rows.groupBy("key", "bin", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("words")), f"{shared_dir(spark)}/cells")
    targets = source_targets(cells.groupBy("key").agg(F.sum("words").alias("source_size")), list(weights), most)
    before = Window.partitionBy("key").orderBy("bin", "slice").rowsBetween(Window.unboundedPreceding, -1)
    places = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(targets, "key").select("key", "bin", "slice", "before", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("key", "bin", "slice").orderBy("size", "mark"))
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("key"))), 1, 4), 16, 10).cast("double") + 0.5) / 65536.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        rows.withColumn("rank", rank)
        .join(places, ["key", "bin", "slice"])
        .withColumn("at", (F.col("before") + F.col("rank")).cast("double"))
        .withColumn("copies", (F.floor(rate * F.col("at") + offset) - F.floor(rate * (F.col("at") - 1.0) + offset)).cast("long"))
        .select("row", "size", "source_size", "target", "copies")
    )


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents, as counts of words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix_documents(docs, carry=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    coalesce('a' || source, 'b') AS key, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents
), s AS (SELECT key, sum(size) AS source_size FROM d GROUP BY key
), w AS (SELECT key, CAST(source_size AS DOUBLE) AS ss, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY key) - 1) % 3] AS weight FROM s
), v AS (SELECT *, 3.0 * ss AS cap, 3.0 * ss / weight AS lim FROM w
), l AS (SELECT *, (sum(ss) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM v WINDOW b AS (ORDER BY lim, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT key, ss, CASE WHEN k.level IS NULL OR lim < k.level THEN cap ELSE weight * k.level END AS target
  FROM l, (SELECT min_by(level, (lim, key)) AS level FROM l WHERE level <= lim) k
), r AS (SELECT d.*, t.ss, t.target, CAST(row_number() OVER (PARTITION BY d.key ORDER BY
    lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size) || '000', 2, 3), substr(mark, 1, 1), size, mark) AS DOUBLE) AS place,
    (CAST('0x' || substr(md5('17/' || d.key), 1, 4) AS INTEGER) + 0.5) / 65536.0 AS u,
    CASE WHEN t.ss > 0 THEN t.target / t.ss ELSE 0 END AS rate FROM d JOIN t ON d.key = t.key)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (floor(rate * place + u) - floor(rate * (place - 1) + u)) AS BIGINT) AS taken FROM r
"""
