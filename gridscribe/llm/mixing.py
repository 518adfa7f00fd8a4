"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import packed, table, unpacked

#: Sizes count words of these characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: A size bin of a source is cut by ranges of the hash into blocks: a range for so many rows of the table, and at most so many ranges, by which the prefix sum over
#: the blocks of a source stays some million rows (about 400 bins).
BLOCK_ROWS, MOST_RANGES = 2_000, 4_096


def n_words(text: Column) -> Column:
    """Words of a text, counted without an array of them; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size): shares by weight that stop at `most` times the size.

    Excess is shared again by weight until no target is above its stop. In order of stop / weight the stopped sources come
    first, so running sums give the final share at once. One row per source; the null source is last in the order.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    array = F.array(*[F.lit(w) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(array, (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double"))
    by_stop = Window.orderBy(F.lit(most) * F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    everything, before = Window.partitionBy(), by_stop.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("stopped", F.col("left_size") * F.col("weight") > F.lit(most) * F.col("source_size") * F.col("left_weight"))
    )
    stopped = rows.withColumn("stopped_size", F.coalesce(F.sum(F.when(F.col("stopped"), F.lit(most) * F.col("source_size"))).over(everything), F.lit(0)))
    free = stopped.withColumn("free_weight", F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(everything))
    share = (F.sum("source_size").over(everything) - F.col("stopped_size")) * F.col("weight") / F.col("free_weight")
    return free.select("source", "source_size", F.when(F.col("stopped"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def size_bin(size: Column) -> Column:
    """Sizes below 32 as they are, larger ones by bit length and five leading bits: bins a thirty-second wide."""
    bits = F.length(F.bin(size)).cast("long")
    return F.when(size < 32, size).otherwise(bits * 16 + F.expr("shiftright(_size, cast(length(bin(_size)) - 5 as int))") - 16)


def hashed(of: str, digits: int = 8) -> Column:
    """The first hex digits of an md5 as a number: the same in any engine and any rerun."""
    return F.conv(F.substring(F.md5(F.expr(of)), 1, digits), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """docs with _size, _source_size, _target, _copies: how often the mix takes each row.

    Each document of a source is expected target / source_size times. Within a source, documents stand in the order of
    (size bin, hash of the id, id, hash of the text): the prefix sum of expected copies plus one random offset of the source is cut at each
    integer, and a document is emitted once per integer it crosses, so copies differ by less than one from what is expected, and
    taken words follow the target at every size. The prefix sum is over blocks (bin, range of the hash) first and then within a
    block. Blocks get narrower with the number of rows, so a source with a third of all rows, or one common size, is no single task; how many
    blocks there are changes no result, as they follow the order.

    Null text: size 0; very long texts are counted whole. Null source: a source of its own, last. Empty table: no rows. Ties and repeated rows: each row is a
    document; rows with the same id are told apart by their texts, and rows that are the same in both may change places. Null ids stand first in their bin and hash. Further columns stay;
    columns beginning with "_size", "_source_size", "_target", "_copies" are replaced.
    """
    roles = {id_col: "_id", text_col: "_text", source_col: "_source"}
    rows = packed(docs, roles).withColumn("_size", n_words(F.col("_text")))
    ranges = docs.agg(F.least(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(MOST_RANGES)).alias("_ranges"))
    rows = rows.withColumns({"_bin": size_bin(F.col("_size")), "_h": hashed("coalesce(cast(_id as string), '')"), "_tie": F.xxhash64("_text")})
    rows = rows.join(F.broadcast(ranges)).withColumn("_sub", F.floor(F.col("_h") * F.col("_ranges") / F.lit(float(1 << 32)))).drop("_ranges")
    blocks = rows.groupBy("_source", "_bin", "_sub").agg(F.count("*").alias("n"), F.sum("_size").alias("size"))
    sources = targets(blocks.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")), weights, most)
    ahead = Window.partitionBy("_source").orderBy("_bin", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    plan = blocks.join(sources, F.col("_source").eqNullSafe(F.col("source"))).select(
        F.col("_source").alias("b_source"), F.col("_bin").alias("b_bin"), F.col("_sub").alias("b_sub"), "ahead", "source_size", "target")
    within = Window.partitionBy("_source", "_bin", "_sub").orderBy("_h", "_id", "_tie")
    rows = rows.withColumn("_rank", F.row_number().over(within))
    rows = rows.join(plan, F.col("_source").eqNullSafe(F.col("b_source")) & (F.col("_bin") == F.col("b_bin")) & (F.col("_sub") == F.col("b_sub")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hashed(f"concat('{seed}', ':', coalesce(_source, ''))") / F.lit(float(1 << 32))
    at = F.col("ahead") + F.col("_rank")
    copies = F.floor(at * rate + offset) - F.floor((at - 1) * rate + offset)
    return unpacked(rows, docs.columns, roles, {"_size": F.col("_size"), "_source_size": F.col("source_size"), "_target": F.col("target"), "_copies": copies})


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it, with the columns of the documents."""
    own = [c for c in mixed.columns if c not in ("_size", "_source_size", "_target", "_copies")]
    times = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_time")
    return mixed.where("_copies > 0").select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), times).select(*[F.col("_row").getField(c).alias(c) for c in own])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs)
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").cast("long").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken"), F.col("_copies").cast("long").alias("copies"))


#: The part of the SQL that finds copies, for any input named docs (doc_id, text, source).
MIX_CTES = """
sized AS (
  SELECT *, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS bigint) AS size FROM docs),
binned AS (
  SELECT *, CASE WHEN size < 32 THEN size ELSE length(bin(size)) * 16 + (size >> (length(bin(size)) - 5)) - 16 END AS bin,
    cast('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '')), 1, 8) AS bigint) AS h FROM sized),
sized_sources AS (
  SELECT source, cast(sum(size) AS bigint) AS source_size FROM binned GROUP BY source),
weighed AS (
  SELECT *, cast([1, 2, 3][cast((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS int)] AS double) AS weight FROM sized_sources),
running AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS left_size,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_weight
  FROM weighed WINDOW before AS (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
halted AS (SELECT *, left_size * weight > 3 * source_size * left_weight AS stopped FROM running),
shares AS (
  SELECT source, source_size, CASE WHEN stopped THEN cast(3 * source_size AS double) ELSE
    (sum(source_size) OVER () - coalesce(sum(CASE WHEN stopped THEN 3 * source_size END) OVER (), 0)) * weight
    / sum(CASE WHEN NOT stopped THEN weight END) OVER () END AS target FROM halted),
placed AS (
  SELECT b.*, s.source_size, s.target, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY b.source ORDER BY b.bin, b.h, b.doc_id) AS n,
    cast('0x' || substr(md5('mix:' || coalesce(b.source, '')), 1, 8) AS bigint) / 4294967296.0::double AS off
  FROM binned b JOIN shares s ON b.source IS NOT DISTINCT FROM s.source),
counted AS (SELECT *, cast(floor(n * rate + off) - floor((n - 1) * rate + off) AS bigint) AS copies FROM placed)
"""

SQL = f"""WITH docs AS (SELECT doc_id, text, source FROM documents), {MIX_CTES}
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted"""
