"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Built-in functions only. The plan moves sums, never texts: whether a document
is repeated once more follows from its own key and one threshold per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import materialize, word_count

#: Hex digits of a key that pick its bucket: sums by source and bucket stay small, whatever a source holds.
BUCKET_DIGITS = 3


def document_key(seed: int) -> Column:
    """The place of a document in its source's random order; by id and size."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))


def source_targets(sizes: DataFrame, budget: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target of sizes(source, size).

    Sources take weights in turn, ordered by code point, null last. Each gets
    its weighted share of budget x all sizes, clamped at cap x its own size;
    what is clamped off goes to the others by weight, again and again. That
    ends at min(cap x size, level x weight) for one level, found here in one
    pass: in the order of cap x size / weight the clamped sources come first.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = total.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn))
    ranked = ranked.withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("all_size", F.sum("source_size").over(every))
    ranked = ranked.withColumn("below", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    ranked = ranked.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.lit(float(budget)) * F.col("all_size") - F.lit(float(cap)) * F.col("below")) / F.col("open")
    # the first source in this order that its level does not clamp sets the level of all that follow
    ranked = ranked.withColumn("level", F.min(F.when(level <= F.col("ratio"), F.struct("ratio", level.alias("level")))).over(every))
    fits = F.col("level").isNotNull() & (F.col("ratio") >= F.col("level.ratio"))
    target = F.when(fits, F.least(F.col("level.level") * F.col("weight"), F.lit(float(cap)) * F.col("source_size"))).otherwise(F.lit(float(cap)) * F.col("source_size"))
    return ranked.select("source", "source_size", target.alias("target"))


def source_plan(sizes: DataFrame, budget: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target, whole, last_key: every document is taken `whole` times, and once more if its key <= last_key.

    The rest of a target is filled in key order, up to the document whose
    middle passes it. Sums by bucket find the bucket in which that happens;
    only that bucket is put in order.
    """
    targets = source_targets(sizes, budget, cap, weights)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = materialize(targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    bucket = F.substring("key", 1, BUCKET_DIGITS).alias("bucket")
    sums = sizes.groupBy("source", bucket).agg(F.sum("size").alias("size"))
    so_far = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("size").over(so_far)).withColumn("base", F.col("upto") - F.col("size"))
    t = targets.select(F.col("source").alias("s"), "rest")
    border = sums.join(t, F.col("source").eqNullSafe(F.col("s"))).where("base <= rest and rest < upto").select("source", "bucket", "base", "rest")
    b = materialize(border.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base", "rest"), "mix-border")
    inside = sizes.select("source", "size", "key", bucket).join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = inside.groupBy("source", "bucket", "key", "base", "rest").agg(F.sum("size").alias("size"))
    upto = F.col("base") + F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key"))
    picked = inside.withColumn("upto", upto).where("2 * upto - size <= 2 * rest")
    # with no key picked in the border bucket, the bucket's own digits are above all keys of the buckets before
    last = picked.groupBy("source").agg(F.max("key").alias("k")).select(F.col("source").alias("s"), "k")
    edge = b.join(last.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").select(F.col("s"), F.coalesce("k", "b").alias("edge"))
    out = targets.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
    # no border: the rest is zero, or the whole source (all keys)
    everything = F.when((F.col("rest") > 0) & (F.col("rest") >= F.col("source_size")), F.lit("g")).otherwise(F.lit(""))
    return out.select("source", "source_size", "target", "whole", F.coalesce("edge", everything).alias("last_key"))


def copies() -> Column:
    return F.col("whole") + F.when(F.col("key") <= F.col("last_key"), 1).otherwise(0)


def op7_mix(documents: DataFrame, budget: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of documents(doc_id, text, source).

    size is the number of words, 0 for a null or empty text. taken is size
    times 0, 1 or 2. Null sources form one source, the last. Rows of the same
    id and size share one key and are taken alike; null ids count as an empty
    id. Order and partitioning do not matter, so reruns agree. Extra columns
    are ignored; an empty table gives an empty result.
    """
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = materialize(sized.withColumn("key", document_key(seed)), "mix-sizes")
    plan = materialize(source_plan(sizes, budget, cap, weights), "mix-plan").withColumnRenamed("source", "s")
    rows = sizes.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix_documents(documents: DataFrame, budget: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: int = 7) -> DataFrame:
    """documents, each row repeated as often as the mix takes it (0, 1 or 2 times), its columns unchanged."""
    mark, names = "__mix_", documents.columns
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = materialize(sized.withColumn("key", document_key(seed)), "mix-sizes")
    plan = materialize(source_plan(sizes, budget, cap, weights), "mix-plan").select(F.col("source").alias(mark + "s"), F.col("whole").alias(mark + "whole"), F.col("last_key").alias(mark + "last"))
    size = word_count(F.col("text"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), size.cast("string")))
    rows = documents.join(plan, F.col("source").eqNullSafe(F.col(mark + "s")))
    times = F.col(mark + "whole").cast("int") + F.when(key <= F.col(mark + "last"), 1).otherwise(0)
    return rows.withColumn(mark + "copy", F.explode(F.array_repeat(F.lit(0), times))).select(*names)


ORACLE_SQL = r"""
with sizes as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
keyed as (
  select *, md5('7|' || coalesce(cast(doc_id as varchar), '') || '|' || cast(size as varchar)) as key from sizes),
total as (
  select source, cast(sum(size) as bigint) as source_size,
         [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3) + 1] as weight
  from sizes group by source),
step as (
  select *, cast(2 as double) * source_size / weight as ratio from total),
ordered as (
  select *, sum(source_size) over () as all_size,
         coalesce(sum(source_size) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) as below,
         sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as open
  from step),
leveled as (
  select *, (cast(1.5 as double) * cast(all_size as double) - cast(2 as double) * cast(below as double)) / cast(open as double) as level from ordered),
chosen as (select arg_min(level, ratio) as level, min(ratio) as ratio from leveled where level <= ratio),
targets as (
  select l.source, l.source_size,
         case when c.ratio is not null and l.ratio >= c.ratio then least(c.level * l.weight, cast(2 as double) * l.source_size) else cast(2 as double) * l.source_size end as target
  from leveled l cross join chosen c),
planned as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from targets),
placed as (
  select k.doc_id, k.source, k.size, k.key,
         sum(k.size) over (partition by k.source order by k.key) as upto,
         sum(k.size) over (partition by k.source, k.key) as unit
  from keyed k)
select p.doc_id, p.size, t.source_size, t.target,
       cast(p.size * (t.whole + case when 2 * p.upto - p.unit <= 2 * (t.target - t.whole * t.source_size) then 1 else 0 end) as bigint) as taken
from placed p join planned t on p.source is not distinct from t.source
"""
