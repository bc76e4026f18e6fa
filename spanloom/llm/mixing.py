"""Mixing sources to target weights by Pareto order sampling, with native DataFrame operations only.

Each source first gets whole copies for certain, then a fixed-size sample by Pareto order. Documents have unequal
inclusion probabilities p: in proportion to the number of binary digits of their size (longer texts are somewhat
likelier), at most 1, and such that the expected words of the sample are those that the source lacks. A
document draws u; documents go in ascending order of odds(u) / odds(p), and are taken until those words are reached.
Running totals are formed in two steps (bins of the order, then within the one bin where the total is reached),
so a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, free_name, with_locator, written

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more than so many times.
MOST_COPIES = 3
#: Steps of the random order that are totalled before single documents are looked at.
BINS = 4096
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of the total by weight, none above `most` times its source; the excess goes to the others by weight until none is above.

    That is filling vessels to one level: target = min(cap, level * weight). With sources ordered by
    cap / weight, those before k are full, and the level follows from the rest. One row per source.
    """
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(listed) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumn("k", F.row_number().over(filled)).withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # The first source in that order whose cap is not below the level ends the filling; all after it share its level.
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("k", "level"))).over(whole)["level"]
    return rows.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("w"), "cap")).alias("target"))


def weight_of(size: Column) -> Column:
    """What inclusion probabilities are in proportion to: the binary digits of size + 1, so that a source has few different ones."""
    return F.length(F.bin(size + 1)).cast("long")


def inclusion_scales(classes: DataFrame) -> DataFrame:
    """(source, scale) from (source, weight, class_size, lacking), a row per source and weight: p = min(1, scale * weight) makes the sum of p * size what the source lacks.

    The heaviest classes are those that reach 1: with them in front, the scale is what is lacking without them, divided by
    the weighted size of the rest, for the first place where no class of the rest exceeds 1.
    """
    heaviest = Window.partitionBy("source").orderBy(F.desc("weight"))
    full = F.coalesce(F.sum("class_size").over(heaviest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("weight") * F.col("class_size")).over(heaviest.rowsBetween(0, Window.unboundedFollowing))
    rows = classes.withColumn("scale", F.when(rest > 0, (F.col("lacking") - full) / rest))
    fits = F.when(F.col("scale") * F.col("weight") <= 1, F.struct((-F.col("weight")).alias("k"), "scale"))
    return rows.groupBy("source").agg(F.coalesce(F.min(fits)["scale"], F.lit(1.0)).alias("scale"))


def pareto_order(draw: Column, probability: Column) -> Column:
    """odds(u) / odds(p) as a share of itself plus one: the same order, between 0 and 1. Certain documents (p = 1) come first."""
    u = (draw + F.lit(0.5)) / F.lit(float(2**52))
    up, down = u * (F.lit(1.0) - probability), (F.lit(1.0) - u) * probability
    return up / (up + down)


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None, weights=WEIGHTS, most: int = MOST_COPIES, bins: int = BINS, seed: str = SEED) -> DataFrame:
    """docs with columns size, source_size, target and copies (how often the mix takes the document, 0 included), replacing columns of these names.

    size: a column that has the sizes already. The draw of a document comes from its id and `seed` alone,
    so reruns agree. Ties in the order go by id, then by size. Null or empty text has size 0. Null source is a source of its own, last in
    order; null ids draw as the text 'null'. Documents are taken in the order while they fit into what their source lacks. Of rows alike
    in id and size, which share a draw, so many are taken as fit, those that come first in their files. What is lacking then is filled by one
    document more, the one whose size is nearest to it, if that comes nearer than none. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    located, file, row = with_locator(docs)
    kept = located.withColumn("size", words(F.col(text)) if size is None else F.col(size)).drop("source_size", "target", "copies")
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    # 52 bits of a digest: the same number in any engine that has md5.
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("long")
    narrow = written(kept.select(F.col(source).alias("source"), F.col(doc_id).alias("id"), "size", draw.alias("draw"), F.col(file).alias("file"), F.col(row).alias("row")), "mix")
    same = F.col("source").eqNullSafe(F.col("s"))

    # A row per source and weight, of which there are at most 64.
    classes = written(narrow.groupBy("source", weight_of(F.col("size")).alias("weight")).agg(F.sum("size").alias("class_size")), "mix-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, most)
    # Whole copies that each document has for certain, and the words that the source lacks then.
    certain = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size") + 1e-12))
    targets = targets.withColumn("certain", certain.cast("long")).withColumn("lacking", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size")))
    targets = written(targets, "mix-targets")
    scales = inclusion_scales(classes.join(targets.select(F.col("source").alias("s"), "lacking"), same).drop("s"))
    plan = written(targets.join(scales.select(F.col("source").alias("s"), "scale"), same).drop("s"), "mix-plan")
    small = plan.count() <= 100_000  # proven before it is broadcast; beyond that the join shuffles
    sent = lambda df: F.broadcast(df) if small else df

    place = lambda scale, size, draw: pareto_order(draw, F.least(F.lit(1.0), scale * weight_of(size)))
    bin_of = lambda place: F.least(F.floor(place * bins), F.lit(bins - 1)).cast("long")
    ranked = narrow.join(sent(plan.select(F.col("source").alias("s"), "lacking", "scale")), same).drop("s").withColumn("place", place(F.col("scale"), F.col("size"), F.col("draw")))
    per_bin = ranked.groupBy("source", "lacking", bin_of(F.col("place")).alias("bin")).agg(F.sum("size").alias("bin_size"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edge = per_bin.withColumn("before", F.coalesce(F.sum("bin_size").over(running), F.lit(0))).where("before < lacking")
    edge = edge.groupBy("source").agg(F.max(F.struct("bin", "before")).alias("e")).select(F.col("source").alias("s"), "e.bin", "e.before")
    edge = written(edge, "mix-edge")  # a row per source

    # Only the bin in which the total is reached is looked at by document.
    units = ranked.join(sent(edge), same).where(bin_of(F.col("place")) == F.col("bin"))
    units = units.groupBy("source", "place", "id", "size", "lacking", "before").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("source").orderBy("place", F.col("id").asc_nulls_first(), "size")
    unit = F.col("n") * F.col("size")
    units = units.withColumn("start", F.col("before") + F.sum(unit).over(ordered) - unit)
    fits, key_of = F.col("start") + unit <= F.col("lacking"), F.struct("place", "id", "size")
    share = F.floor(F.try_divide(F.col("lacking") - F.col("start"), F.col("size"))).cast("long")
    cut = units.groupBy("source").agg(F.max(F.when(fits, key_of)).alias("last"), F.max(F.when(fits, F.col("start") + unit)).alias("full"), F.min(F.when(~fits, F.struct("place", "id", "size", share.alias("share")))).alias("part"))
    gap = F.col("lacking") - F.coalesce("full", "before") - F.coalesce(F.col("part.share") * F.col("part.size"), F.lit(0))
    plan = plan.join(edge.select("s", "bin", "before"), same, "left").drop("s").join(cut.withColumnRenamed("source", "s"), same, "left").drop("s").withColumn("gap", gap)
    plan = written(plan, "mix-plan")
    # The one document that fills the gap best, of those not taken in the order.
    open_ = ranked.drop("lacking", "scale").join(sent(plan.where("gap > 0").select(F.col("source").alias("s"), "bin", "last", "part", "gap")), same).drop("s")
    before_cut = (bin_of(F.col("place")) < F.col("bin")) | ((bin_of(F.col("place")) == F.col("bin")) & F.coalesce(key_of <= F.col("last"), F.lit(False)))
    nearer = F.abs(F.col("gap") - F.col("size"))
    fill = open_.where(~before_cut & (nearer < F.col("gap"))).groupBy("source").agg(F.min(F.struct(nearer.alias("nearer"), "place", "id", "size")).alias("fill")).select(F.col("source").alias("s"), "fill")
    plan = written(plan.join(fill, same, "left").drop("s"), "mix-plan")
    # Rows of the units that are taken in part, numbered by their place in the files; stretches of 65,536 rows are numbered by themselves.
    alike = lambda u: F.col(f"{u}.id").eqNullSafe(F.col("id")) & F.col(f"{u}.size").eqNullSafe(F.col("size")) & F.col(u).isNotNull()
    quota = F.when(alike("part"), F.col("part.share")).otherwise(0) + F.when(alike("fill"), 1).otherwise(0)
    partly = narrow.join(sent(plan.where("part is not null or fill is not null").select(F.col("source").alias("s"), "part", "fill")), same).where(alike("part") | alike("fill"))
    partly = written(partly.select("source", "id", "size", "file", "row", F.shiftright("row", 16).alias("stretch"), quota.alias("quota")).where("quota > 0"), "mix-part")
    unit_key = ["source", "id", "size"]
    held = partly.groupBy(*unit_key, "file", "stretch").agg(F.count("*").alias("n"))
    held = held.withColumn("ahead", F.sum("n").over(Window.partitionBy(*unit_key).orderBy("file", "stretch")) - F.col("n")).select(*[F.col(c).alias(f"h_{c}") for c in [*unit_key, "file", "stretch"]], "ahead")
    match = F.lit(True)
    for c in [*unit_key, "file", "stretch"]:
        match = match & F.col(c).eqNullSafe(F.col(f"h_{c}"))
    within = F.row_number().over(Window.partitionBy(*unit_key, "file", "stretch").orderBy("row"))
    taken_rows = partly.withColumn("k", within).join(held, match).where(F.col("ahead") + F.col("k") <= F.col("quota")).select(F.col("file").alias(file), F.col("row").alias(row))
    taken_rows = written(taken_rows, "mix-taken")
    taken_rows = F.broadcast(taken_rows) if taken_rows.count() <= 100_000 else taken_rows
    mark = free_name(kept, "mix_partly")
    plan = sent(plan.select(F.struct(F.col("source").alias("plan_source"), "source_size", "target", "certain", "scale", "bin", "last").alias(plan_name := free_name(kept, "mix_plan"))))
    of = lambda c: F.col(f"{plan_name}.{c}")
    out = kept.join(plan, F.col(source).eqNullSafe(of("plan_source")), "left").join(taken_rows.withColumn(mark, F.lit(1)), [file, row], "left")
    own_place = place(of("scale"), F.col("size"), draw)
    own = F.struct(own_place.alias("place"), F.col(doc_id).alias("id"), F.col("size").alias("size"))
    whole = F.when(of("bin").isNull() | (bin_of(own_place) > of("bin")), 0).when(bin_of(own_place) < of("bin"), 1).when(own <= of("last"), 1).otherwise(0)
    shown = [c for c in kept.columns if c not in (file, row)]
    return out.select(*shown, of("source_size").alias("source_size"), of("target").alias("target"), (of("certain") + F.greatest(whole, F.coalesce(F.col(mark), F.lit(0)))).alias("copies"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    return mix(sized, size="size").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint as draw
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [1.0::double, 2.0::double, 3.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint] as w, source_size * 3.0::double as cap from s),
f as (select *, row_number() over o as k,
             (sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (o rows between current row and unbounded following) as level
      from w window o as (order by cap / w, source nulls last)),
l as (select min_by(level, k) as level from f where level * w <= cap),
t as (select source, source_size, least(cap, l.level * w)::double as target from f, l),
p as (select *, case when source_size = 0 then 0 else floor(target / source_size + 1e-12) end::bigint as certain from t),
q as (select *, greatest(0, target - certain * source_size) as lacking from p),
g as (select source, length(bin(size + 1)) as weight, sum(size)::bigint as class_size from d group by all),
h as (select g.*, lacking,
             (lacking - coalesce(sum(class_size) over (o rows between unbounded preceding and 1 preceding), 0)::double)
             / nullif(sum(weight * class_size) over (o rows between current row and unbounded following), 0)::double as scale
      from g join q on g.source is not distinct from q.source window o as (partition by g.source order by weight desc)),
c as (select source, coalesce(arg_max(scale, weight) filter (where scale * weight <= 1), 1.0::double) as scale from h group by source),
v as (select d.*, q.* exclude (source), (draw + 0.5::double) / 4503599627370496.0::double as u, least(1.0::double, scale * length(bin(size + 1))) as p
      from d join q on d.source is not distinct from q.source join c on d.source is not distinct from c.source),
x as (select *, u * (1.0::double - p) / (u * (1.0::double - p) + (1.0::double - u) * p) as place from v),
u as (select *, sum(size) over (partition by source order by place, doc_id nulls first, size) as upto,
             sum(size) over (partition by source, place, doc_id, size) as unit,
             row_number() over (partition by source, place, doc_id, size) as rn
      from x),
a as (select *, lacking > 0 and upto <= lacking as whole from u),
m as (select source, coalesce(max(upto) filter (where whole), 0) as done from a group by source),
e as (select a.*, case when not whole and lacking > 0 and upto - unit = done then floor((lacking - done) / size) end::bigint as share, done
      from a join m on a.source is not distinct from m.source),
z as (select *, lacking - done - coalesce(max(share * size) over (partition by source), 0) as gap from e),
y as (select *, case when not whole and gap > 0 and abs(gap - size) < gap then row_number() over (partition by source order by not whole and gap > 0 and abs(gap - size) < gap desc, abs(gap - size), place, doc_id nulls first, size) end as best from z),
b as (select source, doc_id as fill_id, size as fill_size from y where best = 1)
select y.doc_id, y.size, source_size, target,
       (y.size * (certain + case when whole then 1
         when rn <= coalesce(share, 0) + case when b.fill_size = y.size and b.fill_id is not distinct from y.doc_id then 1 else 0 end then 1 else 0 end))::bigint as taken
from y left join b on y.source is not distinct from b.source
"""
