"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents, fresh, row_key, word_count

#: The golden ratio's fraction on a scale of 2**31: t * GOLDEN mod 2**31 visits the scale evenly, in whole numbers.
SCALE, GOLDEN = 1 << 31, 1327217885


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """From (source, source_size) to source, source_no, source_size, target.

    Sources in the order of their code points, null last, take the weights in turn.  They share `share` times all sizes by
    weight; none gets more than `most` times its size, and what it leaves goes to the others by weight.  In the order of
    cap / weight the capped sources are a prefix, and the level that holds for the rest is the largest that any prefix
    gives, so the resharing needs no loop.  One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    a = sizes.withColumn("source_no", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    a = a.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("w"), "source_no")
    earlier = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    later = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    a = a.withColumn("level", (total - earlier) / later)
    a = a.withColumn("level", F.max("level").over(Window.partitionBy()))
    return a.select("source", "source_no", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 1024, cells: int = 4096) -> DataFrame:
    """What the mix takes of each row of docs (doc_id, source, size): whole copies and parts, in words.

    Each source's rows, shuffled by a hash, form one stream of words that is cut into blocks of `block` words.  Point t of
    a golden-ratio sequence, mapped through the sources' cumulative slot counts, gives slot t to a source; slots are ranked
    per source (counts of chunks of slots, then ranks inside a chunk) and rank r takes the source's block r, from the start
    again after the whole stream.  A source that the sequence serves too little gets its last slots at the end.  So every
    source takes its rounded target exactly, and no row more than `most` = 2 times its size.

    Returns doc_id, source, size, source_size, target, taken, start (the row's first word in its stream), from0, to0, from1,
    to1 (words [from, to) of the row that the first and the second pass take), slot0, slot1 (the first slot of the schedule
    that takes of it in each pass) and first_slot (the smaller of these; null if nothing is taken).
    Null or empty texts have size 0 and take 0; rows alike are rows apart; an empty table gives an empty table.
    A source may hold most rows: streams are laid out per hash cell, never in one task.
    """
    if most != 2.0:
        raise ValueError("two passes over a source are supported")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    mixed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/mix")))
    docs = docs.withColumn("h", F.conv(F.substring(mixed, 1, 15), 16, 10).cast("long"))
    docs = docs.withColumn("cell", F.expr(f"cast(shiftright(h, 40) * {cells} div {1 << 20} as int)"))
    per_cell = cut(docs.groupBy("source", "cell").agg(F.sum("size").alias("n")), "mix-cells")
    src = targets(per_cell.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most)
    goal = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    src = src.withColumn("pass0", F.least(goal, F.col("source_size"))).withColumn("pass1", F.greatest(goal - F.col("source_size"), F.lit(0)))
    src = src.withColumn("n0", F.ceil(F.col("pass0") / block)).withColumn("slots", F.col("n0") + F.ceil(F.col("pass1") / block))
    src = src.withColumn("first", F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)))
    src = cut(src.fillna(0, ["first"]), "mix-sources")
    total = src.agg(F.sum("slots")).first()[0] or 0

    # the schedule: slot t, source, rank
    width = max(1, total // 4096)
    spans = src.where("slots > 0").select("source_no", "first", "slots", F.explode(F.expr(f"sequence(first div {width}, (first + slots - 1) div {width})")).alias("span"))
    t = spark.range(total).select(F.col("id").alias("t"), F.expr(f"shiftright(((id % {SCALE}) * {GOLDEN}) % {SCALE}, 10) * {total} div {SCALE >> 10}").alias("y"))
    t = t.withColumn("span", F.expr(f"y div {width}")).join(spans, "span").where("y >= first and y < first + slots")
    t = t.select("t", "source_no", F.expr("t div 4096").alias("chunk"))
    counts = t.groupBy("chunk", "source_no").agg(F.count("*").alias("n"))
    run = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("n").over(run), F.lit(0)))
    ranked = t.join(counts.drop("n"), ["chunk", "source_no"])
    ranked = ranked.select("t", "source_no", (F.col("offset") + F.row_number().over(Window.partitionBy("chunk", "source_no").orderBy("t")) - 1).alias("r"))
    got = counts.groupBy("source_no").agg(F.sum("n").alias("got"))
    tail = src.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    tail = tail.select((F.lit(total) + F.col("first")).alias("t0"), "source_no", F.explode(F.expr("sequence(got, slots - 1)")).alias("r"))
    schedule = ranked.unionByName(tail.select((F.col("t0") + F.col("r")).alias("t"), "source_no", "r"))
    schedule = schedule.join(src.select("source_no", "pass0", "pass1", "n0", "slots"), "source_no").where("r < slots")
    second = F.col("r") >= F.col("n0")
    no = F.when(second, F.col("r") - F.col("n0")).otherwise(F.col("r"))
    schedule = schedule.select("source_no", "t", second.alias("again"), no.alias("block"), F.least((no + 1) * block, F.when(second, F.col("pass1")).otherwise(F.col("pass0"))).alias("stop"))

    # the streams: start of each row
    ahead = per_cell.select("source", "cell", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ahead = ahead.join(src.select(F.col("source").alias("s"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source").withColumnRenamed("cell", "c")
    mine = docs.join(src.select(F.col("source").alias("s"), F.col("source_no").alias("k")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    laid = mine.join(ahead, (F.col("k") == F.col("source_no")) & (F.col("cell") == F.col("c"))).drop("c", "k")
    inside = Window.partitionBy("source_no", "cell").orderBy("h", "doc_id", "size")
    laid = laid.withColumns({"seq": F.row_number().over(inside), "start": F.col("ahead") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})

    # blocks that a row lies in, joined with the slots that take them
    pieces = laid.withColumn("block", F.explode_outer(F.expr(f"case when size > 0 then sequence(start div {block}, (start + size - 1) div {block}) end")))
    pieces = pieces.join(schedule, ["source_no", "block"], "left")
    low = F.greatest(F.col("start"), F.col("block") * block) - F.col("start")
    high = F.least(F.col("start") + F.col("size"), F.col("stop")) - F.col("start")
    hit = F.col("stop").isNotNull() & (high > low)
    pass_no = lambda again, x: F.when(hit & (F.col("again") == again), x)
    keys = ["source_no", "cell", "seq", "doc_id", "source", "size", "source_size", "target", "start"]
    return pieces.groupBy(*keys).agg(
        F.sum(F.when(hit, high - low).otherwise(0)).alias("taken"), F.min(F.when(hit, F.col("t"))).alias("first_slot"),
        F.min(pass_no(False, low)).alias("from0"), F.max(pass_no(False, high)).alias("to0"), F.min(pass_no(False, F.col("t"))).alias("slot0"),
        F.min(pass_no(True, low)).alias("from1"), F.max(pass_no(True, high)).alias("to1"), F.min(pass_no(True, F.col("t"))).alias("slot1"),
    ).drop("cell", "seq")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as the mix takes them, with docs' columns: a row taken twice comes twice, a row taken in part comes
    with the text of the words taken (as they stand there, with the white space after each).  Rows without words, of which
    the mix can take nothing, stay away, as do rows beyond their source's target.

    The rows lie in the order of the schedule: each at the slot of the first of its blocks, so that every prefix of the
    written files holds the sources near their weights.  docs' doc_id may repeat, and rows may be alike; other columns of
    docs stay as they are, whatever their names."""
    names = docs.columns
    one, two, place, whole, spans, span = fresh(docs, "k1", "k2", "place", "whole", "spans", "span")
    keys = row_key(F.col("doc_id"), F.col("text"), F.col("source"))
    lean = docs.select(F.col("doc_id"), keys[0].alias("k1"), keys[1].alias("k2"), "source", word_count(F.col("text")).alias("size"))
    number = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("doc_id"))
    lean = cut(lean.withColumn("n", number), "mix-sized")
    taken = plan(lean.select(F.struct("doc_id", "k1", "k2", "n").alias("doc_id"), "source", "size"), **how).where("taken > 0")
    passes = F.array(*[F.struct(F.col(f"from{k}").alias("a"), F.col(f"to{k}").alias("b"), F.col(f"slot{k}").alias("slot")) for k in (0, 1)])
    taken = taken.select("doc_id.k1", "doc_id.k2", "doc_id.n", "size", F.filter(passes, lambda x: x["b"].isNotNull()).alias("p"))
    taken = taken.groupBy(F.col("k1").alias(one), F.col("k2").alias(two)).agg(F.max("size").alias(whole), F.map_from_entries(F.collect_list(F.struct("n", "p"))).alias(spans))

    # rows alike are numbered where the join has laid them, and each takes the words of its number
    base = docs.withColumn(one, keys[0]).withColumn(two, keys[1]).join(taken, [one, two])
    base = base.withColumn(place, F.row_number().over(Window.partitionBy(one, two).orderBy(F.lit(0))))
    rows = base.withColumn(span, F.explode(F.col(spans)[F.col(place)]))
    words = F.regexp_extract_all(F.col("text"), F.lit(rf"({WORD_AND_SPACE})"), F.lit(1))
    part = F.array_join(F.slice(words, F.col(f"{span}.a").cast("int") + 1, (F.col(f"{span}.b") - F.col(f"{span}.a")).cast("int")), "")
    text = F.when((F.col(f"{span}.a") == 0) & (F.col(f"{span}.b") == F.col(whole)), F.col("text")).otherwise(part)
    cols = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in names else {})
    rows = rows.select(*[cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in names], F.col(f"{span}.slot").alias(place))
    return rows.repartitionByRange(place).sortWithinPartitions(place).drop(place)


WORD_AND_SPACE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def query(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents with weights 3, 1, 2, sharing 150 % of all words; slot0, slot1: where the schedule takes of a
    document in each pass (-1: nothing)."""
    lean = cut(sized(documents(spark, sf_dir)), "mix-sized")
    return plan(lean).select("doc_id", "size", "source_size", "target", "taken", "source", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("slot0", "slot1")])


ORACLE = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
n as (select *, row_number() over (order by source nulls last) - 1 as k from s),
w as (select *, cast(([3, 1, 2])[(k % 3) + 1] as double) as w, cast(source_size * 2 as double) as cap from n),
l as (select *, (cast(sum(source_size) over () as double) * 1.5 - coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by cap / w, k rows between current row and unbounded following) as level from w),
t as (select source, source_size, least(cap, max(level) over () * w) as target from l),
p as (select *, least(cast(floor(target + 0.5) as bigint), source_size) as pass0, greatest(cast(floor(target + 0.5) as bigint) - source_size, 0) as pass1 from t),
x as (select d.*, cast(sum(size) over (partition by source order by md5(coalesce(cast(doc_id as varchar), 'null') || '/mix'), doc_id, size rows unbounded preceding) as bigint) - size as start from d),
b as (select n.k, p.*, (pass0 + 1023) // 1024 as n0, (pass0 + 1023) // 1024 + (pass1 + 1023) // 1024 as slots from p join n on n.source is not distinct from p.source),
f as (select *, cast(coalesce(sum(slots) over (order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as head, cast(sum(slots) over () as bigint) as total from b),
y as (select t, ((((t % 2147483648) * 1327217885) % 2147483648) >> 10) * total // 2097152 as y from (select total, unnest(range(total)) as t from (select distinct total from f))),
r as (select y.t, f.k, row_number() over (partition by f.k order by y.t) - 1 as r from y join f on y.y >= f.head and y.y < f.head + f.slots),
g as (select f.k, f.slots, f.head, f.total, count(r.t) as got from f left join r on r.k = f.k group by all),
e as (select t, k, r from r union all select total + head + r as t, k, r from (select *, unnest(range(got, slots)) as r from g)),
z as (select e.t, f.source, f.pass0, f.pass1, e.r >= f.n0 as again, case when e.r >= f.n0 then e.r - f.n0 else e.r end as block from e join f on e.k = f.k where e.r < f.slots),
u as (select x.source, x.doc_id, x.start, x.size, cast(min(case when not again then t end) as bigint) as slot0, cast(min(case when again then t end) as bigint) as slot1
  from x join z on x.source is not distinct from z.source and x.size > 0 and z.block * 1024 < x.start + x.size and least((z.block + 1) * 1024, case when again then pass1 else pass0 end) > x.start group by all)
select x.doc_id, x.size, source_size, target, greatest(least(x.start + x.size, pass0) - x.start, 0) + greatest(least(x.start + x.size, pass1) - x.start, 0) as taken, x.source, coalesce(slot0, -1) as slot0, coalesce(slot1, -1) as slot1
from x join p on x.source is not distinct from p.source
left join u on u.source is not distinct from x.source and u.doc_id is not distinct from x.doc_id and u.start = x.start and u.size = x.size
"""
