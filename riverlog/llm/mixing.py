"""Operator 1: mixing sources to target weights.

A multivariate-hypergeometric splitting tree. Every source is cut into blocks of whole documents by a
hash; its target says how many whole passes and which part of one more pass the mix takes, as an exact
number of block draws. The tree hands the vector of those quotas down from all output shards to halves of
them, each time drawing the left half's counts without replacement, so a shard ends with an exact quota of
every source. The shards then take disjoint runs of each source's permuted draws and are shuffled locally.
All of it is DataFrame and SQL functions. Blocks and shards are as many as the input's words ask for; orders over
them are range-partitioned, and the tree is spread over tasks as it grows. Only the table of sources and the quotas of a tree node
hold all sources together, so sources are to be kinds of text, not hosts.

Defined results: null text has size 0; a null source is a source of its own and ranks last; a source without
words has target 0; a document without words is never taken; rows that repeat a doc_id are rows of their own and
rows without id are hashed by their text; an empty table gives an empty mix. Columns of the input that are named like an added
one give way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table, unit_hash, word_count


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # by rank of the source, repeating
    share: float = 1.5  # of all words, taken by the mix
    most: float = 2.0  # passes over a source
    block_words: int = 1 << 15
    shard_words: int = 1 << 22
    seed: int = 20240229


def targets(sized: DataFrame, s: MixSettings) -> DataFrame:
    """One row a source: source, source_no, source_size, target. Caps are met by water filling.

    The rows taken by weight w are min(cap, level * w); ordered by cap / w, the first source whose cap is above the
    level fixes it. This is where repeated resharing by weight ends. Sources are few, so one ordered window does.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weights = F.array(*[F.lit(float(w)) for w in s.weights])
    ranked = ranked.withColumn("w", F.get(weights, F.col("source_no") % len(s.weights))).withColumn("cap", F.col("source_size") * F.lit(s.most))
    by_ratio, everything = Window.orderBy(F.col("cap") / F.col("w"), "source_no"), Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(s.share)
    capped, lighter = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (total - capped) / (F.sum("w").over(everything) - lighter)
    ranked = ranked.withColumn("level", level).withColumn("reached", F.col("level") <= F.col("cap") / F.col("w"))
    level = F.min(F.when(F.col("reached"), F.struct(F.col("cap") / F.col("w"), F.col("source_no"), F.col("level").alias("level")))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return ranked.select("source", "source_no", "source_size", target.alias("target"))


# The number of marked ones among `draws` out of `pool`, `marked` of which are marked, by the inverse of the
# distribution function at `u`. Weights are relative to the mode and summed over ten deviations either side.
def _hypergeometric(pool: str, marked: str, draws: str, u: str) -> str:
    lo, hi = f"greatest(0L, {draws} - ({pool} - {marked}))", f"least({draws}, {marked})"
    mode = f"least({hi}, greatest({lo}, cast(floor(({draws} + 1.0D) * ({marked} + 1.0D) / ({pool} + 2.0D)) as bigint)))"
    wide = f"cast(ceil(10 * sqrt({draws} * 1.0D * {marked} / greatest({pool}, 1L))) as bigint) + 10"
    ratio = lambda x: f"((({marked} - {x}) * 1.0D * ({draws} - {x})) / (({x} + 1.0D) * ({pool} - {marked} - {draws} + {x} + 1.0D)))"  # noqa: E731  weight of x + 1 over that of x
    up = f"""aggregate(sequence(p.mode, p.last), named_struct('w', 1.0D, 's', 0.0D),
        (a, x) -> named_struct('w', if(x < p.last, a.w * {ratio('x')}, a.w), 's', a.s + a.w))"""
    down = f"""aggregate(sequence(p.mode, p.first), named_struct('w', 1.0D, 's', 0.0D),
        (a, y) -> named_struct('w', if(y > p.first, a.w / {ratio('(y - 1)')}, a.w), 's', a.s + a.w))"""
    walk = f"""aggregate(sequence(p.first, p.last), named_struct('w', q.down.w, 's', 0.0D, 'at', p.last, 'done', false),
        (a, x) -> named_struct('w', if(x < p.last, a.w * {ratio('x')}, a.w), 's', a.s + a.w,
            'at', if(not a.done and a.s + a.w >= {u} * (q.up.s + q.down.s - 1.0D), x, a.at), 'done', a.done or a.s + a.w >= {u} * (q.up.s + q.down.s - 1.0D)), a -> a.at)"""
    bounds = f"array(named_struct('mode', {mode}, 'first', greatest({lo}, {mode} - ({wide})), 'last', least({hi}, {mode} + ({wide}))))"
    return f"transform({bounds}, p -> transform(array(named_struct('up', {up}, 'down', {down})), q -> {walk})[0])[0]"


def running_total(rows: DataFrame, group: str, order: list, value: str, name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before each in its group. The order is range-partitioned: totals of
    partitions first, then sums within each."""
    order = [F.col(group), *order]
    dealt = scratch.table(rows.repartitionByRange(*order).withColumn("_task", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy(group, "_task").agg(F.sum(value).alias("_sum"))  # a row a partition, and one more a group
    earlier = F.sum("_sum").over(Window.partitionBy(group).orderBy("_task")) - F.col("_sum")
    within = F.sum(value).over(Window.partitionBy(group, "_task").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return dealt.withColumn("_within", within).join(sums.select(group, "_task", earlier.alias("_earlier")), [group, "_task"]).withColumn(name, F.col("_within") + F.col("_earlier")).drop("_task", "_within", "_earlier")


def splitting_tree(quotas: DataFrame, depth: int, seed: int, scratch: Scratch) -> DataFrame:
    """From one row with ``quotas`` (array of block counts by source) to 2 ** depth rows (shard, quotas)."""
    level = quotas.select(F.lit(0).cast("long").alias("shard"), "quotas")
    u = f"(pmod(xxhash64({seed}L, shard, k, {{d}}), {1 << 53}L) / {float(1 << 53)}D)"
    for d in range(depth):
        pick = _hypergeometric("f.pool", "quotas[k]", "f.draws", u.format(d=d))
        left = f"""aggregate(sequence(0, size(quotas) - 1), named_struct('pool', n, 'draws', n div 2L, 'got', cast(array() as array<bigint>)),
            (f, k) -> transform(array({pick}), g -> named_struct('pool', f.pool - quotas[k], 'draws', f.draws - g, 'got', concat(f.got, array(g))))[0], f -> f.got)"""
        level = level.withColumn("n", F.expr("aggregate(quotas, 0L, (a, q) -> a + q)")).withColumn("part", F.expr(left))
        halves = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("part").alias("quotas")), F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("quotas", "part", lambda q, g: q - g).alias("quotas")))
        level = level.select(F.explode(halves).alias("h")).select("h.shard", "h.quotas")
        if d % 6 == 5:
            level = scratch.table(level.repartition("shard"), "level")
    return level


def _plan(sized: DataFrame, by_source: DataFrame, s: MixSettings, scratch: Scratch) -> DataFrame:
    """One row a block: source_no, block, draws array<(pass, shard, words)>, cut (words of a pass that ends in it)."""
    blocks = sized.groupBy("source_no", "block").agg(F.sum("size").alias("words"))
    # integers from here on: the words a source gives, its whole passes, the words of the last pass
    goal = F.round("target").cast("long")
    per = by_source.filter("source_size > 0").select("source_no", "source_size", (goal / F.col("source_size")).cast("long").alias("full"), F.pmod(goal, F.col("source_size")).alias("rest"))
    permuted = running_total(blocks.filter("words > 0"), "source_no", [F.xxhash64(F.lit(s.seed + 1), "block"), F.col("block")], "words", "before", scratch)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("rest") - F.col("before")))
    passes = F.transform(F.sequence(F.lit(0), F.col("full").cast("int")), lambda i: F.struct(i.alias("pass"), F.when(i < F.col("full"), F.col("words")).otherwise(F.col("part")).alias("words")))
    draws = permuted.join(per, "source_no").withColumn("part", part).withColumn("draw", F.explode(passes)).select("source_no", "block", "draw.pass", "draw.words", (F.col("draw.words") < F.col("words")).alias("is_cut"), F.lit(1).cast("long").alias("one")).filter("words > 0")
    draws = scratch.table(draws, "draws")
    total = draws.agg(F.sum("words")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1.0, total / s.shard_words))))
    counts = draws.groupBy("source_no").agg(F.count("*").alias("q"))  # a row a source
    root = scratch.table(counts.agg(F.array_sort(F.collect_list(F.struct("source_no", "q"))).alias("c")).select(F.transform("c", lambda x: x["source_no"]).alias("sources"), F.transform("c", lambda x: x["q"]).alias("quotas")), "root")
    leaves = splitting_tree(root.select("quotas"), depth, s.seed + 2, scratch)
    runs = leaves.select("shard", F.posexplode("quotas").alias("at", "q")).join(root.select(F.posexplode("sources").alias("at", "source_no")), "at").filter("q > 0").select("source_no", "shard", "q")
    # each shard takes a run of a source's permuted draws
    runs = running_total(runs, "source_no", [F.col("shard")], "q", "start", scratch)
    places = runs.select("source_no", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("q") - 1)).alias("place"))
    placed = running_total(draws, "source_no", [F.xxhash64(F.lit(s.seed + 3), "block", "pass"), F.col("block"), F.col("pass")], "one", "place", scratch).join(places, ["source_no", "place"])
    rows = placed.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "words", "is_cut"))).alias("draws"))
    return scratch.table(rows, "plan")


def assign(docs: DataFrame, settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of ``docs`` as ``row``, with size, source_size, target, taken and draws array<(pass, shard, words)>.

    Of the one block in which a source's last pass ends, documents are taken in hashed order until the words are
    used up; the last of them is cut. So a source's taken words are its target, rounded.
    """
    s, scratch = settings, Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    by_source = scratch.table(targets(rows.select("source", "size"), s), "sources")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / s.block_words)).cast("long")
    mark = F.xxhash64(F.lit(s.seed), "id", F.when(F.col("id").isNull(), F.col(f"row.`{text_col}`")))
    keyed = rows.join(by_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("block", F.pmod(mark, n_blocks))
    plan = _plan(keyed.select("source_no", "block", "size"), by_source, s, scratch)
    joined = keyed.join(plan, ["source_no", "block"], "left")
    is_cut = F.coalesce(F.exists("draws", lambda d: d["is_cut"]), F.lit(False))
    whole = joined.filter(~is_cut).withColumn("before", F.lit(0).cast("long"))
    in_order = Window.partitionBy("source_no", "block").orderBy(unit_hash(s.seed + 4, F.col("id")), "id", "size")
    ends = joined.filter(is_cut).withColumn("before", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    taken = lambda d: F.when(d["is_cut"], F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), d["words"] - F.col("before")))).otherwise(F.col("size"))
    draws = F.filter(F.transform(F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:bigint,words:bigint,is_cut:boolean>>")), lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), taken(d).alias("words"))), lambda d: d["words"] > 0)
    both = whole.unionByName(ends).withColumn("draws", draws)
    return both.select("row", "id", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"), "draws")


def mix(docs: DataFrame, settings: MixSettings = MixSettings(), text_col: str = "text", **names: str) -> DataFrame:
    """The mixed corpus: the columns of ``docs`` with mix_pass, mix_shard, mix_words; one row a draw, shuffled within shards.

    A cut document keeps its first mix_words words and the text up to the end of the last.
    """
    rows = assign(docs, settings, text_col=text_col, **names).withColumn("d", F.explode("draws"))
    text = F.col(f"row.`{text_col}`")
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # one word each, with the space before it
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("d.words").cast("int")), "")
    kept = [c for c in docs.columns if c not in ("mix_pass", "mix_shard", "mix_words")]
    columns = [(F.when(F.col("d.words") < F.col("size"), cut).otherwise(text) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in kept]
    out = rows.select(*columns, F.col("d.pass").alias("mix_pass"), F.col("d.shard").alias("mix_shard"), F.col("d.words").alias("mix_words"), unit_hash(settings.seed + 5, F.col("id"), F.col("d.pass")).alias("_place"))
    return out.repartitionByRange("mix_shard", "_place").sortWithinPartitions("mix_shard", "_place").drop("_place")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", F.size("draws").alias("n_draws"))
