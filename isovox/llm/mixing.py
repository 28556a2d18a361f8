"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks, with DataFrame functions only.

Targets share a token budget by weight, none above ``most`` times its source's size. The budget is cut into
blocks of ``block`` tokens. Highest quotients v / (2k - 1) give each source its number of blocks, and each
source's shards their integer quotas. Within a shard the documents stand in a seeded order on a line of tokens,
and the shard takes its quota of blocks from that line, again from its start after the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from isovox.llm.quality_rules import WORD
from isovox.store import fresh, written

BLOCK = 16
SHARD_ROWS = 256
BUCKETS = 65536
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def draw(docs: DataFrame, seed: str = SEED) -> Column:
    """The seeded order: an md5 of the seed and the id; of rows without an id, of all they hold that has a hash.

    So rows without an id, however many, are spread over the shards as others are.
    """
    rest = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not _has_map(f.dataType)])
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), rest.cast("string"))).cast("binary"))


def _has_map(kind: DataType) -> bool:
    """Whether Spark can't hash it."""
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def bucket(drawn: Column) -> Column:
    return F.conv(F.substring(drawn, 1, 4), 16, 10).cast("int")


def targets(sources: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2) -> DataFrame:
    """One row per source (source, size): its weight by rank, and its target.

    Where ``level`` times the weight is above ``most`` times the size, the target is the latter and the excess
    goes to the others by weight: in order of size over weight, the first sources are at their cap.
    """
    every = W.partitionBy(F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("size") * most)
    line = every.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(line.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    # The first source in that order that stays under its cap sets the level for all after it.
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(line).alias("at"), F.col("level")))).over(every)["level"])
    return ranked.select("source", "rank", F.col("size").alias("source_size"), F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def sainte_lague(df: DataFrame, group: list[str], votes: str, seats: str, tie: str) -> DataFrame:
    """``df`` with a column ``quota``: whole numbers that add up to ``seats`` in each group, by highest quotients.

    With n rows and N seats, the divisor that gives N is within 1 -+ n / 2N of the plain share's. The seats below
    that range are given at once; at most about 3n quotients are left to rank.
    """
    one = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    share = F.when(F.col("_all") > 0, F.col(votes) * F.col(seats) / F.col("_all")).otherwise(F.lit(0.0))
    off = F.col("_n") / (2.0 * F.greatest(F.col(seats), F.lit(1)))
    ranged = df.withColumns({"_all": F.sum(votes).over(one).cast("double"), "_n": F.count(F.lit(1)).over(one)})
    ranged = ranged.withColumn("_share", share).withColumns({"_low": F.greatest(F.lit(0), F.floor(F.col("_share") * (1 - off) + 0.5) - 1).cast("long"), "_high": (F.floor(F.col("_share") * (1 + off) + 0.5) + 2).cast("long")})
    ranged = ranged.withColumn("_left", F.col(seats) - F.sum("_low").over(one))
    tried = ranged.withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    tried = tried.withColumn("_place", F.row_number().over(one.orderBy((F.col(votes) / (2.0 * F.col("_k") - 1)).desc(), F.col(tie))))
    won = (F.col("_place") <= F.col("_left")) & (F.col(votes) > 0)
    return tried.groupBy(*df.columns).agg((F.first("_low") + F.sum(won.cast("long"))).alias("quota"))


def with_taken(docs: DataFrame, size: Column, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2, block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: str = SEED) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` (doc_id, source and any others) with size, source_size, target and taken under fresh names.

    Null sources are one source, the last; a null or empty text has size 0 and takes nothing; repeated rows
    stand side by side in the seeded order and are taken each alone. A source of size 0 has target 0. Texts of any
    length count whole. An empty table gives an empty table. The order depends on ids alone (on the row's own values
    where it has none), so reruns agree. Targets are ranked over one row a source, in one task.
    """
    p = fresh(docs, "mix")
    c = lambda x: F.col(p + x)
    df = docs.withColumn(p + "size", size).withColumn(p + "draw", draw(docs, seed)).withColumn(p + "bucket", bucket(c("draw")))
    cells = written(df.groupBy(F.col("source"), c("bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(c("size")).alias("size")), "mix-cells")
    goal = targets(cells.groupBy("source").agg(F.sum("size").alias("size")), share, weights, most)
    total = goal.withColumn("blocks", F.greatest(F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block).cast("long"), F.lit(1)))
    goal = sainte_lague(total, [], "target", "blocks", "rank").select("source", "rank", "source_size", "target", F.col("quota").alias("blocks"))
    rows = cells.groupBy("source").agg(F.sum("n").alias("rows"))
    n_shards = F.greatest(F.lit(1), F.least(F.lit(BUCKETS), F.ceil(F.col("rows") / shard_rows)))
    goal = written(goal.join(rows.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("source", "rank", "source_size", "target", "blocks", n_shards.cast("long").alias("shards")), "mix-goal")
    shard_of = lambda b, n: F.floor(b * n / BUCKETS).cast("long")
    shards = cells.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).groupBy("rank", shard_of(F.col("bucket"), F.col("shards")).alias("shard")).agg(F.sum("size").alias("tokens"), F.first("blocks").alias("blocks"))
    quotas = sainte_lague(shards, ["rank"], "tokens", "blocks", "shard").select(F.col("rank").alias(p + "r"), F.col("shard").alias(p + "h"), F.col("tokens").alias(p + "tokens"), F.col("quota").alias(p + "quota"))
    named = goal.select(F.col("source").alias(p + "s"), *[F.col(x).alias(p + x) for x in ("rank", "source_size", "target", "shards")])
    placed = df.join(named, df["source"].eqNullSafe(c("s"))).withColumn(p + "shard", shard_of(c("bucket"), c("shards")))
    placed = placed.join(quotas, (c("rank") == c("r")) & (c("shard") == c("h")))
    line = W.partitionBy(p + "rank", p + "shard").orderBy(p + "draw", "doc_id", p + "size")
    before = F.coalesce(F.sum(c("size")).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    take = F.least(c("quota") * block, c("tokens") * most)
    passes = F.when(c("tokens") > 0, F.floor(take / c("tokens"))).otherwise(F.lit(0)).cast("long")
    rest = take - passes * c("tokens")
    placed = placed.withColumn(p + "taken", (passes * c("size") + F.greatest(F.lit(0), F.least(c("size"), rest - before))).cast("long"))
    made = ["size", "source_size", "target", "taken"]
    return placed.select(*docs.columns, *[p + m for m in made]), {m: p + m for m in made}


def mixed_documents(docs: DataFrame, size: Column | None = None, **how) -> DataFrame:
    """The mix itself: each row as often as its taken words fill it, half or more of a text counting as all of it."""
    df, name = with_taken(docs, n_words(F.col("text")) if size is None else size, **how)
    copies = F.floor(F.col(name["taken"]) / F.greatest(F.col(name["size"]), F.lit(1)) + 0.5).cast("int")
    return df.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), copies)).alias(fresh(docs, "copy"))).select(*docs.columns)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words(F.col("text")).alias("words"))
    df, name = with_taken(written(docs, "mix-sizes"), F.col("words"))
    return df.select("doc_id", *[F.col(name[m]).alias(m) for m in ("size", "source_size", "target", "taken")])


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('{SEED}:' || doc_id::VARCHAR) AS draw FROM documents),
b AS (SELECT *, ('0x' || substr(draw, 1, 4))::INT AS bucket FROM d),
s AS (SELECT source, sum(size)::BIGINT AS size, count(*) AS n_rows FROM b GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, 2 * size AS cap FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
l AS (SELECT *, row_number() OVER o AS nth,
        ((sum(size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
          / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, rank)),
f AS (SELECT level AS lv FROM l WHERE level * weight <= cap ORDER BY nth LIMIT 1),
t AS (SELECT source, rank, size AS source_size, n_rows, CASE WHEN (SELECT lv FROM f) IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, (SELECT lv FROM f) * weight) END AS target FROM l),
n AS (SELECT greatest(round(sum(target) / {BLOCK})::BIGINT, 1) AS blocks FROM t),
tk AS (SELECT rank, target / (2.0::DOUBLE * k - 1) AS q FROM t, n, range(1, 3 + floor(target / {BLOCK} * 1.001)::BIGINT + 20) AS x(k) WHERE target > 0),
tw AS (SELECT rank, count(*) AS blocks FROM (SELECT rank, row_number() OVER (ORDER BY q DESC, rank) AS place FROM tk), n WHERE place <= n.blocks GROUP BY 1),
g AS (SELECT t.*, coalesce(tw.blocks, 0) AS blocks, greatest(1, least({BUCKETS}, ceil(n_rows / {SHARD_ROWS}.0)))::BIGINT AS shards FROM t LEFT JOIN tw USING (rank)),
p AS (SELECT b.doc_id, b.size, b.draw, g.rank, g.source_size, g.target, g.blocks, floor(b.bucket * g.shards / {BUCKETS}.0)::BIGINT AS shard FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source),
h AS (SELECT rank, shard, sum(size)::BIGINT AS tokens, any_value(blocks) AS blocks FROM p GROUP BY 1, 2),
hs AS (SELECT *, sum(tokens) OVER (PARTITION BY rank) AS every FROM h),
hk AS (SELECT rank, shard, blocks, tokens::DOUBLE / (2.0::DOUBLE * k - 1) AS q FROM hs, range(1, (CASE WHEN every > 0 THEN ceil(tokens * blocks / every) ELSE 0 END)::BIGINT + 40) AS x(k) WHERE tokens > 0),
hw AS (SELECT rank, shard, count(*) AS quota FROM (SELECT rank, shard, blocks, row_number() OVER (PARTITION BY rank ORDER BY q DESC, shard) AS place FROM hk) WHERE place <= blocks GROUP BY 1, 2),
z AS (SELECT p.*, h.tokens, least(coalesce(hw.quota, 0) * {BLOCK}, 2 * h.tokens)::BIGINT AS take,
        coalesce(sum(p.size) OVER (PARTITION BY p.rank, p.shard ORDER BY p.draw, p.doc_id, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM p JOIN h USING (rank, shard) LEFT JOIN hw USING (rank, shard))
SELECT doc_id, size, source_size, target,
       CASE WHEN tokens = 0 THEN 0 ELSE (take // tokens) * size + greatest(0, least(size, take - (take // tokens) * tokens - before)) END::BIGINT AS taken
FROM z"""
