"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Native: DataFrame functions and windows only. The text is read once to count words; everything after
works on (id, source, size) rows.

1. Targets: the total is shared by weight; a target stops at `most` times its source's size and the
   excess is shared again (water filling, in closed form over the sources ordered by size / weight).
2. Every source is cut into shards by a seeded hash (md5, so that any SQL engine can follow it), so that a hot source is many shards; a shard's
   documents lie on a line in seeded order, and the line is cut into equal blocks of about `block` words.
3. Sainte-Lague gives each source an integer number of blocks (highest quotients weight / (2 s - 1)), and
   in the same way each shard of a source its part of that number.
4. A shard with m blocks and quota q takes q div m whole passes, and in one more pass the blocks that a
   seeded permutation of 0..m-1 puts below q mod m. A document's taken words are those of its line in
   taken blocks.

Cases: a null text has size 0 and takes 0; a null source is a source (last); repeated rows are separate
documents of the line; null ids are documents of their own; a very long text is one document of the line; an empty table gives no rows; no column but id, source and text is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import Tables, cut

WORD = r"[^\x20\x09-\x0D]+"
#: Primes for the seeded permutation of a shard's blocks; one that does not divide m is coprime to it.
_PRIMES = (1_000_003, 998_244_353)


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(source, source_size, weight) with `target`: the water-filled share of `share` times all words."""
    caps = sources.withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = (
        caps.withColumn("__total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("__before", F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        # the level if the sources before this one are full; the right level is the first at which this one is not
        .withColumn("__level", (F.col("__total") - F.col("__before")) / F.col("__left"))
        .withColumn("__open", F.col("__level") * F.col("weight") <= F.col("__cap"))
        .withColumn("__final", F.min(F.when(F.col("__open"), F.struct(F.col("__before").alias("b"), F.col("__level").alias("l")))).over(everything)["l"])
    )
    level = F.coalesce(F.least(F.col("__cap"), F.col("__final") * F.col("weight")), F.col("__cap"))
    return filled.withColumn("target", level.cast("double")).drop("__cap", "__total", "__before", "__left", "__level", "__open", "__final")


def apportion(rows: DataFrame, group: list[str], seats: str, weight: str, tie: list[str]) -> DataFrame:
    """Sainte-Lague: `quota` for each row, summing to the group's `seats`, by highest quotients weight / (2 s - 1).

    The divisor that fills all seats lies so near weight sum / seats that a row's number of seats differs
    from its rounded share by no more than its part of half the number of rows; only that band of quotients
    is made and ranked, a number of rows in proportion to the number of items.
    """
    g = Window.partitionBy(*group)
    share = F.coalesce(F.try_divide(F.col(weight) * F.col(seats), F.sum(weight).over(g)), F.lit(0.0))
    band = F.ceil(F.coalesce(F.try_divide(F.col(weight), F.sum(weight).over(g)), F.lit(0.0)) * F.count("*").over(g) / 2) + F.lit(2)
    banded = rows.withColumn("__share", share).withColumn("__band", band)
    banded = banded.withColumn("__sure", F.greatest(F.lit(0).cast("long"), (F.floor("__share") - F.col("__band")).cast("long")))
    banded = banded.withColumn("__free", (F.col(seats) - F.sum("__sure").over(g)).cast("long"))
    seats_of = banded.withColumn("__s", F.explode(F.expr("sequence(__sure + 1, __sure + 2 * __band + 2)")))
    quotient = (F.col(weight) / (F.lit(2) * F.col("__s") - F.lit(1))).desc()
    ranked = seats_of.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(quotient, *[F.col(t).asc_nulls_last() for t in tie], "__s")))
    keys = list(dict.fromkeys([*group, *rows.columns]))
    won = F.when((F.col("__rank") <= F.col("__free")) & (F.col(weight) > 0), 1).otherwise(0)
    return ranked.groupBy(*keys).agg((F.max("__sure") + F.sum(won)).cast("long").alias("quota"))


def apportion_within(rows: DataFrame, seats: str, weight: str, ceiling: str, tie: list[str]) -> DataFrame:
    """Sainte-Lague of one group in which no row gets more than its `ceiling`; what a full row gives up is apportioned among the others.

    A row above its ceiling stays above it when others are held at theirs, so holding rows until none is above gives the exact apportionment.
    """
    held, open_ = None, cut(rows)
    while True:
        given = cut(apportion(open_, [], seats, weight, tie))
        full = given.where(F.col("quota") > F.col(ceiling))
        lost = full.agg(F.sum(ceiling)).first()[0]
        if lost is None:
            return given if held is None else given.unionByName(held)
        full = full.withColumn("quota", F.col(ceiling))
        held = full if held is None else held.unionByName(full)
        open_ = given.where(F.col("quota") <= F.col(ceiling)).drop("quota").withColumn(seats, (F.col(seats) - F.lit(lost)).cast("long"))


def plan(docs: DataFrame, seed: int = 7, block: int = 64, shard_words: int = 1 << 20, share: float = 1.5,
         weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0, key: str | None = None) -> DataFrame:
    """For each document: its size, source_size, target and place (offset on its shard's line, m blocks, shard words, quota).

    Sources by code point, nulls last, weigh `weights`, repeating. Of wide ids only a hash is kept: a `key` column then names the rows in their place.
    """
    tables = Tables(docs.sparkSession, "mixing")
    named = [F.col("doc_id")] if key is None else [F.col(key).alias("doc_id"), F.xxhash64("doc_id").alias("__d")]
    sizes = docs.select(
        *named, F.col("source"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), "text")).alias("__h"),  # the text parts the documents of one id, or of none
    )
    sizes = tables.store("sizes", sizes)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = targets(sources.withColumn("weight", weight), share, most)
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    # blocks are equal within a source: quota x (source_size / blocks) words are what a quota takes
    sources = sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)).cast("long"))
    sources = sources.withColumn("__w", F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0)))
    sources = sources.withColumn("__seats", F.round(F.sum("__w").over(everything)).cast("long"))
    sources = sources.withColumn("__most", F.floor(F.col("blocks") * F.lit(float(most))).cast("long"))
    sources = cut(apportion_within(sources, "__seats", "__w", "__most", ["source"]).drop("__seats", "__w", "__most").withColumnRenamed("quota", "source_quota"))

    placed = _join_source(sizes, sources).withColumn("shard", F.pmod(F.conv(F.substring("__h", 1, 15), 16, 10).cast("long"), F.col("shards")))
    shard_rows = placed.groupBy("source", "shard", "source_quota", "blocks", "source_size").agg(F.sum("size").alias("shard_size"))
    # the shards' blocks sum to their source's at least, and by weight m a quota of most * blocks gives each shard most * m: no quota exceeds that
    shard_rows = apportion(shard_rows.withColumn("__w", F.col("shard_size").cast("double")), ["source"], "blocks", "__w", ["shard"])
    shard_rows = shard_rows.withColumn("m", F.greatest(F.lit(1), "quota").cast("long")).drop("quota")
    shard_rows = apportion(shard_rows.withColumn("__w", F.col("m").cast("double")), ["source"], "source_quota", "__w", ["shard"])
    shard_rows = shard_rows.select(F.col("source").alias("__src"), F.col("shard").alias("__shard"), "shard_size", "m", "quota")
    line = Window.partitionBy("source", "shard").orderBy("__h", *([] if key is None else ["__d"]), F.col("doc_id"), F.col("size"))
    placed = placed.withColumn("offset", (F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).cast("long"))
    out = placed.join(shard_rows, F.col("source").eqNullSafe(F.col("__src")) & (F.col("shard") == F.col("__shard")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", "shard", "offset", "shard_size", "m", "quota")


def _join_source(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    right = sources.select(F.col("source").alias("__src"), "source_size", "target", "shards", "blocks", "source_quota")
    return sizes.join(right, F.col("source").eqNullSafe(F.col("__src")), "left").drop("__src")


def _cuts(k: str) -> str:
    """First word of block k of a shard's line: the line cut into m equal parts."""
    return f"floor({k} * (shard_size / m))"


def block_taken(k: str) -> str:
    """SQL condition: the partial pass of the shard takes block k."""
    a, b = _PRIMES
    step = f"(CASE WHEN m % {a} <> 0 THEN {a}L ELSE {b}L END)"
    return f"pmod({step} * ({k}) + shard * 7919L + 12345L, m) < quota % m"


def taken_words() -> Column:
    """Words of the document in taken blocks, repeats counted."""
    first, last = "greatest(CAST(floor(offset * (m / greatest(shard_size, 1))) AS BIGINT) - 1, 0L)", "least(CAST(floor((offset + size) * (m / greatest(shard_size, 1))) AS BIGINT) + 1, m - 1)"
    overlap = f"greatest(0L, least(offset + size, CASE WHEN k = m - 1 THEN shard_size ELSE CAST({_cuts('(k + 1)')} AS BIGINT) END) - greatest(offset, CAST({_cuts('k')} AS BIGINT)))"
    partial = f"aggregate(sequence({first}, {last}), 0L, (acc, k) -> acc + CASE WHEN {block_taken('k')} THEN {overlap} ELSE 0L END)"
    return F.expr(f"CASE WHEN size = 0 THEN 0L ELSE (quota DIV m) * size + {partial} END")


def taken_text(text: Column) -> Column:
    """The document's words in taken blocks of the partial pass, parted by single spaces."""
    word = f"offset + i >= CAST({_cuts('k')} AS BIGINT) AND (k = m - 1 OR offset + i < CAST({_cuts('(k + 1)')} AS BIGINT))"
    at = "CAST(floor((offset + i) * (m / greatest(shard_size, 1))) AS BIGINT)"
    taken = F.expr(f"transform(sequence(0L, greatest(size - 1, 0L)), i -> exists(array({at} - 1, {at}, {at} + 1), k -> k >= 0 AND k < m AND {word} AND {block_taken('k')}))")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.transform(F.filter(F.arrays_zip(words.alias("w"), taken.alias("t")), lambda e: e["t"]), lambda e: e["w"]), " ")


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the place columns of plan()."""
    return plan(docs, **settings).withColumn("taken", taken_words())
