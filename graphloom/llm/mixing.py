"""Mixing sources to target weights, in fixed-length blocks of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._shared import Scratch

#: Words of a block, blocks of an output shard, and documents of one stretch of a source's sequence (on average).
BLOCK, SHARD, STRETCH = 64, 4096, 10_000
#: Weights of the sources by code point, repeating, null last; a target is at most CAP times its source's size.
WEIGHTS, CAP = (5, 2, 1), 3
#: Slots that one row unfolds to, so that a large source's slots come from many rows.
RUN = 1 << 16
#: Tasks that runs unfold in, at most.
TASKS = 10_000
#: Primes, of which one that doesn't divide the number of blocks is a source's multiplier.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def draw(*parts: Column) -> Column:
    """A pseudorandom long of 60 bits from values, the same in any engine that has MD5."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes(source, source_size), a row per source, with target.

    Shares of the total by weight; a target stops at cap times its size and the excess is shared again by weight until
    none is above. That ends where target = min(cap * size, level * weight), for the level at which targets add up:
    sources fill up in the order of cap * size / weight, and the first that doesn't fixes the level of all that follow.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    rows = rows.withColumn("ratio", F.col("full") / F.col("weight"))
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    due = F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(filled), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    rows = rows.withColumn("level", due / left)
    rows = rows.withColumn("open", F.when(F.col("full") > F.col("level") * F.col("weight"), F.struct("ratio", F.col("source").isNull(), "source", "level")))
    level = F.min("open").over(everything)["level"]
    target = F.coalesce(F.least("full", level * F.col("weight")), F.col("full"))
    return rows.select("source", "source_size", target.alias("target"))


def packed(rows: DataFrame, stretches: int) -> DataFrame:
    """rows(doc_id, source, size) with `begin`, the place of each row's first word in its source's sequence, and `row`,
    its number within (source, stretch).

    The sequence goes by stretch, which the id's hash gives, then by id and size. Stretches are summed first and only
    their sums accumulate over a source, so a source of any size is spread over all tasks.
    """
    rows = rows.withColumn("stretch", draw(F.col("doc_id")) % F.lit(stretches))
    sums = rows.groupBy("source", "stretch").agg(F.sum("size").alias("held"))
    upto = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("held").over(upto), F.lit(0))).drop("held")
    inside = Window.partitionBy("source", "stretch").orderBy("doc_id", "size")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("row", F.row_number().over(inside))
    r, s = rows.alias("r"), sums.alias("s")
    both = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.stretch") == F.col("s.stretch")))
    return both.select("r.*", (F.col("start") + F.col("before")).alias("begin")).drop("before")


def slots(sources: DataFrame, words: int, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(shard, place, source, block, words, length): the output's slots, from sources(source, source_size, target).

    Each slot of a source draws its output shard, so the source's counts over shards are multinomial, and a shard's counts
    by source are, conditioned on the sources' totals: those are the targets and not merely near them. place orders the
    slots of a shard, drawn too. The j-th slot of a source takes the block at place j of its pass: the full blocks in the
    order of the source's pseudorandom permutation x -> (a x + b) mod full, a prime, then the short last block. Every pass
    takes each block once; the last slot takes only the words that the target still lacks.
    """
    runs = int(words // (block * RUN)) + 1
    s = sources.where("source_size > 0 and target > 0").withColumn("due", F.round("target").cast("bigint"))
    s = s.withColumn("full", F.floor(F.col("source_size") / block).cast("bigint"))
    s = s.withColumn("tail", F.col("source_size") - F.col("full") * block)
    s = s.withColumn("blocks", F.col("full") + F.when(F.col("tail") > 0, 1).otherwise(0))
    s = s.withColumn("passes", F.floor(F.col("due") / F.col("source_size")).cast("bigint"))
    s = s.withColumn("rest", F.col("due") - F.col("passes") * F.col("source_size"))
    s = s.withColumn("total", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("bigint")).where("total > 0")
    own = draw(F.col("source"), F.lit("permutation"))
    primes = F.filter(F.array(*[F.lit(p) for p in PRIMES]).cast("array<bigint>"), lambda p: F.greatest("full", F.lit(1)) % p != 0)
    s = s.withColumn("a", F.element_at(primes, (own % F.size(primes) + 1).cast("int"))).withColumn("b", own)
    s = s.withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / RUN).cast("bigint"))))
    s = s.repartition(max(1, min(runs, TASKS)), "source", "r")
    s = s.withColumn("j", F.explode(F.sequence(F.col("r") * RUN, F.least(F.col("total"), (F.col("r") + 1) * RUN) - 1)))
    p = F.col("j") % F.col("blocks")
    x = F.col("a").cast("decimal(10,0)") * p.cast("decimal(19,0)") + F.col("b").cast("decimal(19,0)")  # may pass 2^63
    s = s.withColumn("p", p).withColumn("block", F.when(p < F.col("full"), (x % F.greatest("full", F.lit(1)).cast("decimal(19,0)")).cast("bigint")).otherwise(F.col("full")))
    length = F.when(F.col("p") < F.col("full"), F.lit(block)).otherwise(F.col("tail"))
    whole = F.col("j") < F.col("passes") * F.col("blocks")
    taken = F.when(whole, length).otherwise(F.least(length, F.col("rest") - F.col("p") * block)).cast("bigint")
    shards = max(1, -(-words // (block * shard)))
    drawn = draw(F.col("source"), F.col("j"))
    place = F.floor(drawn / shards).cast("bigint").alias("place")
    return s.select((drawn % F.lit(shards)).alias("shard"), place, "source", "block", taken.alias("words"), length.cast("bigint").alias("length"))


class Mix:
    """A mix of documents: its blocks, and what it takes of each document.

    A source's words are packed into blocks of `block` words. Null texts have size 0; a null source is a source; rows
    that repeat an id are rows of their own, in the order of id and size (of equal ones any first). Sources, draws and
    permutations depend on the rows alone, so reruns agree. One huge document is cut over many blocks, one source over
    many stretches, so neither gathers in one task.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, shard: int = SHARD, stretch: int = STRETCH):
        self.block, scratch = block, Scratch(docs.sparkSession, "mix")
        rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
        rows = scratch.keep(rows, "sizes")
        count, words = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        self.sources = scratch.keep(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
        self.placed = scratch.keep(packed(rows, max(1, count // stretch)), "packed")
        self.slots = slots(self.sources, words, block, shard)

    def blocks(self) -> DataFrame:
        """(shard, place, source, block, doc_id, stretch, row, first, words): the mix itself. Shards hold their slots in
        the order of place; a slot holds the pieces of its block by (stretch, row), each `words` words of a document from
        its word `first` on, counted from 0."""
        block = self.block
        last = F.floor((F.col("begin") + F.col("size") - 1) / block)
        parts = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), last)))
        start = F.greatest(F.col("begin") - F.col("block") * block, F.lit(0))
        end = F.least(F.col("begin") + F.col("size") - F.col("block") * block, F.lit(block))
        first = F.greatest(F.col("block") * block - F.col("begin"), F.lit(0))
        parts = parts.select("doc_id", "source", "stretch", "row", "block", first.alias("first"), start.alias("start"), end.alias("end"))
        # Both sides grow with the documents, which the size of the few sources that slots unfold from does not show.
        p, s = parts.alias("p"), self.slots.hint("merge").alias("s")
        both = p.join(s, F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.block") == F.col("s.block")))
        both = both.withColumn("held", F.least("end", "words") - F.col("start")).where("held > 0")
        return both.select("shard", "place", "p.source", "p.block", "doc_id", "stretch", "row", F.col("first").cast("bigint").alias("first"), F.col("held").cast("bigint").alias("words"))

    def taken(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken) of every row; taken sums the words of the mix's blocks.

        Each source's taken words are its target, rounded; no row exceeds `cap` times its size (rounded targets aside).
        """
        taken = self.blocks().groupBy("source", "stretch", "row").agg(F.sum("words").alias("taken"))
        d, t, s = self.placed.alias("d"), taken.hint("merge").alias("t"), self.sources.alias("s")
        here = F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.stretch") == F.col("t.stretch")) & (F.col("d.row") == F.col("t.row"))
        out = d.join(t, here, "left").join(s, F.col("d.source").eqNullSafe(F.col("s.source")))
        return out.select("doc_id", "d.source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """What a mix takes of each document: Mix(docs).taken()."""
    return Mix(docs, **options).taken()


MIX_SQL = """
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
st AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-')), 1, 15))::BIGINT % greatest(1, (SELECT count(*) FROM docs) // 10000) AS stretch FROM docs),
placed AS (SELECT *, row_number() OVER w AS row, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM st WINDOW w AS (PARTITION BY source ORDER BY stretch, doc_id, size)),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
wt AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 3.0::DOUBLE AS full_at FROM sizes),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(full_at) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
    FROM wt WINDOW f AS (ORDER BY full_at / w, source NULLS LAST)),
fixed AS (SELECT arg_min(level, full_at / w) AS level FROM lv WHERE full_at > level * w),
tg AS (SELECT source, source_size, coalesce(least(full_at, (SELECT level FROM fixed) * w), full_at)::DOUBLE AS target FROM lv),
sp AS (SELECT *, round(target)::BIGINT AS due, source_size // 64 AS nfull, source_size % 64 AS tail,
    ('0x' || substr(md5(coalesce(source, '-') || ':permutation'), 1, 15))::BIGINT AS own FROM tg WHERE source_size > 0 AND target > 0),
sq AS (SELECT *, nfull + (tail > 0)::BIGINT AS blocks, due // source_size AS passes, due % source_size AS rest,
    list_filter([2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497], lambda p: greatest(nfull, 1) % p <> 0) AS primes FROM sp),
sl AS (SELECT *, unnest(generate_series(0, passes * blocks + (rest + 63) // 64 - 1)) AS j FROM sq),
sb AS (SELECT *, j % blocks AS p FROM sl),
sw AS (SELECT source, CASE WHEN p < nfull THEN ((primes[(own % len(primes) + 1)::INT]::HUGEINT * p + own) % greatest(nfull, 1))::BIGINT ELSE nfull END AS block,
    CASE WHEN p < nfull THEN 64 ELSE tail END AS length, j < passes * blocks AS whole, rest - p * 64 AS lacks FROM sb),
us AS (SELECT source, block, count(*) FILTER (whole OR lacks >= length) AS times, coalesce(max(lacks) FILTER (NOT whole AND lacks < length), 0) AS prefix FROM sw GROUP BY source, block),
parts AS (SELECT *, unnest(generate_series(start // 64, (start + size - 1) // 64)) AS block FROM placed WHERE size > 0),
cut AS (SELECT source, row, block, greatest(start - block * 64, 0) AS s, least(start + size - block * 64, 64) AS e FROM parts),
tk AS (SELECT c.source, c.row, sum(times * (e - s) + greatest(least(e, prefix) - s, 0))::BIGINT AS taken FROM cut c JOIN us u ON c.source IS NOT DISTINCT FROM u.source AND c.block = u.block GROUP BY c.source, c.row)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM placed d JOIN tg t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN tk k ON d.source IS NOT DISTINCT FROM k.source AND d.row = k.row
"""
