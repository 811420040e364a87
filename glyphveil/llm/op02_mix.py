"""Mixing sources to target weights, with DataFrame operations alone.

Every document gets a hash-random key. Keys are cut into equal ranges, so that the documents of one
source, even of a hot one, lie in many ranges; within a range they are sorted by key. The ranges'
totals give each range's offset, so a document's prefix sum is its range's offset plus the sum before
it in its range. A source's budget takes whole epochs of the source first; the rest is cut exactly at
the prefix sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphveil.llm.common import staged

WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix takes, and how often a source may be taken at most: 150 % and twice.
SHARE_PERCENT = 150
MOST = 2


def word_count(text: Column) -> Column:
    """Runs without blanks (space, U+0009 to U+000D) in a text, null as 0: each run with the blanks around it becomes one sign, then signs are counted."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def mix_key(doc_id: Column) -> Column:
    """The hash-random order of documents: md5 of the id as text, null last."""
    return F.coalesce(F.md5(doc_id.cast("string").cast("binary")), F.lit("g"))


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, source_size) with target (double): the share by weight, stopped at MOST sizes, the excess reshared.

    Sources by code point, null last, take the weights in turn. Resharing until none is above ends
    where each target is the lesser of its cap and weight times one level. Sorted by cap over weight,
    the sources below the level come first, and the level follows from sums over those before. The
    windows run over sources, one row each, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * MOST)
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
        F.sum("source_size").over(every).alias("all"),
    )
    # In hundredths, all whole numbers: what is left for this source and those after it.
    left = F.expr(f"{SHARE_PERCENT} * `all` - 100 * caps")
    ranked = ranked.withColumn("left", left).withColumn("capped", F.expr("100 * cap * left_weight <= left * weight"))
    level = F.first(F.when(~F.col("capped"), F.struct("left", "left_weight")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    share = F.col("weight").cast("double") * F.col("level.left").cast("double") / (F.lit(100.0) * F.col("level.left_weight"))
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size) of every document, staged: the texts are read once."""
    return staged(docs.select("doc_id", "source", word_count(F.col(text)).alias("size")), "sizes")


def source_targets(sizes: DataFrame) -> DataFrame:
    """targets() of the staged sizes, staged too: one row a source."""
    return staged(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")


def takes(sizes: DataFrame, goals: DataFrame, rows_a_range: int = 1000) -> DataFrame:
    """(doc_id, source, size, source_size, target, key, prefix, taken) of every document.

    taken counts words with repeats: whole epochs, and of the last one what lies before the budget.
    The number of key ranges follows the rows, up to 65,536; the result doesn't depend on it.
    """
    bits = min(16, max(4, (sizes.count() // rows_a_range).bit_length()))
    keyed = sizes.withColumn("key", mix_key(F.col("doc_id")))
    # The first four hexadecimal digits of the key, cut to `bits` bits; a null id's key is the last range.
    keyed = keyed.withColumn("range", F.coalesce(F.expr(f"CAST(conv(substr(`key`, 1, 4), 16, 10) AS INT) DIV {1 << (16 - bits)}"), F.lit(1 << bits)))
    keyed = keyed.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(1 << bits)).otherwise(F.col("range")))
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    totals = sizes.select("source", "size", mix_key(F.col("doc_id")).alias("key"), F.col("doc_id").isNull().alias("none"))
    totals = totals.groupBy("source", F.when(F.col("none"), F.lit(1 << bits)).otherwise(F.expr(f"CAST(conv(substr(`key`, 1, 4), 16, 10) AS INT) DIV {1 << (16 - bits)}")).alias("range")).agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("offset"))
    placed = keyed.join(offsets, keyed["source"].eqNullSafe(offsets["o_source"]) & (keyed["range"] == offsets["o_range"])).drop("o_source", "o_range", "range")
    goals = goals.select(F.col("source").alias("g_source"), "source_size", "target")
    placed = placed.join(goals, placed["source"].eqNullSafe(goals["g_source"])).drop("g_source")
    epochs = F.expr("if(source_size > 0, CAST(round(target) AS BIGINT) DIV source_size, 0L)")
    placed = placed.withColumn("prefix", F.col("offset") + F.col("within")).withColumn("epochs", epochs)
    rest = F.expr("CAST(round(target) AS BIGINT) - epochs * source_size - prefix")
    placed = placed.withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest)))
    return placed.select("doc_id", "source", "size", "source_size", "target", "key", "prefix", "epochs", "taken")


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken and more.

    A null text has size 0, a null source is a source, repeated rows count each, ties of the key go by
    size; an empty table gives none; other columns of docs aren't read.
    """
    sizes = sized(docs, text)
    return takes(sizes, source_targets(sizes))


def mixed_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: rows of docs, repeated by epoch, with the columns of docs.

    The document at which a source's budget ends is taken once more if half of it or more lies before
    the end. Only the place of that end, a row for each source, is joined to the documents, so no text
    is shuffled.
    """
    sizes = sized(docs, text)
    rows = takes(sizes, source_targets(sizes))
    at = F.when(F.col("taken") - F.col("epochs") * F.col("size") > 0, F.struct("key", (2 * (F.col("taken") - F.col("epochs") * F.col("size")) >= F.col("size")).alias("whole")))
    ends = staged(rows.groupBy(F.col("source").alias("__gv_source")).agg(F.max("epochs").alias("__gv_epochs"), F.max(at).alias("__gv_last")), "ends")
    key = mix_key(F.col("doc_id"))
    more = F.when(key < F.col("__gv_last.key"), 1).when((key == F.col("__gv_last.key")) & F.col("__gv_last.whole"), 1).otherwise(0)
    joined = docs.join(ends, docs["source"].eqNullSafe(ends["__gv_source"]))
    times = (F.col("__gv_epochs") + more).cast("int")
    return joined.withColumn("__gv_times", times).where("__gv_times > 0").withColumn("__gv_time", F.explode(F.sequence(F.lit(1), F.col("__gv_times")))).select(*[docs[c] for c in docs.columns])


_TARGET_CTES = r"""
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM totals),
b AS (SELECT *, coalesce(sum(cap) OVER lower, 0)::BIGINT AS caps, (sum(weight) OVER () - coalesce(sum(weight) OVER lower, 0))::BIGINT AS left_weight, (sum(source_size) OVER ())::BIGINT AS total
  FROM w WINDOW lower AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 150 * total - 100 * caps AS rest, 100 * cap * left_weight <= (150 * total - 100 * caps) * weight AS capped FROM b),
goal AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight::DOUBLE * (SELECT arg_min(rest, caps) FROM c WHERE NOT capped)::DOUBLE / (100.0::DOUBLE * (SELECT arg_min(left_weight, caps) FROM c WHERE NOT capped)) END AS target FROM c),
kept AS (SELECT d.*, g.source_size, g.target, coalesce(md5(d.doc_id::VARCHAR), 'g') AS mixkey,
    CASE WHEN g.source_size > 0 THEN round(g.target)::BIGINT // g.source_size ELSE 0 END AS epochs
  FROM sizes d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
pre AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY mixkey, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix FROM kept),
taken AS (SELECT *, epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - prefix)) AS taken FROM pre)
"""

SQL = rf"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
{_TARGET_CTES}
SELECT doc_id, size, source_size, target, taken FROM taken
"""
