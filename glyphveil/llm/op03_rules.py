"""Quality rules with thresholds that adapt to each language and source.

Counts of each whole text are taken in one pass and kept. Every rate of a document goes into a
mergeable quantile sketch of its language and source: a histogram whose bins are exact below 64 and
keep six leading bits above, so that two sketches merge by adding their counts, in any order, and a
quantile is off by a 32nd at most. Fences around the middle half of each sketch, with a slack, take
the place of fixed cutoffs; they are joined to the documents, which are kept inside all fences. The
sketch of a group with few documents says little, so such a group has the fences of its language,
whose sketch is the sum of its sources' sketches, or else those of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphveil.llm.common import BLANKS, by_place, others, quoted, staged, with_fields

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rates by name: numerator, denominator, units for one; whether low values fail too; slack in units.
RATES = {
    "symbols": ("n_symbols", "word_chars", 1000, False, 30),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, False, 400),
    "repeats": ("n_repeat_words", "n_words", 1000, False, 150),
    "word_length": ("word_chars", "n_words", 100, True, 150),
}
#: How many times the width of the middle half a fence lies beyond it.
REACH = 3
#: Documents with words that a group's own sketch needs.
LEAST = 100
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """COUNTS of one text. Words are runs without blanks, lines are split at \\n and count if they hold a word."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else [raw][: bool(n)]
    return n, chars, symbols, len(lines) - len(set(lines)), len(lines), repeated_words(words)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more, their first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    # A window's hash mixes its words' 64-bit hashes; equality is only needed within one text.
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    m = n - window + 1
    mix = np.zeros(m, dtype=np.uint64)
    for k in range(window):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + (codes[k : k + m] ^ (codes[k : k + m] >> np.uint64(29)))
    order = np.argsort(mix, kind="stable")
    ranked = mix[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(m, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    return int(np.minimum(np.diff(starts), window).sum()) + window


def quality_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with COUNTS (long) of every whole text; a null text counts as empty. No shuffle."""
    keep = others(docs, text, *COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([text_counts(t.as_py() or "") for t in batch.column(0)], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(got[:, i]) for i in range(len(COUNTS)))], names=[*keep, *COUNTS])

    picked = docs.select(F.col(text).alias("__gv_text"), *quoted(keep))
    return by_place(picked).mapInArrow(run, with_fields(docs.select(*quoted(keep)), ", ".join(f"{c} long" for c in COUNTS)))


def sketch_bin(v: Column) -> Column:
    """The upper end of a value's bin: exact below 64, six leading bits above."""
    drop = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return v.bitwiseOR(F.pow(F.lit(2), drop).cast("long") - 1)


def rate(name: str) -> Column:
    num, den, units, _, _ = RATES[name]
    return F.expr(f"if({den} > 0, ({units} * {num}) div {den}, 0L)")


def fences(counts: DataFrame, by: list[str]) -> DataFrame:
    """For each group of by: <rate>_low and <rate>_high for every rate, from the sketches of documents with words.

    The sketches are sums by group, rate and bin, combined before the shuffle; a group has a few
    thousand bins at most, whatever its rows. A group of fewer than LEAST documents takes the sketch
    of the longest prefix of by that has so many, or that of the whole table.
    """
    long = counts.where("n_words > 0").select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("rate"), sketch_bin(rate(n)).alias("bin")) for n in RATES])).alias("x"))
    own = long.groupBy(*by, F.col("x.rate").alias("rate"), F.col("x.bin").alias("bin")).agg(F.count("*").alias("n"))
    # Level k has the merged sketches of the first k columns; the others are null there.
    first = [F.when(F.col("level") > i, F.col(c)).alias(c) for i, c in enumerate(by)]
    levels = own.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(by)))))
    sketch = levels.select("level", *first, "rate", "bin", "n").groupBy("level", *by, "rate", "bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("level", *by, "rate")
    ranked = sketch.select("*", F.sum("n").over(whole.orderBy("bin")).alias("upto"), F.sum("n").over(whole).alias("all"))
    quarter = lambda q: F.min(F.when(F.expr(f"4 * upto >= {q} * `all`"), F.col("bin")))
    middle = ranked.groupBy("level", *by, "rate").agg(quarter(1).alias("q1"), quarter(3).alias("q3"), F.max("all").alias("all"))
    ends = []
    for name, (_, _, _, two, slack) in RATES.items():
        reach = F.expr(f"{REACH} * (q3 - q1) + {slack}")
        ends.append(F.max(F.when(F.col("rate") == name, F.col("q3") + reach)).alias(f"{name}_high"))
        if two:
            ends.append(F.max(F.when(F.col("rate") == name, F.col("q1") - reach)).alias(f"{name}_low"))
    limits = middle.groupBy("level", *by).agg(F.max("all").alias("docs"), *ends)
    level = F.lit(0)
    for k in range(1, len(by) + 1):
        level = F.when(F.sum("docs").over(Window.partitionBy(*by[:k])) >= LEAST, k).otherwise(level)
    groups = limits.where(F.col("level") == len(by)).select(*by, level.alias("level"))
    taken = limits.drop("docs").toDF("__gv_level", *[f"{c}_of" for c in by], *limits.columns[len(by) + 2 :])
    cond = F.col("level") == F.col("__gv_level")
    for c, x in zip(by, first, strict=True):
        cond = cond & x.eqNullSafe(F.col(f"{c}_of"))
    return groups.join(taken, cond).drop("level", "__gv_level", *[f"{c}_of" for c in by])


def quality_rules(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), text: str = "text") -> DataFrame:
    """docs without the text, with COUNTS, base_failed, kept and the fences that held.

    base_failed: under 20 words, or over 30 % of words in repeated windows of eight. kept: not
    base_failed, and all rates within the fences of the row's group, which are those of its first
    columns or of the table where it has fewer than LEAST documents. Null groups are groups of their
    own; a null or empty text fails; repeated rows are judged alike; an empty table gives none.
    Columns of docs named like one of the result are replaced, others stay.
    """
    docs = docs.drop("base_failed", "kept", *[f"{n}_{end}" for n in RATES for end in ("low", "high")])
    counts = staged(quality_counts(docs, text), "rules")
    on = [f"__gv_{c}" for c in by]
    limits = fences(counts.select(*[F.col(c).alias(k) for c, k in zip(by, on, strict=True)], *COUNTS), on)
    cond = None
    for c, k in zip(by, on, strict=True):
        x = counts[c].eqNullSafe(limits[k])
        cond = x if cond is None else cond & x
    joined = counts.join(limits, cond, "left")
    inside = F.lit(True)
    for name, (_, _, _, two, _) in RATES.items():
        inside = inside & (rate(name) <= F.col(f"{name}_high"))
        if two:
            inside = inside & (rate(name) >= F.col(f"{name}_low"))
    failed = F.expr(f"n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(inside, F.lit(False))).drop(*on)


def _sql() -> str:
    """The same in DuckDB, from the whole table."""
    bins = lambda v: f"(({v}) | ((1::BIGINT << CAST(greatest(CASE WHEN ({v}) > 0 THEN floor(log2(({v})::DOUBLE)) ELSE 0 END - 5, 0) AS INTEGER)) - 1))"
    frac = lambda n: f"CASE WHEN {RATES[n][1]} > 0 THEN ({RATES[n][2]} * {RATES[n][0]}) // {RATES[n][1]} ELSE 0 END"
    rates = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS rate, {bins(frac(n))} AS bin FROM counts WHERE n_words > 0" for n in RATES)
    ends, inside = [], []
    for n, (_, _, _, two, slack) in RATES.items():
        ends.append(f"max(CASE WHEN rate = '{n}' THEN q3 + {REACH} * (q3 - q1) + {slack} END) AS {n}_high")
        inside.append(f"{frac(n)} <= {n}_high")
        if two:
            ends.append(f"max(CASE WHEN rate = '{n}' THEN q1 - {REACH} * (q3 - q1) - {slack} END) AS {n}_low")
            inside.append(f"{frac(n)} >= {n}_low")
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS n FROM pos),
cov AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS c FROM win WHERE n > 1),
rep AS (SELECT doc_id, sum(c) AS n_repeat_words FROM cov GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, d.lang, d.source, len(ws) AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
rates AS ({rates}),
own AS (SELECT lang, source, rate, bin, count(*) AS n FROM rates GROUP BY ALL),
sketch AS (SELECT 2 AS level, * FROM own UNION ALL SELECT 1, lang, NULL, rate, bin, sum(n) FROM own GROUP BY lang, rate, bin UNION ALL SELECT 0, NULL, NULL, rate, bin, sum(n) FROM own GROUP BY rate, bin),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM sketch),
mid AS (SELECT level, lang, source, rate, min(CASE WHEN 4 * upto >= total THEN bin END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN bin END) AS q3, max(total) AS total FROM ranked GROUP BY level, lang, source, rate),
fence AS (SELECT level, lang, source, max(total) AS docs, {', '.join(ends)} FROM mid GROUP BY level, lang, source),
pick AS (SELECT lang, source, CASE WHEN docs >= {LEAST} THEN 2 WHEN sum(docs) OVER (PARTITION BY lang) >= {LEAST} THEN 1 ELSE 0 END AS level FROM fence WHERE level = 2),
judged AS (SELECT c.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce({' AND '.join(inside)}, false) AS fine
  FROM counts c LEFT JOIN pick p ON c.lang IS NOT DISTINCT FROM p.lang AND c.source IS NOT DISTINCT FROM p.source
  LEFT JOIN fence f ON f.level = p.level AND f.lang IS NOT DISTINCT FROM CASE WHEN p.level > 0 THEN p.lang END AND f.source IS NOT DISTINCT FROM CASE WHEN p.level > 1 THEN p.source END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM judged
"""


SQL = _sql()
