"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isovox.store import fresh

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Words of two or more capitals and no small letter; no search goes back over what it has read, so that the work
#: follows the word's length.
CAPITALS = r"^[^a-zA-Z]*+[A-Z][^a-zA-Z]*+[A-Z][^a-z]*+$"
LATIN = r"[A-Za-z]"
#: Common words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "au dans de des du elle en est et la le les ou par pas pour que qui sur un une "
    "als auf das dem den der die ein eine für im ist mit nicht sie und von zu "
    "como con del el es las los más no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails if ``share * over > limit * under`` (``above``) or ``< `` (not ``above``), all in whole numbers."""

    name: str
    over: str
    under: str
    share: int
    limit: int
    above: bool = True

    def fails(self, of: dict[str, Column]) -> Column:
        one, other = of[self.over] * self.share, of[self.under] * self.limit
        return one > other if self.above else one < other


#: Failing one of these is failing the base.
BASE = (
    Rule("too_short", "n_words", "one", 1, 50, above=False),
    Rule("repeated_words", "n_repeat_words", "n_words", 100, 50),
)
#: The method's own thresholds: length, symbol, line, repetition, capital and stop-word ratios, in hundredths. Stop words
#: are asked for among words with a Latin letter alone: texts in other scripts need none.
RULES = (
    Rule("long_words", "word_chars", "n_words", 1, 20),
    Rule("short_words", "word_chars", "n_words", 1, 2, above=False),
    Rule("symbols", "n_symbols", "n_words", 100, 10),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 100, 50),
    Rule("repetitive", "n_repeat_words", "n_words", 100, 30),
    Rule("capitals", "n_capital_words", "n_words", 100, 50),
    Rule("no_stop_words", "n_stop_words", "n_latin_words", 100, 2, above=False),
)


def with_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with one column for each measure and verdict, and their names by what they hold.

    The new columns get a prefix no column of ``docs`` has, so extra or clashing columns do no harm. A null
    or empty text has no words: its measures are 0 and it fails the base. Repeated rows are judged each alone;
    a ratio exactly at its limit passes. Texts of any length are read whole. An empty table gives an empty table.
    """
    p = fresh(docs, "quality")
    c = lambda name: F.col(p + name)
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select("*", F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias(p + "words"), F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD)).alias(p + "lines"))
    df = df.select(
        "*",
        F.size(c("words")).cast("long").alias(p + "n_words"),
        F.when(F.size(c("words")) >= 3, F.transform(F.sequence(F.lit(0), F.size(c("words")) - 3), lambda i: F.xxhash64(c("words")[i], c("words")[i + 1], c("words")[i + 2]))).otherwise(F.array().cast("array<long>")).alias(p + "runs"),
    )
    # Most texts repeat no run of three words: only the others are sorted.
    df = df.select("*", F.when(F.size(F.array_distinct(c("runs"))) < F.size(c("runs")), F.sort_array(F.transform(c("runs"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias(p + "sorted"))
    twice = lambda x, i: ((i > 0) & (F.get(c("sorted"), i - 1)["h"] == x["h"])) | F.coalesce(F.get(c("sorted"), i + 1)["h"] == x["h"], F.lit(False))
    df = df.select("*", F.sort_array(F.transform(F.filter(c("sorted"), twice), lambda x: x["i"])).alias(p + "starts"))
    gaps = F.zip_with(F.slice(c("starts"), F.lit(1), F.size(c("starts")) - 1), F.slice(c("starts"), F.lit(2), F.size(c("starts")) - 1), lambda a, b: F.least(b - a, F.lit(3)).cast("long"))
    df = df.select(
        *[x for x in df.columns if x not in {p + "runs", p + "sorted", p + "starts"}],
        F.coalesce(F.when(F.size(c("starts")) > 0, F.aggregate(gaps, F.lit(3).cast("long"), lambda acc, x: acc + x)), F.lit(0)).cast("long").alias(p + "n_repeat_words"),
        F.length(F.regexp_replace(body, SPACES, "")).cast("long").alias(p + "word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long").alias(p + "n_symbols"),
        F.size(c("lines")).cast("long").alias(p + "n_lines"),
        (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long").alias(p + "n_dup_lines"),
        F.size(F.filter(c("words"), lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias(p + "n_stop_words"),
        F.size(F.filter(c("words"), lambda w: w.rlike(CAPITALS))).cast("long").alias(p + "n_capital_words"),
        F.size(F.filter(c("words"), lambda w: w.rlike(LATIN))).cast("long").alias(p + "n_latin_words"),
    )
    measures = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_capital_words", "n_latin_words"]
    of = {m: c(m) for m in measures} | {"one": F.lit(1)}
    failed = F.lit(False)
    for rule in base:
        failed = failed | rule.fails(of)
    kept = ~failed
    for rule in rules:
        kept = kept & ~rule.fails(of)
    df = df.select(*docs.columns, *[p + m for m in measures], failed.alias(p + "base_failed"), kept.alias(p + "kept"))
    return df, {m: p + m for m in [*measures, "base_failed", "kept"]}


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    df, name = with_quality(docs, rules, base, text)
    # A filter on a plain column would be pushed below the projections, with all their expressions written out in it.
    df = df.withColumn(name["kept"], F.col(name["kept"]) & (F.spark_partition_id() >= 0))
    return df.where(F.col(name["kept"])).select(*docs.columns)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    df, name = with_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return df.select("doc_id", *[F.col(name[m]).alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP7_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS rid
  FROM documents),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, unnest(words[1:len(words) - 2]) AS a, unnest(words[2:len(words) - 1]) AS b, unnest(words[3:len(words)]) AS c FROM w WHERE len(words) >= 3),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM g),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM t WHERE k >= 2) GROUP BY rid),
m AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(body) - length(regexp_replace(body, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({_LIST}))) AS n_stop_words,
         len(list_filter(words, lambda x: regexp_matches(x, '^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$'))) AS n_capital_words,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]'))) AS n_latin_words
  FROM w LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 100 * n_symbols > 10 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_repeat_words > 30 * n_words
            OR 100 * n_capital_words > 50 * n_words OR 100 * n_stop_words < 2 * n_latin_words) AS kept
FROM m"""
