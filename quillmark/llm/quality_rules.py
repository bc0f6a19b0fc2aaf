"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` gives the counts of a text, ``RULES`` is the table of thresholds over ratios of them, and
``verdict`` turns the table into one boolean Column. The base rules (at least ten words; at most a fifth of
the words inside a repeated five-word window) are part of the same projection.

Repeated five-word windows are found inside the row: every window becomes the 64-bit hash of its five words,
and only where a hash repeats are the (hash, position) pairs sorted and the covered words counted, so a text
of n words costs n log n at most.

Edge cases: a null, empty or blank text has no words, fails the base and is not kept; repeated rows are
judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, lower_ascii, text_or_empty, words

SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages that the rules know.
STOP_WORDS = (
    "the of and to in a is that it for on was with as be by this are at from or an "
    "de la le les des et un une en du que qui dans est pour sur "
    "der die das und ist von zu mit den dem nicht ein eine auf für als auch "
    "el los las y una por con para se del lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes while low <= measure <= high; the rule applies from ``from_words`` words on."""

    name: str
    measure: str
    low: float = float("-inf")
    high: float = float("inf")
    from_words: int = 0


RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 16.0),
    Rule("symbols", "symbols_per_word", high=0.30),
    Rule("exclamations", "exclamations_per_word", high=0.30),
    Rule("letters", "words_with_letter", low=0.70),
    Rule("duplicate_lines", "dup_line_ratio", high=0.50, from_words=50),
    Rule("ellipses", "ellipsis_line_ratio", high=0.50, from_words=50),
    Rule("stop_words", "stop_words", low=1.0, from_words=300),
)


def repeat_words(ws: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that the text holds twice or more, first ones included."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(width)]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def counted(k: Column) -> Column:
        pairs = F.array_sort(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(let(let(pairs, positions), covered))

    return F.when(F.size(ws) <= width, F.lit(0).cast("long")).otherwise(let(let(F.transform(ws, lambda w: F.xxhash64(w)), windows), counted))


def measured(ws: Column, text: Column) -> Column:
    """All counts of a text as one struct."""
    chars = text_or_empty(text)
    lines = F.filter(F.split(chars, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])

    def of_lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(ls, lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        )

    return F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.translate(chars, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(chars) - F.length(F.translate(chars, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(chars) - F.length(F.translate(chars, "!", ""))).cast("long").alias("n_exclamations"),
        F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(F.filter(ws, lambda w: F.array_contains(stop, lower_ascii(w)))).cast("long").alias("n_stop_words"),
        repeat_words(ws).alias("n_repeat_words"),
        let(lines, of_lines).alias("lines"),
    )


def ratios(m: Column) -> dict[str, Column]:
    """The measures that rules name, from the counts."""
    per_word = lambda c: c / F.greatest(m["n_words"], F.lit(1))
    per_line = lambda c: c / F.greatest(m["lines"]["n_lines"], F.lit(1))
    return {
        "mean_word_chars": per_word(m["word_chars"]),
        "symbols_per_word": per_word(m["n_symbols"]),
        "exclamations_per_word": per_word(m["n_exclamations"]),
        "words_with_letter": per_word(m["n_letter_words"]),
        "stop_words": m["n_stop_words"].cast("double"),
        "dup_line_ratio": per_line(m["lines"]["n_dup_lines"]),
        "ellipsis_line_ratio": per_line(m["lines"]["n_ellipsis_lines"]),
    }


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean Column."""
    given, passed = ratios(m), F.lit(True)
    for r in rules:
        x = given[r.measure]
        passed = passed & ((m["n_words"] < r.from_words) | x.between(r.low, r.high))
    return passed


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: id, the base counts, base_failed and kept."""
    text = F.col("t")
    m = let(words(text), lambda ws: measured(ws, text))
    failed = lambda m: (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    out = docs.select(F.col(id_col), F.col(text_col).alias("t")).select(id_col, let(m, lambda m: F.struct(m.alias("m"), failed(m).alias("failed"), verdict(m, rules).alias("passed"))).alias("r"))
    c = F.col("r.m")
    return out.select(
        id_col, c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
        c["lines"]["n_dup_lines"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
        F.col("r.failed").alias("base_failed"), (~F.col("r.failed") & F.col("r.passed")).alias("kept"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir, "doc_id", "text"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (WHERE ends_with(line, '...') OR ends_with(line, '…')) AS n_ell
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
w AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) > 4)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM w) WHERE n > 1),
r AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM c) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(t) - length(replace(t, '!', '')) AS n_excl,
         len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter,
         len(list_filter(ws, lambda x: list_contains(string_split('@STOP@', ' '), translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS n_stop,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_ell, 0) AS n_ell,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1) AS nw, greatest(n_lines, 1) AS nl FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / nw BETWEEN 2.0 AND 16.0 AND n_symbols / nw <= 0.30 AND n_excl / nw <= 0.30
       AND n_letter / nw >= 0.70 AND (n_words < 50 OR n_dup_lines / nl <= 0.50) AND (n_words < 50 OR n_ell / nl <= 0.50)
       AND (n_words < 300 OR n_stop >= 1) AS kept
FROM b
""".replace("@STOP@", " ".join(STOP_WORDS))
