"""Quality rules as a bitmask ledger, in DataFrame functions alone.

``ledger`` measures each text once and stores the measurements and one bit for each rule that fails. A policy is a versioned
set of rules; applying it, or asking what a rule alone rejects, is bitwise arithmetic on the ledger and reads no text again.

Nulls and odd input: a null or blank text has no words, all measurements are 0 and only ``few_words`` fails; repeated rows are
judged alike; an empty table gives an empty ledger; input columns other than the text are kept by ``ledger`` unless they bear
the name of a ledger column, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import SPACE, WORD, columns

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document fails if the SQL condition on the measurements holds. The bit is never given to another rule."""

    bit: int
    name: str
    fails_if: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "20 * n_symbols > word_chars"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "long_words", "word_chars > 12 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
)

#: Version -> names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_phrases"),
    "v1": ("few_words", "repeated_phrases", "symbols", "repeated_lines", "long_words", "short_words"),
}
CURRENT = "v1"


def mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def _repeated(words: str, n: str) -> tuple[list[tuple[str, Column]], Column]:
    """Steps and result of: words inside three-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words; equal ones stand side by side once sorted. The windows' places,
    sorted again, cover min(3, distance to the next) words each.
    """
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h")
    sort = F.when(F.col(n) > 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.col(n) - 3), lambda i: F.struct(window(i), i.alias("at")))))
    same = lambda x, i: (F.get("_sorted", i - 1)["h"] == x["h"]) | (F.get("_sorted", i + 1)["h"] == x["h"])
    places = F.sort_array(F.transform(F.filter("_sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["at"]))
    cover = F.transform("_places", lambda at, i: F.coalesce(F.least(F.lit(3), F.get("_places", i + 1) - at), F.lit(3)))
    return [("_sorted", sort), ("_places", places)], F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with the measurements as longs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The other columns wait in one struct, so that none clashes with the steps' names.
    kept = [c for c, name in zip(columns(docs), docs.columns, strict=True) if name != text_col and name.lower() not in (*MEASURES, "fail_bits")]
    split = docs.select(
        F.struct(*kept, F.lit(0).alias("_")).alias("_row"),
        F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).alias("_symbols"),
    ).withColumn("_n", F.size("_words"))
    steps, repeated = _repeated("_words", "_n")
    for name, step in steps:
        split = split.withColumn(name, step)
    found = {
        "n_words": F.col("_n"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.col("_symbols"),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated,
    }
    # A one-row generator: a filter on the measurements is not pushed below it, where each would be worked out again and again.
    once = F.explode(F.array(F.struct(*[v.cast("long").alias(k) for k, v in found.items()]))).alias("_found")
    return split.select(F.col("_row").dropFields("_").alias("_row") if kept else "_row", once).select(*(["_row.*"] if kept else []), "_found.*")


def fail_bits() -> Column:
    return sum((F.expr(f"IF({r.fails_if}, {1 << r.bit}L, 0L)") for r in RULES), F.lit(0).cast("long"))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with the measurements and fail_bits."""
    return measured(docs, text_col).withColumn("fail_bits", fail_bits())


def verdict(policy: str = CURRENT) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, n_fail, n_only): rows that fail each rule of the policy, and rows that it alone rejects, so that would come back without it.

    Rows are first counted for each set of failed rules (2^rules counts at most), so a very common set is no hot group.
    """
    bits = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy]])
    each = bits.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(part(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_fail"), part(F.col("bits") == F.col("bit")).alias("n_only"))


def judged(docs: DataFrame) -> DataFrame:
    """The digest of op8: measurements, base_failed, kept and the ledger's bits."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return ledger(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), verdict().alias("kept"), "fail_bits")


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM k WHERE c > 1) GROUP BY r),
m AS (
  SELECT w.r, doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.r = rep.r),
b AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 20 * n_symbols > word_chars THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END AS fail_bits
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits
FROM b
"""
