"""Audit of how the words of each source diverge from those of the other sources of its language, by count cells.

Terms are runs of letters A to Z and of characters beyond ASCII, A to Z lower-cased. A language keeps the V terms in at least
``least_docs`` of its documents. A group is a language and source. A term's share of a group of N kept occurrences is
p = 1 + floor(10^9 (count + 1) / (N + V)), its divergence from a share q is floor((p - q)^2 / q). Both depend on two counts
alone, so terms are grouped by cells of (group count, language count), or of two sources' counts, and each cell is evaluated
once. For the terms that set a source apart, cells are ranked by their value, equal values merged, and only the values that
begin within the first ``top`` terms are expanded into terms, in UTF-8 order. For two sources, terms that only one has follow
from that one's counts of counts, and terms that neither has from V, so only terms that both have are met in pairs; terms
with one profile of counts over sources are met once.

Counting is done in Python by dictionaries of bounded size; the rest is SQL. Nulls count as '', a language or source of '' is
one like any other; a group without terms has shares all the same; repeated rows count; texts are read whole; an empty table
gives no rows; extra columns are ignored. Divergences are sums of longs in decimals; one beyond a long is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import small_batches, written

#: Distinct terms that a task holds before it hands them on.
HELD = 200_000
#: Bytes of a text to those of its terms: A to Z to a to z, other ASCII to blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counted(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row of term null for each group."""
    small_batches(docs.sparkSession)

    def rows_of(seen: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        langs, sources, terms, ns, ds = [], [], [], [], []
        for (lang, source), (n, d) in seen.items():
            langs += [lang] * (len(n) + 1)
            sources += [source] * (len(n) + 1)
            terms += [None, *n]
            ns += [0, *n.values()]
            ds += [0, *(d[t] for t in n)]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()), pa.array(ns, pa.int64()), pa.array(ds, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, d = seen.setdefault((lang, source), (Counter(), Counter()))
                found = text.translate(FOLD).split()
                held -= len(n)
                n.update(found)
                d.update(set(found))
                held += len(n)
                if held >= HELD:
                    yield rows_of(seen)
                    seen, held = {}, 0
        if seen:
            yield rows_of(seen)

    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    rows = docs.select(told[0].alias("lang"), told[1].alias("source"), told[2].cast("binary").alias("text"))
    rows = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


def _share(count: str, total: str, kept: str) -> str:
    """In longs, or in decimals where 10^9 times the count is beyond one."""
    of = f"({total} + {kept})"
    return f"(1 + CASE WHEN {count} < 9000000000 THEN (1000000000 * CAST({count} + 1 AS BIGINT)) div {of} ELSE (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(20, 0))) div CAST({of} AS DECIMAL(20, 0)) END)"


def _apart(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


#: Values of terms over their language's share, of which each group keeps those that begin within its first terms.
_VALUES = """WITH v AS (SELECT lang, source, f, sum(m) AS m FROM {cells} WHERE f IS NOT NULL GROUP BY lang, source, f),
  t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY f DESC) AS place FROM v) AS r WHERE place <= :top)
  SELECT lang, source, f FROM (SELECT *, sum(m) OVER (PARTITION BY lang, source ORDER BY f DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - m AS before FROM t) AS r WHERE before < :top"""

_TERMS = """SELECT lang, source, 'term' AS part, term AS item, f AS value, rank FROM (
    SELECT t.lang, t.source, t.term, c.f, row_number() OVER (PARTITION BY t.lang, t.source ORDER BY c.f DESC, t.term) AS rank
    FROM {terms} AS t JOIN (SELECT c.lang, c.source, c.a, c.b, c.f FROM {cells} AS c JOIN {values} AS v ON c.lang = v.lang AND c.source = v.source AND c.f = v.f) AS c ON t.lang = c.lang AND t.source = c.source AND t.n = c.a AND t.of_lang = c.b) AS r
  WHERE rank <= :top"""

#: Terms that two sources have, by their two counts; each profile of counts over sources is met once.
_MET = """WITH p AS (SELECT profile, lang, count(*) AS m FROM (SELECT lang, term, sort_array(collect_list(struct(source, n))) AS profile FROM {terms} GROUP BY lang, term) AS t GROUP BY lang, profile),
  x AS (SELECT lang, m, x, profile FROM p LATERAL VIEW explode(profile) AS x WHERE size(profile) > 1)
  SELECT lang, s, t, a, b, sum(m) AS m FROM (SELECT lang, m, x.source AS s, y.source AS t, x.n AS a, y.n AS b FROM x LATERAL VIEW explode(filter(profile, y -> y.source > x.source)) AS y) AS e GROUP BY lang, s, t, a, b"""


def _pairs() -> str:
    p, q = (lambda c, g: _share(c, f"{g}.total", f"{g}.kept")), _apart
    neither = q(p("0", "g"), p("0", "h"))
    both = lambda g, h, a, b: f"{q(p(a, g), p(b, h))} - {q(p(a, g), p('0', h))} - {q(p('0', g), p(b, h))} + {q(p('0', g), p('0', h))}"
    return f"""WITH e AS (
      SELECT g.lang, g.source AS s, h.source AS t, g.kept * {neither} AS v FROM {{groups}} AS g JOIN {{groups}} AS h ON g.lang = h.lang AND g.source <> h.source WHERE g.kept > 0
      UNION ALL SELECT g.lang, g.source, h.source, c.m * ({q(p("c.n", "g"), p("0", "h"))} - {neither}) FROM {{counts}} AS c JOIN {{groups}} AS g ON c.lang = g.lang AND c.source = g.source JOIN {{groups}} AS h ON g.lang = h.lang AND g.source <> h.source
      UNION ALL SELECT g.lang, g.source, h.source, c.m * ({q(p("0", "g"), p("c.n", "h"))} - {neither}) FROM {{counts}} AS c JOIN {{groups}} AS h ON c.lang = h.lang AND c.source = h.source JOIN {{groups}} AS g ON g.lang = h.lang AND g.source <> h.source
      UNION ALL SELECT m.lang, m.s, m.t, m.m * ({both("g", "h", "m.a", "m.b")}) FROM {{met}} AS m JOIN {{groups}} AS g ON m.lang = g.lang AND m.s = g.source JOIN {{groups}} AS h ON m.lang = h.lang AND m.t = h.source
      UNION ALL SELECT m.lang, m.t, m.s, m.m * ({both("h", "g", "m.b", "m.a")}) FROM {{met}} AS m JOIN {{groups}} AS g ON m.lang = g.lang AND m.s = g.source JOIN {{groups}} AS h ON m.lang = h.lang AND m.t = h.source
      UNION ALL SELECT g.lang, g.source, h.source, 0 FROM {{groups}} AS g JOIN {{groups}} AS h ON g.lang = h.lang AND g.source <> h.source),
    s AS (SELECT lang, s, t, CAST(sum(CAST(v AS DECIMAL(38, 0))) AS BIGINT) AS value FROM e GROUP BY lang, s, t)
    SELECT lang, s AS source, 'pair' AS part, t AS item, value, row_number() OVER (PARTITION BY lang, s ORDER BY value DESC, t) AS rank FROM s"""


def audited(docs: DataFrame, top: int = 200, least_docs: int = 3, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by divergence, part ``term`` the first ``top`` terms whose share is over the language's."""
    spark = docs.sparkSession
    sql = lambda text, **frames: spark.sql(text.replace(":top", str(int(top))), **frames)
    counts, gone = written(counted(docs, lang_col, source_col, text_col))
    kept, kept_path = written(counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("d")).where(F.col("d") >= least_docs).drop("d"))
    sources = counts.select("lang", "source").where("term IS NULL")
    terms, _ = written(counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("of_lang").alias("lang_total"))
    groups = sources.join(terms.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    # A row for each group.
    groups, _ = written(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")]), gone, kept_path)
    own, of_lang = _share("c.a", "g.total", "g.kept"), _share("c.b", "g.lang_total", "g.kept")
    cells = sql(f"SELECT c.*, CASE WHEN {own} > {of_lang} THEN {_apart(own, of_lang)} END AS f FROM (SELECT lang, source, n AS a, of_lang AS b, count(*) AS m FROM {{terms}} GROUP BY lang, source, n, of_lang) AS c JOIN {{groups}} AS g ON c.lang = g.lang AND c.source = g.source", terms=terms, groups=groups)
    cells, _ = written(cells)
    of_terms = sql(_TERMS, terms=terms, cells=cells, values=sql(_VALUES, cells=cells))
    of_counts = cells.groupBy("lang", "source", F.col("a").alias("n")).agg(F.sum("m").alias("m"))
    of_pairs = sql(_pairs(), groups=groups, counts=of_counts, met=sql(_MET, terms=terms))
    return of_pairs.unionByName(of_terms)


#: By the definition: every kept term of every group, no cells.
ORACLE = """WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
      w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
      k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
      l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
      g AS (SELECT DISTINCT lang, source FROM d),
      c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY 1, 2, 3),
      t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
      p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (coalesce(t.n, 0) + l.v) AS HUGEINT) AS p, CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // (l.n + l.v) AS HUGEINT) AS q
        FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
      s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
      f AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
      e AS (SELECT lang, source, term, CAST((p - q) * (p - q) // q AS BIGINT) AS value, row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS rank FROM p WHERE n > 0 AND p > q)
      SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM f
      UNION ALL SELECT lang, source, 'term', term, value, CAST(rank AS INTEGER) FROM e WHERE rank <= 200"""
