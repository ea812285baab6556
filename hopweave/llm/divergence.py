"""How each source's words differ from those of its language's other sources, by DuckDB inside Spark's tasks.

Texts are cut into terms and counted by DuckDB in the tasks that read them; Spark adds the counts up by (lang, term, source).
Shards hashed by lang and term then hold every source's count of a term. In each, DuckDB keeps the terms of at least
`least_docs` documents of their lang; with the totals of all shards known, it turns counts into smoothed shares and emits partial
pair sums and its best terms of each source. Spark adds the pair sums and ranks.

A term that neither source of a pair has adds the same constant for all such terms, and one that only one has adds what its count
and the other's constant give. So shards join only sources that share a term, with what those constants would have added taken
off, and what each source's counts give against another's constant is added from its histogram of shares. All is in integers.

Cases: null lang, source and text are ''; a lang without kept terms has pair values 0 and no terms; a source alone in its lang
has no pairs; each row is a document, also one that repeats; null doc_ids make no difference; ties are ranked by the item's
UTF-8 bytes; an empty table gives no rows; texts of any length are cut whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, load, sized_broadcast, small_batches, written

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: (lang, term, source) rows of a shard, and of the counts that a task holds before it sends them on.
SHARD_ROWS, HELD_ROWS = 50_000, 1_000_000
#: Groups of (lang, source), of about 100 bytes each, that are broadcast; more are joined by shuffle.
GROUPS = 100_000

COUNTED = "lang string, source string, term string, n long, docs long"
KEPT = "shard int, lang string, source string, term string, n long"
PARTIAL = "part string, lang string, source string, item string, value long"

_COUNT = f"""
INSERT INTO held SELECT lang, source, term, sum(n)::BIGINT, count(*) FROM (
  SELECT r, any_value(lang) AS lang, any_value(source) AS source, term, count(*) AS n FROM (
    SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS r, lang, source, text FROM batch))
  GROUP BY r, term)
GROUP BY lang, source, term
"""
_KEEP = """
WITH k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM cells GROUP BY lang, term HAVING sum(docs) >= {least})
SELECT shard, lang, source, term, n FROM cells SEMI JOIN k USING (lang, term)
UNION ALL SELECT (SELECT any_value(shard) FROM cells), lang, NULL, term, n FROM k
"""
_F = "(({p} - {q}) * ({p} - {q}) // {q})"
_PAIRS = f"""
SELECT 'pair' AS part, g.lang, g.source, h.source AS item,
  sum({_F.format(p="g.p", q="h.p")} - {_F.format(p="g.p", q="h.p0")} - {_F.format(p="g.p0", q="h.p")} + {_F.format(p="g.p0", q="h.p0")})::BIGINT AS value
FROM cells g JOIN cells h ON g.lang = h.lang AND g.term = h.term AND g.source <> h.source
GROUP BY g.lang, g.source, h.source
"""
_TERMS = f"""
SELECT 'term' AS part, g.lang, g.source, g.term AS item, {_F.format(p="g.p", q="l.p")} AS value
FROM cells g JOIN cells l ON g.lang = l.lang AND g.term = l.term AND l.source IS NULL
WHERE g.source IS NOT NULL AND g.p > l.p
QUALIFY row_number() OVER (PARTITION BY g.lang, g.source ORDER BY value DESC, item) <= {{top}}
"""


def database():
    """A DuckDB of one thread in memory, which leaves no files behind."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of a task's documents, sent on whenever HELD_ROWS are held and at the end."""
    con = database()
    con.execute("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")

    def sums() -> pa.Table:
        return con.sql("SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL").to_arrow_table()

    for batch in batches:
        for start, end in runs(batch):
            con.register("batch", pa.table(batch.slice(start, end - start)))
            con.execute(_COUNT)
            con.unregister("batch")
            if con.execute("SELECT count(*) FROM held").fetchall()[0][0] >= HELD_ROWS:
                out = sums()
                con.execute("DELETE FROM held")
                if len(out) < HELD_ROWS // 2:  # mostly repeats: they are held on
                    con.register("batch", out)
                    con.execute("INSERT INTO held SELECT * FROM batch")
                    con.unregister("batch")
                else:
                    yield from out.to_batches(50_000)
    yield from sums().to_batches(50_000)
    con.close()


def runs(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows with up to `most` bytes of text; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total + n > most and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def of_shard(*queries: str):
    """For applyInArrow: what the queries return over a shard's rows, which they call cells."""

    def shard(rows: pa.Table) -> pa.Table:
        con = database()
        con.register("cells", rows)
        out = pa.concat_tables([con.sql(q).to_arrow_table() for q in queries])
        con.close()
        return out

    return shard


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Of docs (lang, source, text): the kept terms' counts as shard, lang, source, term, n, with a row of null source for the
    lang itself, and one row a group: lang, source, total, kept (terms of the lang), present (those the group has), p0 (the
    share of a term that it lacks; null without kept terms)."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = small_batches(texts).mapInArrow(counted, COUNTED).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts, "divergence-counts")
    shards = -(-max(counts.count(), 1) // SHARD_ROWS)
    counts = counts.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    kept = written(counts.groupBy("shard").applyInArrow(of_shard(_KEEP.format(least=least)), KEPT), "divergence-kept")
    of_group = kept.where("source is not null").groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    of_lang = kept.where("source is null").groupBy("lang").agg(F.count("*").alias("kept"))
    groups = texts.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "present")])
    return kept, written(groups.withColumn("p0", F.expr(share("0"))), "divergence-groups")


def share(n: str) -> str:
    """1 + floor(SCALE * (n + 1) / (total + kept)) in exact arithmetic; null without kept terms."""
    return f"CASE WHEN kept > 0 THEN 1L + (CAST({SCALE} AS DECIMAL(10)) * (CAST({n} AS DECIMAL(19)) + 1)) div (total + kept) END"


def surprise(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a lang is from each other one (`pair`), and the `top` terms
    that it has more of than its lang has (`term`)."""
    kept, groups = term_counts(docs, least)
    small = groups.count()
    langs = kept.where("source is null").groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kept"))
    langs = langs.select("lang", F.lit(None).cast("string").alias("source"), "total", "kept", F.lit(None).cast("bigint").alias("p0"))
    of = groups.select("lang", "source", "total", "kept", "p0").unionByName(langs)
    of = sized_broadcast(of.withColumnsRenamed({"lang": "_l", "source": "_s"}), 2 * small, GROUPS)
    shares = kept.join(of, (F.col("lang") == F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).select("shard", "lang", "source", "term", F.expr(share("n")).alias("p"), "p0")
    found = written(shares.groupBy("shard").applyInArrow(of_shard(_PAIRS, _TERMS.format(top=top)), PARTIAL), "divergence-parts")

    other = sized_broadcast(groups.select(F.col("lang").alias("_l"), F.col("source").alias("other"), F.col("p0").alias("q0"), F.col("present").alias("other_present")), small, GROUPS)
    seen = shares.where("source is not null").groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    seen = seen.join(other, (F.col("lang") == F.col("_l")) & (F.col("source") != F.col("other")))
    one_way = seen.select("lang", "source", F.col("other").alias("item"), F.expr(f"m * ({surprise('p', 'q0')})").alias("value"))
    other_way = seen.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), F.expr(f"m * ({surprise('q0', 'p')})").alias("value"))
    lacking = groups.join(other, (F.col("lang") == F.col("_l")) & (F.col("source") != F.col("other")))
    lacking = lacking.select("lang", "source", F.col("other").alias("item"), F.expr(f"CASE WHEN kept > 0 THEN (kept - present - other_present) * ({surprise('p0', 'q0')}) ELSE 0L END").alias("value"))
    shared = found.where("part = 'pair'").select("lang", "source", "item", "value")
    pairs = shared.unionByName(one_way).unionByName(other_way).unionByName(lacking).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents").select("lang", "source", "text"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
t AS (SELECT r, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(*) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE} * (coalesce(c.n, 0) + 1) // (g.total + v.v) AS p, 1 + {SCALE} * (k.n + 1) // (v.total + v.v) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
