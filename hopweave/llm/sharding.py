"""Sharding by a hierarchical weighted hash tree, in DataFrame operations alone.

A tree has regions, racks in regions and shards in racks; a rack's weight is the sum of its shards' weights, a region's that of
its racks. A document descends: at each level every child draws a key -ln(u) / weight, u from a hash of (seed, level, child,
doc_id), and the smallest key wins, so a child gets its share of the weight. A draw depends on its child's own weight alone:
if a shard's weight changes, rows move between regions only into or out of its region, within that region only into or out of
its rack, within that rack only into or out of the shard; all that lies in other subtrees stays where it was. A shard that is
added (`with_shard`) opens a region of its own, so no old subtree's weight changes and it takes rows only into itself.

Slots number each shard's rows from 0 in the order of a hash of their content, in two steps (over buckets of the hash, then
within each), so a shard of any size is dealt over tasks. Rows equal in every column are counted first, are numbered as one run
of slots, and are spread again for their output, so a row that is repeated without end gathers nowhere.

Cases: a null doc_id is an id of its own and null text is empty; equal ids go to one shard whatever their texts; rows that
repeat get a slot each; very long texts are read for their size and checksum only; a child of weight 0 gets nothing, and a tree
without any weight is an error; an empty table gives no rows; columns of docs with the names of this operator's own give way.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, load, written

SEED = 13
SHARDS = 40
RACK_SHARDS, REGION_RACKS = 2, 4
#: Rows of one task in the numbering of slots, and of one repeated row in its output.
BUCKET_ROWS, RUN_ROWS = 50_000, 10_000


@dataclass(frozen=True)
class Shard:
    shard: int
    rack: int
    region: int
    weight: float = 1.0


Tree = tuple[Shard, ...]


def laid_out(shards: int = SHARDS, rack_shards: int = RACK_SHARDS, region_racks: int = REGION_RACKS) -> Tree:
    """Shards 0, 1, ... of weight 1, so many in a rack and so many racks in a region; rack and region ids go through the tree."""
    return tuple(Shard(i, i // rack_shards, i // (rack_shards * region_racks)) for i in range(shards))


def with_shard(tree: Tree, weight: float = 1.0) -> Tree:
    """tree and one more shard, in a rack and a region of its own."""
    after = lambda of: max((getattr(s, of) for s in tree), default=-1) + 1
    return (*tree, Shard(after("shard"), after("rack"), after("region"), weight))


def reweighted(tree: Tree, shard: int, weight: float) -> Tree:
    return tuple(replace(s, weight=weight) if s.shard == shard else s for s in tree)


def unit(*parts: Column | str) -> Column:
    """A number in (0, 1) from a hash of the parts; null parts are left out."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16**12 + 1))


def weighed(weights: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in sorted(weights.items()) if w > 0])


def draw(children: Column, level: str, key: Column, seed: int) -> Column:
    """The child of the smallest -ln(u) / weight; of equal ones the smallest id."""
    keys = F.transform(children, lambda c: F.struct((-F.log(unit(str(seed), level, c["id"], key)) / c["weight"]).alias("key"), c["id"].alias("id")))
    return F.array_min(keys)["id"]


def summed(shards: Tree, of: str) -> dict[int, float]:
    out: dict[int, float] = {}
    for s in shards:
        out[getattr(s, of)] = out.get(getattr(s, of), 0.0) + s.weight
    return out


def shard_of(key: Column, tree: Tree, seed: int = SEED) -> Column:
    """The shard that a key (a doc_id) descends to."""
    live = tuple(s for s in tree if s.weight > 0)
    if not live:
        raise ValueError("a tree needs a shard of positive weight")
    by = lambda of, child: F.create_map(*[x for i in sorted({getattr(s, of) for s in live}) for x in (F.lit(i), weighed(summed(tuple(s for s in live if getattr(s, of) == i), child)))])
    region = draw(weighed(summed(live, "region")), "region", key, seed)
    rack = draw(by("region", "rack")[region], "rack", key, seed)
    return draw(by("rack", "shard")[rack], "shard", key, seed)


def place(docs: DataFrame, tree: Tree | None = None, seed: int = SEED) -> DataFrame:
    """docs with size (UTF-8 bytes of the text and 16), text_crc32 and shard; no shuffle."""
    rest = docs.drop("size", "text_crc32", "shard")
    text = F.coalesce("text", F.lit(""))
    return rest.select(
        *columns(rest.columns),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(F.col("doc_id"), tree or laid_out(), seed).alias("shard"),
    )


def numbered(rows: DataFrame, of: str = "shard", seed: int = SEED, bucket_rows: int = BUCKET_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """rows with slot, gapless from 0 within each value of `of`, in the order of a hash of all columns."""
    cols = rows.columns
    content = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]
    key = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("slot"), *content)), 1, 16)
    once = written(rows.groupBy(*cols).agg(F.count("*").alias("_n")).withColumn("_key", key), "shard-rows")
    most = once.groupBy(of).agg(F.count("*").alias("n"), F.max("_n").alias("run")).agg(F.max("n"), F.max("run")).first()
    buckets = -(-(most[0] or 1) // bucket_rows)
    unit_ = F.conv(F.substring("_key", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    once = once.withColumn("_bucket", F.floor(unit_ * buckets))
    upto = Window.partitionBy(of).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = once.groupBy(of, "_bucket").agg(F.sum("_n").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).drop("_sum")
    within = Window.partitionBy(of, "_bucket").orderBy("_key", *cols).rowsBetween(Window.unboundedPreceding, -1)
    runs = once.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(cells, [of, "_bucket"]).select(*cols, "_n", (F.col("_before") + F.col("_at")).alias("_first"))

    def spread(r: DataFrame, last: Column) -> DataFrame:
        return r.withColumn("slot", F.explode(F.sequence(F.col("_first"), last))).select(*cols, "slot")

    if (most[1] or 1) <= run_rows:
        return spread(runs, F.col("_first") + F.col("_n") - 1)
    runs = written(runs, "shard-runs")
    cut = runs.where(F.col("_n") > run_rows).withColumn("_end", F.col("_first") + F.col("_n") - 1)
    cut = cut.withColumn("_first", F.explode(F.sequence(F.col("_first"), F.col("_end"), F.lit(run_rows).cast("long")))).repartition(of, "_first")
    few = spread(runs.where(F.col("_n") <= run_rows), F.col("_first") + F.col("_n") - 1)
    return few.unionByName(spread(cut, F.least(F.col("_first") + run_rows - 1, F.col("_end"))))


def write_shards(docs: DataFrame, path: str, tree: Tree | None = None, seed: int = SEED, spread: int = 8) -> None:
    """docs as Parquet in a folder a shard, each written by up to `spread` tasks, between which equal rows are dealt by where they were read."""
    placed = place(docs, tree, seed)
    placed.repartition("shard", F.pmod(F.spark_partition_id(), F.lit(spread))).write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = laid_out(SHARDS)
    placed = place(load(spark, sf_dir, "documents").select("doc_id", "text"), tree)
    slim = placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", shard_of(F.col("doc_id"), with_shard(tree)).alias("grown_shard"))
    return numbered(slim)


#: CRC-32 of the four low bits, as fixed by its polynomial.
_NIBBLES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_LOW = f"xor({_NIBBLES}[(xor(c, b) & 15) + 1], c >> 4)"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor({_NIBBLES}[(xor({_LOW}, b >> 4) & 15) + 1], {_LOW} >> 4)), 4294967295)"


def _unit_sql(level: str, child: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{SEED}', '{level}', {child}::VARCHAR, doc_id::VARCHAR)), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0"


def _descent_sql(name: str, shards: int) -> str:
    """doc_id, shard over the ids of a tree of SHARDS shards in racks and regions and, beyond them, one a region."""
    tree = f"{name}_t AS (SELECT i AS shard, CASE WHEN i < {SHARDS} THEN i // {RACK_SHARDS} ELSE {SHARDS // RACK_SHARDS} + i - {SHARDS} END AS rack, CASE WHEN i < {SHARDS} THEN i // {RACK_SHARDS * REGION_RACKS} ELSE {SHARDS // (RACK_SHARDS * REGION_RACKS)} + i - {SHARDS} END AS region FROM range({shards}) t(i))"
    region = f"{name}_r AS (SELECT doc_id, region FROM ids, (SELECT region, count(*) AS w FROM {name}_t GROUP BY region) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY -ln({_unit_sql('region', 'region')}) / w, region) = 1)"
    rack = f"{name}_k AS (SELECT doc_id, rack FROM {name}_r JOIN (SELECT region, rack, count(*) AS w FROM {name}_t GROUP BY region, rack) USING (region) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY -ln({_unit_sql('rack', 'rack')}) / w, rack) = 1)"
    shard = f"{name} AS (SELECT doc_id, shard FROM {name}_k JOIN {name}_t USING (rack) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY -ln({_unit_sql('shard', 'shard')}), shard) = 1)"
    return f"{tree}, {region}, {rack}, {shard}"


OP13_SQL = f"""
WITH ids AS (SELECT DISTINCT doc_id FROM documents),
{_descent_sql("now", SHARDS)},
{_descent_sql("grown", SHARDS + 1)},
d AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size, {_CRC32} AS text_crc32 FROM documents),
p AS (SELECT d.*, 'key' AS law, now.shard::INT AS shard, grown.shard::INT AS grown_shard FROM d JOIN now ON now.doc_id IS NOT DISTINCT FROM d.doc_id JOIN grown ON grown.doc_id IS NOT DISTINCT FROM d.doc_id)
SELECT *, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws(':', '{SEED}', 'slot', coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR, text_crc32::VARCHAR, law, shard::VARCHAR, grown_shard::VARCHAR)), 1, 16), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM p
"""
