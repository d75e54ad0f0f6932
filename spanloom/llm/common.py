"""Shared plumbing of the corpus operators: tables written to the shared folder, size-checked broadcasts,
global row numbers and connected components.

Everything that cuts lineage goes through :func:`written`: a Parquet table below the folder the cluster names
in ``spark.checkpoint.dir``, which all executors and the driver see, so a lost executor costs a retry and no data.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a checked small side is broadcast; above them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
#: White space of all contracts: U+0020 and U+0009 to U+000D.
WHITE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session that names none gets a temporary one; on a cluster that
    would be another folder on each machine, so it is an error there."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as set it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/spanloom/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(table: DataFrame) -> None:
    """Delete a table that :func:`written` returned and that no later plan reads; only what is below the shared folder goes."""
    jvm = table.sparkSession._jvm
    conf = table.sparkSession._jsparkSession.sessionState().newHadoopConf()
    base = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(table.sparkSession)}/spanloom")
    fs = base.getFileSystem(conf)
    for name in {f.rpartition("/")[0].rpartition("/")[2] for f in table.inputFiles()}:
        fs.delete(jvm.org.apache.hadoop.fs.Path(base, name), True)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its counted rows are within ``max_rows`` and its measured bytes
    within BROADCAST_BYTES, else with a hint to merge: Spark would go by the size of its compressed files and broadcast it."""
    sizes = []
    for f in df.schema.fields:
        wide = f.dataType.simpleString() in ("string", "binary") or f.dataType.simpleString().startswith(("array", "map", "struct"))
        text = F.col(f"`{f.name}`") if f.dataType.simpleString() in ("string", "binary") else F.to_json(F.struct(f"`{f.name}`")) if wide else None
        sizes.append(F.lit(16) if text is None else F.coalesce(F.octet_length(text), F.lit(0)) + 16)
    rows, size = df.agg(F.count(F.lit(1)), F.sum(sum(sizes, F.lit(0)))).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= BROADCAST_BYTES else df.hint("merge")


def limit_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, as texts can be long; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null: starts of words, found without building them."""
    return F.coalesce(F.regexp_count(F.col(col) if isinstance(col, str) else col, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def unsigned_hash(seed: int, *cols: Column) -> Column:
    """51 well-mixed bits of the columns as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 13) / F.lit(float(1 << 51))


def with_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with a gapless global number from 0 in the given order, and the number of rows.

    Range partitions are sorted and written with (partition, index), so that later passes see the very same
    layout; only one count per partition reaches the driver. Rows that tie in ``order`` get numbers in any order. A column
    that is called ``name`` is replaced; all others stay.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, index, start = free_names(df, "__part", "__index", "__start")
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    laid = laid.withColumns({part: F.spark_partition_id(), index: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    laid = written(laid, "rows")
    starts, total = [], 0
    for number, count in sorted((r[0], r[1]) for r in laid.groupBy(part).count().collect()):  # one row a partition
        starts.append((number, total))
        total += count
    offsets = spark.createDataFrame(starts, f"{part} int, {start} long")
    numbered = laid.join(F.broadcast(offsets), part).withColumn(name, F.col(start) + F.col(index))
    return numbered.drop(part, start, index), total


def keep_by_key(df: DataFrame, keys: dict[str, Column], decisions: DataFrame, tag: str) -> DataFrame:
    """Rows of ``df`` whose key is decided to stay; of rows that share a kept key exactly one stays.

    ``decisions`` has the key columns and ``keep``, one row for each row of ``df``. Only keys that go, or that occur
    more than once, are joined back: by broadcast if they are few (counted and measured), else by a shuffle on the key.
    The columns of ``df`` may have any names; an empty table stays empty.
    """
    names = list(keys)
    made = free_names(df, *[f"__key_{k}" for k in names], *[f"__odd_{k}" for k in names], "__keep", "__n")
    own, other, keep, n = made[: len(names)], made[len(names) : 2 * len(names)], made[-2], made[-1]
    odd = decisions.groupBy(*names).agg(F.max("keep").alias(keep), F.count(F.lit(1)).alias(n))
    odd = written(odd.filter(~F.col(keep) | (F.col(n) > 1)).withColumnsRenamed(dict(zip(names, other))), tag)
    repeated = odd.filter(keep).limit(1).count() > 0
    side = small_side(odd)
    keyed = df.withColumns(dict(zip(own, keys.values())))
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, other)]
    if not repeated:
        return keyed.join(side, on, "left_anti").select(*map(column, df.columns))
    joined = keyed.join(side, on, "left")
    plain = joined.filter(F.col(keep).isNull())
    once = joined.filter(keep).dropDuplicates(own)
    return plain.unionByName(once).select(*map(column, df.columns))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; the component is its least node.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"):
    each round is two aggregations with map-side combine and two equi-joins, and O(log^2 n) rounds suffice.
    A hub is a key of many slim rows: AQE splits it in the joins, which are merged by hint, as a written table is far smaller
    than its rows in memory. Only a count and a checksum reach the driver.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = written(e, "edges")

    def state(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # all edges now point down: u > v
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = state(e)
        if after == before:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


