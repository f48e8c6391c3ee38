"""Processing only new or changed records, safe against failures and late or repeated rows (problem 3).

Method: per-partition fingerprints from counts and additive row hashes; only changed partitions are recomputed, each
replaced atomically through dynamic partition overwrite.

Partitions follow the sources: rows of one root stay in one of ``ROOT_GROUPS`` groups, and a group is divided by path into as
many buckets as its rows ask for, so a root without news changes none of its partitions. The number of buckets belongs to
the state; once the largest group has outgrown it four times, the next run lays the partitions out anew and recomputes all.

One folder holds ``result/`` (Parquet, partitioned by ``part``; the column run tells in which run a row first came out) and
``state/<n>/`` (fingerprints of run n). The state is written last, by a rename that fails if that run was already committed by
another process. A run that dies before leaves the older state in force; the next run recomputes the same partitions and
overwrites whatever was half done, so nothing is skipped or repeated: whoever processes the rows of run n has each row once.
While a run writes, a reader may see some partitions old and some new, each whole.

Row hashes are summed in three lanes, so that the fingerprint does not depend on row order or partitioning and
counts repeated rows. A partition that has become empty is overwritten by a marker row, which is not part of the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.skew import heavy_keys, lookup
from shelfmark.session import new_path, remove

#: Groups that roots fall into by their hash.
ROOT_GROUPS = 64
#: Rows of a partition, about.
PART_ROWS = 1_000_000
#: Tasks that write one partition at most; it has up to four times ``PART_ROWS`` rows.
WRITERS = 4
_LANES = ("lane_low", "lane_mid", "lane_high")


def with_partition(df: DataFrame, key: str, buckets: int, root: str | None = None) -> DataFrame:
    """Adds ``part`` from the group of ``root`` and the bucket of ``key`` (null is a value like others)."""
    group = F.pmod(F.xxhash64(root), F.lit(ROOT_GROUPS)) if root else F.lit(0)
    return df.withColumn("part", (group * buckets + F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int"))


def buckets_for(df: DataFrame, root: str) -> int:
    """Buckets that the largest group of roots asks for."""
    largest = df.groupBy(F.pmod(F.xxhash64(root), F.lit(ROOT_GROUPS)).alias("g")).count().agg(F.max("count")).first()[0] or 0
    return max(1, -(-largest // PART_ROWS))


def fingerprints(df: DataFrame) -> DataFrame:
    """part, n and the sums of the row hashes' three lanes (22, 22 and 20 bits) of a DataFrame with a ``part`` column; order-independent."""
    cols = [F.when(F.col(c).isNull(), F.lit("\x00null")).otherwise(F.col(c).cast("string")) for c in sorted(df.columns) if c != "part"]
    low = F.lit((1 << 22) - 1)
    lanes = (F.col("_h").bitwiseAND(low), F.shiftrightunsigned("_h", 22).bitwiseAND(low), F.shiftrightunsigned("_h", 44))
    return df.select("part", F.xxhash64(*cols).alias("_h")).groupBy("part").agg(F.count("*").alias("n"), *[F.sum(x).alias(name) for x, name in zip(lanes, _LANES, strict=True)])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def last_run(spark: SparkSession, folder: str) -> int:
    """Number of the last completed run of a state folder; 0 if there is none."""
    fs, p = _fs(spark, f"{folder}/state")
    if not fs.exists(p):
        return 0
    done = [int(s.getPath().getName()) for s in fs.listStatus(p) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(done, default=0)


def state_buckets(spark: SparkSession, folder: str) -> int | None:
    """The number of buckets that the state in force was laid out with; null without state."""
    n = last_run(spark, folder)
    row = spark.read.parquet(f"{folder}/state/{n}").agg(F.max("buckets")).first() if n else None
    return row[0] if row else None


def _commit(spark: SparkSession, pending: str, target: str) -> None:
    """Rename that fails where the target is there already."""
    jvm = spark.sparkContext._jvm
    fs, p = _fs(spark, target)
    fs.mkdirs(p.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(_fs(spark, pending)[1], p, none)


def run_incremental(source: DataFrame, compute: Callable[[DataFrame], DataFrame], folder: str, buckets: int = 1, before_commit: Callable[[], None] | None = None) -> tuple[DataFrame, list[int]]:
    """Bring the result under ``folder`` up to date with ``source``; returns it (with run) and the partitions recomputed.

    source: rows with a ``part`` column, laid out in ``buckets`` buckets. compute: a function of rows of whole partitions to distinct
    rows that keep ``part``; it must not mix partitions. before_commit is called when the results are written. An empty source
    gives an empty result.
    """
    spark = source.sparkSession
    n = last_run(spark, folder)
    anew = n > 0 and state_buckets(spark, folder) != buckets
    # Laid out by partition, so that the recomputation reads the changed ones only.
    staged, pending = new_path(spark, "staged"), new_path(spark, "pending")
    kept = [c for c in source.columns if c != "part"]
    source.repartition("part", F.pmod(F.xxhash64(*kept), F.lit(WRITERS))).write.partitionBy("part").parquet(staged)
    laid = spark.read.schema(", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept] + ["part int"])).parquet(staged)
    fingerprints(laid).withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(pending)  # one row a partition
    schema = "part int, n long, lane_low long, lane_mid long, lane_high long, buckets int"
    now = spark.read.schema(schema).parquet(pending)
    if n:
        before = spark.read.schema(schema).parquet(f"{folder}/state/{n}")
        same = now.join(F.broadcast(before), now.columns, "left_semi").select("part")
        parts = now.select("part").union(before.select("part")).distinct()
        changed = sorted(r[0] for r in parts.join(F.broadcast(same), "part", "left_anti").collect())
    else:
        changed = sorted(r[0] for r in now.select("part").collect())

    result = f"{folder}/result"
    rows = compute(laid.filter(F.col("part").isin(changed)))
    columns = [c for c in rows.columns if c != "part"]
    read_schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns] + ["run int", "_mark boolean", "part int"])
    if changed or not n:
        if n:  # what came out in an earlier run keeps that run's number, wherever its partition was laid out
            old = spark.read.schema(read_schema).parquet(result).filter(~F.col("_mark") & (F.col("run") <= n))
            old = (old if anew else old.filter(F.col("part").isin(changed))).select(*[F.col(c).alias(f"_o_{c}") for c in columns], F.col("run").alias("_o_run"))
            same_row = [rows[c].eqNullSafe(F.col(f"_o_{c}")) for c in columns]
            rows = rows.join(old, same_row, "left").select(*columns, F.coalesce("_o_run", F.lit(n + 1)).cast("int").alias("run"), "part")
        else:
            rows = rows.withColumn("run", F.lit(1).cast("int"))
        marks = spark.createDataFrame([(p,) for p in changed], "part int").select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in [*columns, "run"]], F.lit(True).alias("_mark"), "part")
        out = rows.select(*columns, "run", F.lit(False).alias("_mark"), "part").unionByName(marks)
        # A partition's rows are divided further, so that a large one is not written by one task.
        spread = out.repartition("part", F.pmod(F.xxhash64(*columns), F.lit(WRITERS)))
        (spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(result))
    if before_commit:
        before_commit()
    _commit(spark, pending, f"{folder}/state/{n + 1}")  # the state of this run is in force from here
    remove(spark, staged)
    read = spark.read.schema(read_schema).parquet(result)
    return read.filter(~F.col("_mark")).select(*columns, "run"), changed


def scan_cutoffs(scans: DataFrame) -> DataFrame:
    """root, cutoff: the greatest attempted_at of the root's successful scans; null if it has none."""
    ok = F.col("complete") & F.col("success_at").isNotNull() & F.col("error").isNull()
    return scans.filter(F.col("root").isNotNull()).groupBy("root").agg(F.max(F.when(ok, F.col("attempted_at"))).alias("cutoff"))


#: A path has at most so many folders looked at for its root.
MAX_ROOTS_BROADCAST = 10_000


def with_root(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds root and cutoff of the innermost root folder that holds source_path; null where none does.

    The path's own folders are joined to the roots by equality. With at most ``MAX_ROOTS_BROADCAST`` roots the roots are
    broadcast, beyond that the folders are shuffled.
    """
    few = roots.limit(MAX_ROOTS_BROADCAST + 1).count() <= MAX_ROOTS_BROADCAST
    words = F.split("source_path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(words, 1, i), "/").alias("root")))
    exploded = documents.withColumn("_f", F.explode(folders)).select("*", "_f.level", "_f.root").drop("_f")
    clean = roots.select(F.regexp_replace("root", "/+$", "").alias("root"), "cutoff")
    hit = exploded.join(F.broadcast(clean) if few else clean, "root").groupBy("document_id").agg(F.max(F.struct("level", "root", "cutoff")).alias("_r"))
    return documents.join(hit, "document_id", "left").select(*documents.columns, "_r.root", "_r.cutoff")


def landed_sources(versions: DataFrame, documents: DataFrame, scans: DataFrame) -> DataFrame:
    """root, source_path, source_hash (lower case), landed_at, cutoff: what :func:`new_content` works on."""
    docs = with_root(documents.select("document_id", "source_path").filter(F.col("document_id").isNotNull()), scan_cutoffs(scans))
    hashes = versions.filter(F.col("source_hash").isNotNull()).select("document_id", F.lower("source_hash").alias("source_hash"), "landed_at")
    heavy = heavy_keys(hashes.groupBy("document_id").count(), "document_id", "count")
    return lookup(hashes, docs, "document_id", heavy, "inner").select("root", "source_path", "source_hash", "landed_at", "cutoff")


def bring_up_to_date(landed: DataFrame, folder: str, before_commit: Callable[[], None] | None = None) -> tuple[DataFrame, list[int]]:
    """Run :func:`new_content` incrementally over landed rows; landed should be written, it is read more than once.

    Returns source_path, source_hash, run, and the partitions recomputed.
    """
    wanted, known = buckets_for(landed, "root"), state_buckets(landed.sparkSession, folder)
    buckets = known if known and wanted <= 4 * known else wanted
    return run_incremental(with_partition(landed, "source_path", buckets, "root").drop("root"), new_content, folder, buckets, before_commit)


def new_content(rows: DataFrame) -> DataFrame:
    """The source contents that first landed after their root's cut-off, each once: source_path, source_hash, part.

    Earliest landing decides, so late and repeated deliveries change nothing. Without cut-off every content is new; a
    content that never landed (null) is new only without cut-off.
    """
    first = rows.groupBy("part", "source_path", "source_hash").agg(F.min("landed_at").alias("first_landed"), F.max("cutoff").alias("cutoff"))
    return first.filter(F.col("cutoff").isNull() | (F.col("first_landed") > F.col("cutoff"))).select("source_path", "source_hash", "part")
