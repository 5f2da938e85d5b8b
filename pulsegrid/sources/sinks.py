"""Writing event tables and result tables."""
from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.asof import small
from ..operators.ordered import union_all
from ..schema import CHUNK_US, EVENTS
from ..session import cut_lineage
from . import events, raw


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's checkpoint folder (a temporary one in local mode where none is set)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-out-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_event_table(ev: DataFrame, path: str, bucket_us: int = CHUNK_US) -> None:
    """Decode once: Parquet partitioned by recording and time bucket, sorted by time.

    Range partitioning on (rec_id, t, seq) splits a crowded recording or bucket over many tasks
    and leaves every file sorted, so row-group statistics prune time predicates.
    """
    t = ev.withColumn("t_bucket", F.floor(F.col("t") / bucket_us))
    (t.repartitionByRange("rec_id", "t_bucket", "t", "seq")
     .sortWithinPartitions("rec_id", "t_bucket", "t", "seq")
     .write.mode("overwrite").partitionBy("rec_id", "t_bucket").parquet(path))


# ------------------------------------------------------------------ incremental ingest
#: A line of the manifest: a recording, what its source was when it was read, and where its events are.
MANIFEST = "rec_id string, path string, bytes long, modified_us long, fmt string, width int, height int, n_words long, digest string, generation int, sha256 string"


def manifest_versions(path: str) -> list[int]:
    """Numbers of the manifests that were written whole, in order."""
    fs, folder = raw.file_system(f"{path}/manifest")
    found = fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
    return sorted(int(f.path.rsplit("/", 2)[-2].removeprefix("v=")) for f in found if f.base_name == "_SUCCESS")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest of an event table (no rows before the first ingest)."""
    versions = manifest_versions(path)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v={versions[-1]}") if versions else spark.createDataFrame([], MANIFEST)


def ingest_folder(spark: SparkSession, source: str, path: str, bucket_us: int = CHUNK_US, **options) -> list[str]:
    """Bring an event table up to date with a folder of raw recordings; returns the names of those that were read.

    A recording is read if the manifest does not have it with the same size and time of change.  Its events go to the folder of a
    new generation, and the manifest that names it is written last: readers follow the newest whole manifest, so they see all of an
    ingest or nothing of it, and one that was cut short leaves only a folder that no manifest names.  Recordings whose source is
    gone leave the manifest.  The digest sums a hash of every word and its place, whatever the ranges a file was read in; sha256 is
    that of the whole file.  Recordings of older manifests, which have none, are read again.
    """
    version = max(manifest_versions(path), default=0) + 1
    old = cut_lineage(read_manifest(spark, path))
    heads = cut_lineage(raw.read_headers(spark, source, options.get("pattern")))
    same = ["rec_id", "bytes", "modified_us"]
    names = [r.rec_id for r in heads.join(old.where("sha256 IS NOT NULL").select(*same), same, "left_anti").select("rec_id").collect()]
    kept = old.join(heads.select("rec_id"), "rec_id", "left_semi").where(~F.col("rec_id").isin(names) if names else F.lit(True))
    if names:
        words = raw.read_words(spark, source, names=names, **options)
        digest = F.sum(F.xxhash64("word_idx", "word").cast("decimal(38,0)")).cast("string")
        facts = words.groupBy("rec_id").agg(F.count("*").alias("n_words"), digest.alias("digest"))
        ev = union_all(*[events.decode_words(raw.read_words(spark, source, names=names, fmt=f, **options), f) for f in raw.WORDS])
        numbered = events.number_events(ev.withColumn("_order", F.col("word_idx") * 64 + F.col("bit")), "_order")
        write_event_table(numbered, f"{path}/data/generation={version}", bucket_us)
        read = heads.where(F.col("rec_id").isin(names))
        new = read.join(facts, "rec_id", "left").join(raw.file_hashes(read, source), "rec_id", "left").withColumn("generation", F.lit(version))
        kept = kept.unionByName(new.select(*kept.columns))
    kept.coalesce(1).write.parquet(f"{path}/manifest/v={version}")
    return names


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """The events that the newest manifest names; partitions of older generations are pruned."""
    now = small(read_manifest(spark, path).select("rec_id", "generation"))
    ev = spark.read.schema(f"{EVENTS}, generation int, t_bucket long").parquet(f"{path}/data")
    return ev.join(now, ["rec_id", "generation"]).select("rec_id", "seq", "x", "y", "p", "t", "t_bucket", "generation")


def write_result_table(df: DataFrame, path: str) -> None:
    """Every result lands as Parquet and as CSV with a header."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
