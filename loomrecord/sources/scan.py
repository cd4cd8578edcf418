"""Scans of framed text files, samples, manifests and path classification."""

from __future__ import annotations

import hashlib

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrecord.operators.records import classify
from loomrecord.session import scratch_dir
from loomrecord.sources import framed


def register(spark: SparkSession) -> None:
    # Executors get the source by value, so they need no installed copy of this package.
    cloudpickle.register_pickle_by_value(framed)
    spark.dataSource.register(framed.FramedText)


def scan_lines(spark: SparkSession, path: str, split_bytes: int = 128 << 20) -> DataFrame:
    """Physical lines with byte positions and the global ordinal per source.

    A first pass counts lines per split; the prefix sums (one small row per split)
    are written to the shared scratch folder and handed to the second pass, whose
    tasks then number their lines alone. The lines themselves are never shuffled.
    """
    register(spark)
    reader = spark.read.format("framed_text").option("path", path).option("splitBytes", str(split_bytes))
    counts = reader.option("mode", "count").load()
    before = Window.partitionBy("source_id").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    target = f"{scratch_dir(spark)}/bases"
    bases.select("source_id", "split_start", "base").write.json(target)
    return spark.read.format("framed_text").option("path", path).option("splitBytes", str(split_bytes)).option("bases", target).load()


def scan_records(spark: SparkSession, path: str, split_bytes: int = 128 << 20) -> DataFrame:
    """Lines with text, value, parse state and problems."""
    return classify(scan_lines(spark, path, split_bytes), raw="raw")


def follow_records(spark: SparkSession, path: str) -> DataFrame:
    """A stream of whole new lines of growing files (ordinals count within a batch range)."""
    register(spark)
    return spark.readStream.format("framed_text").option("path", path).load()


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Fast path without byte positions: JVM text reader, LF lines, one trailing CR removed."""
    df = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return df.select(F.col("_metadata.file_path").alias("source_id"), F.regexp_replace("value", r"\r$", "").alias("text"))


def export_raw(records: DataFrame, path: str, selection: Column | None = None, refs: DataFrame | None = None, partitions: int | None = None) -> None:
    """K1/K2: raw bytes of all, selected or matching records in physical order; never overwrites."""
    chosen = records if selection is None else records.filter(selection)
    if refs is not None:
        chosen = chosen.join(refs.select("source_id", "ordinal").dropDuplicates(), ["source_id", "ordinal"], "left_semi")
    chosen = chosen.select("source_id", "ordinal", "raw", "delim_len")
    spread = chosen.repartitionByRange(partitions, "source_id", "ordinal") if partitions else chosen.repartitionByRange("source_id", "ordinal")
    register(records.sparkSession)
    spread.sortWithinPartitions("source_id", "ordinal").write.format("framed_text").mode("append").option("path", path).save()


def in_range(first: int, last: int) -> Column:
    """K2: an inclusive ordinal range."""
    return F.col("ordinal").between(first, last)


def export_receipt(records: DataFrame, selection: Column) -> DataFrame:
    """K3: records and bytes of a selection beside the examined totals."""
    size = F.col("content_len") + F.col("delim_len")
    hit = F.coalesce(selection, F.lit(False))
    return records.agg(F.count_if(hit).alias("records"), F.coalesce(F.sum(F.when(hit, size)), F.lit(0)).cast("bigint").alias("bytes"),
                       F.count(F.lit(1)).alias("examined_records"), F.sum(size).cast("bigint").alias("examined_bytes"))


def selection_digest(refs: DataFrame, buckets: int = 4096) -> DataFrame:
    """K4: digest of a set of references, whatever their order or repetition.

    References are hashed one by one and combined bucket by bucket in ordinal order;
    the digest is the hash over the ordered bucket digests. `conflicts` counts
    references that name one record with different coordinates.
    """
    unique = refs.select("source_id", "ordinal", "byte_start", "byte_end").dropDuplicates()
    clashes = unique.groupBy("source_id", "ordinal").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("byte_start", "byte_end")).alias("at"))
    line = F.sha2(F.to_json(F.struct("at.byte_end", "at.byte_start", "ordinal", "source_id")), 256)
    keyed = clashes.select(F.pmod(F.xxhash64("source_id", "ordinal"), F.lit(buckets)).alias("b"), line.alias("h"), (F.col("n") > 1).alias("clash"))
    # A sum of 64-bit pieces is order-free, so no bucket gathers its lines.
    pieces = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    sums = keyed.agg(F.count(F.lit(1)).alias("refs"), F.count_if("clash").alias("conflicts"), *pieces)
    return sums.select("refs", "conflicts", F.sha2(F.concat_ws("|", F.col("refs").cast("string"), *[F.col(f"p{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def head_tail(records: DataFrame, head_bytes: int = 96 << 10, tail_bytes: int = 64 << 10) -> DataFrame:
    """The whole lines inside the first and last bytes of each source."""
    size = records.groupBy("source_id").agg(F.max(F.col("byte_end") + F.col("delim_len")).alias("_size"))
    marked = records.join(size, "source_id")
    end = F.col("byte_end") + F.col("delim_len")
    return marked.withColumn("part", F.when(end <= head_bytes, "head").when(F.col("byte_start") >= F.col("_size") - tail_bytes, "tail")).filter(F.col("part").isNotNull()).drop("_size")


def detection_sample(records: DataFrame, edge: int = 32, window: int = 8) -> DataFrame:
    """First and last rows and a window at each quarter, per source, without repeats."""
    n = records.groupBy("source_id").agg((F.max("ordinal") + 1).alias("_n"))
    o = F.col("ordinal")
    quarters = [o.between(F.floor(F.col("_n") * q), F.floor(F.col("_n") * q) + window - 1) for q in (0.25, 0.5, 0.75)]
    keep = (o < edge) | (o >= F.col("_n") - edge) | quarters[0] | quarters[1] | quarters[2]
    return records.join(n, "source_id").filter(keep).drop("_n")


# Path shapes that identify a producer.
STRONG_PATHS = [
    (r"(^|/)\.codex/history\.jsonl$", "codex-history"),
    (r"(^|/)\.codex/session_index\.jsonl$", "codex-session-index"),
    (r"(^|/)\.claude/jobs/[^/]+/timeline\.jsonl$", "claude-job-timeline"),
    (r"(^|/)sessions/\d{4}/\d{2}/\d{2}/rollout-[^/]+\.jsonl$", "codex-rollout"),
    (r"(^|/)archived_sessions/rollout-[^/]+\.jsonl$", "codex-rollout"),
    (r"(^|/)\.codex/log/session-\d{8}t\d{6}z\.jsonl$", "codex-tui-session-log"),
]
# history.jsonl belongs to two producers and so hints at neither.
# Names that only hint at one.
WEAK_NAMES = [
    (r"^session_index\.jsonl$", "codex-session-index"), (r"^rollout-.*\.jsonl$", "codex-rollout"), (r"^trace\.jsonl$", "codex-trace"), (r"^session-.*\.jsonl$", "codex-tui-session-log"),
    (r"\.jsonl\.zst$", "codex-compressed-rollout"),
]


def source_surface(path: Column) -> Column:
    """struct(kind, strength) of a path; without a name that hints, a sessions folder does."""
    norm = F.lower(F.regexp_replace(path, r"\\", "/"))
    base = F.substring_index(norm, "/", -1)
    strong = F.coalesce(*[F.when(norm.rlike(p), F.lit(k)) for p, k in STRONG_PATHS])
    weak = F.coalesce(*[F.when(base.rlike(p), F.lit(k)) for p, k in WEAK_NAMES], F.when(norm.rlike(r"(^|/)(sessions|archived_sessions)/"), F.lit("codex-rollout")))
    kind = F.coalesce(strong, weak)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(strong.isNotNull(), "strong").otherwise("weak").alias("strength")))


def source_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The session files below provider roots, with size and time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    out = files.select(F.col("path").alias("source_id"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime"))
    return out.withColumn("surface", source_surface(F.col("source_id")))


def manifest(spark: SparkSession, path: str, upto: DataFrame | None = None, split_bytes: int = 128 << 20) -> DataFrame:
    """(source_id, size_bytes, mtime, prefix_sha) of the files at a path, digests taken from their bytes.

    `prefix_sha` covers each whole file, or with `upto`, an earlier manifest, the bytes
    that the file had then (null where it is shorter now). Ranges of `split_bytes` are
    digested by tasks of their own; the digest of a file is that of its ranges' digests in
    order, so it depends on `split_bytes`, which both manifests must share.
    """
    register(spark)
    files = framed.list_files(path)
    found = spark.createDataFrame(files, "source_id string, size_bytes bigint, mtime bigint")
    want = found.withColumn("stop", F.col("size_bytes")) if upto is None else found.join(upto.select("source_id", F.col("size_bytes").alias("stop")), "source_id", "left")
    covered = F.col("stop").isNotNull() & (F.col("stop") <= F.col("size_bytes"))
    ranges = want.where(covered).select("source_id", "stop", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("stop") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))).alias("at"))

    def run(frames):
        for frame in frames:
            shas = []
            for name, stop, at in zip(frame["source_id"], frame["stop"], frame["at"]):
                fs, _ = framed.open_path(name)
                left, sha = min(split_bytes, stop - at), hashlib.sha256()
                with fs.open_input_file(name) as f:
                    f.seek(at)
                    while left > 0 and (block := f.read(min(framed.CHUNK, left))):
                        sha.update(block)
                        left -= len(block)
                shas.append(sha.hexdigest())
            yield frame[["source_id", "at"]].assign(sha=shas)
    parts = ranges.repartition("source_id", "at").mapInPandas(run, "source_id string, at bigint, sha string")
    whole = parts.groupBy("source_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "sha"))), lambda x: x["sha"]), "").cast("binary"), 256).alias("prefix_sha"))
    return found.join(whole, "source_id", "left")


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """Manifests (source_id, size_bytes, mtime, prefix_sha) -> what happened to each source.

    `prefix_sha` of the new side is the digest of the bytes the old side covered.
    """
    j = old.select("source_id", *[F.col(c).alias(f"old_{c}") for c in ("size_bytes", "mtime", "prefix_sha")]).join(
        new.select("source_id", "size_bytes", "mtime", "prefix_sha"), "source_id", "full_outer")
    same = F.col("old_prefix_sha") == F.col("prefix_sha")
    change = (
        F.when(F.col("old_size_bytes").isNull(), "new").when(F.col("size_bytes").isNull(), "delete")
        .when(F.col("size_bytes") < F.col("old_size_bytes"), "truncate").when(same.isNull(), "unknown").when(~same, "replace")
        .when(F.col("size_bytes") > F.col("old_size_bytes"), "append").otherwise("unchanged"))
    return j.select("source_id", change.alias("change"))
