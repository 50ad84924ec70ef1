"""Writers: frame datasets, results, metadata views, and numbered file names.

A target that exists is an error unless force is set; a dry run writes nothing and gives the rows back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelark.operators.trim import survivors

#: Where an episode's rows and its metadata are, of which a table that Spark reads whole needs no more than zeros.
LOCATORS = ("data/chunk_index", "data/file_index", "meta/episodes/chunk_index", "meta/episodes/file_index")
#: What an observation's image must be to be encoded with loss.
ENCODED_KEYS = ("observation/image", "observation/wrist_image")


def write_frames(frames: DataFrame, path: str, key: str | None = None, force: bool = False, dry_run: bool = False, order: list[str] | None = None) -> DataFrame:
    """Parquet frames, in folders by key where one is given (rows are dealt by key and a salt first, so that a key
    makes few files and a hot key is not one task's work).

    With an order, rows lie in it within each file, and without a key the files follow one another in it too: they are dealt by ranges, not sorted by one task."""
    if not dry_run:
        out = frames
        if key:
            out = frames.withColumn("_salt", F.pmod(F.xxhash64(*frames.columns), F.lit(8))).repartition(key, "_salt").drop("_salt")
        elif order:
            out = frames.repartitionByRange(*order)
        if order:
            out = out.sortWithinPartitions(*([key] if key else []), *order)
        writer = out.write.mode("overwrite" if force else "errorifexists")
        (writer.partitionBy(key) if key else writer).parquet(path)
    return frames


def _kept(frames: DataFrame) -> DataFrame:
    plan = frames.groupBy("ep").agg(F.count("*").alias("n"))
    return survivors(plan.select("ep", "n", F.lit(0).cast("long").alias("start"), (F.col("n") - 1).alias("stop"), F.col("n").alias("keep")), 1)


def episode_table(frames: DataFrame, fps: float) -> DataFrame:
    """A row per episode of (ep, frame, ...): its dense number, the one it had, length, range of rows, duration, locators."""
    e = _kept(frames).select(F.col("new_ep").alias("episode_index"), F.col("ep").alias("source_episode"), F.col("keep").alias("length"), F.col("from_index").alias("dataset_from_index"), F.col("to_index").alias("dataset_to_index"))
    return e.withColumn("duration", F.col("length") / F.lit(fps)).withColumns({c: F.lit(0).cast("long") for c in LOCATORS})


def write_dataset(frames: DataFrame, path: str, fps: float, force: bool = False) -> None:
    """Frames under data/ and episodes under meta/episodes/, numbered anew; (ep, frame) name a row, and frames of an
    episode count from 0 in their order. The metadata comes last, so a target without it is not finished."""
    numbered = frames.withColumn("_at", F.row_number().over(Window.partitionBy("ep").orderBy("frame")) - 1)
    rows = numbered.join(_kept(frames).select("ep", "new_ep", "from_index"), "ep")
    rows = rows.withColumns({"episode_index": F.col("new_ep"), "frame_index": F.col("_at").cast("long"), "timestamp": F.col("_at") / F.lit(fps), "index": F.col("from_index") + F.col("_at")})
    write_frames(rows.drop("ep", "frame", "_at", "new_ep", "from_index"), f"{path}/data", force=force)
    write_frames(episode_table(frames, fps), f"{path}/meta/episodes", force=force)


def bounds_of(spark: SparkSession, path: str) -> DataFrame:
    """(episode_index, start, stop): each episode's rows [start, stop) by the metadata of the dataset at path."""
    e = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/meta/episodes")
    return e.select("episode_index", F.col("dataset_from_index").alias("start"), F.col("dataset_to_index").alias("stop"))


def split_episodes(episodes: DataFrame, given: list[int] | None = None) -> DataFrame:
    """Adds split: val for every tenth of the episodes that there are, from the one numbered 5, or for those given instead; train for the others.

    A given number without an episode is an error."""
    if given is None:
        val = (F.col("episode_index") >= 5) & (F.col("episode_index") % 10 == 5)
    else:
        wanted = sorted(set(given))
        there = {r[0] for r in episodes.where(F.col("episode_index").isin(wanted)).select("episode_index").collect()}  # those given at most
        if set(wanted) - there:
            raise ValueError(f"no episodes {sorted(set(wanted) - there)} to hold out")
        val = F.col("episode_index").isin(wanted)
    return episodes.withColumn("split", F.when(val, "val").otherwise("train"))


def index_points(bounds: DataFrame, need: int, stride: int) -> DataFrame:
    """(episode_index, index): every stride-th row of an episode's (start, stop) that has more than `need` rows from it on."""
    starts = F.expr(f"sequence(start, stop - {need} - 1, {stride}L)")
    return bounds.where(F.col("stop") - F.col("start") > need).select("episode_index", F.explode(starts).alias("index"))


def write_view(spark: SparkSession, source: str, target: str, keep: list[str], force: bool = False) -> list[str]:
    """Every metadata shard below source without the cameras that are not kept, at the same relative path below target.

    A shard is written as a folder of the file's name, which Spark reads as it reads the file. Shards are metadata, a job
    each; frames and videos are not copied. Gives the relative paths."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(source)
    camera_view(whole, keep)  # an unknown camera ends this before anything is written
    root = source.rstrip("/").split(":", 1)[-1].lstrip("/")
    names = sorted(f.split(f"{root}/", 1)[1] for f in whole.inputFiles())
    for name in names:
        camera_view(spark.read.parquet(f"{source}/{name}"), keep).coalesce(1).write.mode("overwrite" if force else "errorifexists").parquet(f"{target}/{name}")
    return names


def write_results(rows: DataFrame, path: str, force: bool = False) -> None:
    """One JSON object a row; null fields are kept."""
    rows.write.mode("overwrite" if force else "errorifexists").option("ignoreNullFields", "false").json(path)


def camera_view(episodes: DataFrame, keep: list[str]) -> DataFrame:
    """Episode metadata without the cameras that are not kept: a projection, so nothing is copied.

    Cameras are columns videos/<camera>/...; a short name in keep means observation.images.<name>. An unknown camera, or
    nothing to drop, is an error."""
    have = {c.split("/")[1] for c in episodes.columns if c.startswith("videos/")}
    full = {k if k.startswith("observation.images.") else f"observation.images.{k}" for k in keep}
    if full - have:
        raise ValueError(f"unknown cameras {sorted(full - have)}; there are {sorted(have)}")
    if full == have:
        raise ValueError("every camera is kept; there is nothing to drop")
    return episodes.select(*[F.col(f"`{c}`") for c in episodes.columns if not c.startswith("videos/") or c.split("/")[1] in full])


def numbered_names(selected: DataFrame, group: str, order: str) -> DataFrame:
    """Adds file_name: frame_0001.jpg and on, in order within each group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return selected.withColumn("file_name", F.format_string("frame_%04d.jpg", n))


def wire_encoding(key, ndim, dtype):
    """How an observation array goes on the wire: jpeg for known images of bytes, otherwise raw."""
    return F.when(key.isin(*ENCODED_KEYS) & (ndim == 3) & (dtype == "uint8"), "jpeg").otherwise("raw")
