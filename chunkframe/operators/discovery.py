"""Datasets in listings of files (root, path): one aggregation per folder, by marker files alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import SUFFIXES

# The groups that hold images and labels at the root of a container.
IMAGE_GROUPS, LABEL_GROUPS = "raw|data|image|images|img|em", "labels|label|seg"
_ARRAY = r"(/(s0|0))?/(zarr\.json|\.zarray)$"


def convertible(path: Column) -> Column:
    """Whether a file has one of the endings that can be read."""
    ends = "|".join(e for group in SUFFIXES.values() for e in group)
    return F.lower(path).rlike(rf"\.({ends})$")


def folders(listing: DataFrame, key: str, root: Column) -> DataFrame:
    """(key, files, format, has_image, has_labels, stack, known): what each folder is.

    A container is a Zarr group with a group of images or labels that holds an array; then come
    Zarr, N5 and precomputed by their marker files; anything else is a folder of files.
    """
    inner = F.substring(F.col("path"), F.length(root) + 1, F.lit(1 << 20))
    rows = listing.select(key, inner.alias("inner"), "path")
    any_ = lambda pattern: F.bool_or(F.col("inner").rlike(pattern))
    group, image = any_(r"^/(zarr\.json|\.zgroup)$"), any_(rf"^/({IMAGE_GROUPS}){_ARRAY}")
    labels = any_(rf"^/({LABEL_GROUPS})(/[^/]+)?{_ARRAY}")
    found = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("files"), group.alias("group"), image.alias("image"), labels.alias("labels"), any_(r"^/(zarr\.json|\.zarray|\.zgroup)$|^/(s0|0)/(zarr\.json|\.zarray)$").alias("zarr"),
        any_(r"^/attributes\.json$").alias("n5"), any_(r"^/info$").alias("info"), F.bool_and(F.col("inner").rlike(r"\.tiff?$")).alias("tiffs"), F.bool_or(convertible(F.col("path"))).alias("known"),
    )
    whole = F.col("group") & (F.col("image") | F.col("labels"))
    kind = F.when(whole, "container").when(F.col("zarr"), "zarr").when(F.col("n5"), "n5").when(F.col("info"), "precomputed").otherwise("files")
    return found.select(key, "files", kind.alias("format"), (whole & F.col("image")).alias("has_image"), (whole & F.col("labels")).alias("has_labels"), (F.col("tiffs") & (F.col("files") > 1)).alias("stack"), "known")


def input_mode(output: Column) -> Column:
    """How a folder of ``folders`` is converted: a stack is one volume only if the output is one."""
    one = F.lower(output).rlike(r"\.(zarr|n5)$")
    return (
        F.when(F.col("format") == "container", "discovered_folder").when(F.col("format") != "files", "single_file")
        .when(F.col("stack"), F.when(one, "single_file").otherwise("batch_directory")).when(F.col("known"), "discovered_folder").otherwise("batch_directory")
    )


def levels(listing: DataFrame, key: str) -> DataFrame:
    """(key, prefix, top): how a folder names its levels (s0 wins, also where there is none) and the largest number; labels don't count."""
    number = lambda prefix: F.regexp_extract("path", rf"/{prefix}([0-9]+)/(?:zarr\.json|\.zarray|attributes\.json)$", 1).try_cast("int")
    rows = listing.where(~F.col("path").rlike(rf"/({LABEL_GROUPS})/"))
    found = listing.select(key).distinct().join(rows.groupBy(key).agg(F.max(number("s")).alias("s"), F.max(number("")).alias("plain")), key, "left")
    return found.select(key, F.when(F.col("s").isNull() & F.col("plain").isNotNull(), "").otherwise("s").alias("prefix"), F.coalesce("s", "plain").alias("top"))


# Folders that are looked into first, in this order.
FIRST_FOLDERS = ("s0", "em", "raw", "data", "volumes", "recon-1", "setup0")


def first_arrays(listing: DataFrame, key: str, is_array: Column, depth: int = 4, most: int = 10) -> DataFrame:
    """(key, path, depth): the first array below each root, level by level, in at most ``most`` folders of each folder and ``depth`` levels down.

    ``listing``: key and ``inner``, the path of a file below its root. ``is_array``: whether a file marks its folder as an array. Folders are
    looked into by ``FIRST_FOLDERS``, then by name; the order of a level follows that of the folders above.
    """
    up_to = lambda path, i: F.substring_index(path, "/", i)
    files = listing.select(key, "inner", F.split("inner", "/").alias("parts"), is_array.alias("is_array"))
    size = F.size("parts") - 1  # folders above the file
    steps = [F.when(size >= i, F.struct(F.lit(i).alias("level"), up_to("inner", i - 1).alias("parent"), F.get("parts", F.lit(i - 1)).alias("name"))) for i in range(1, depth + 1)]
    folders_ = files.select(key, F.explode(F.array(*steps)).alias("p")).where("p is not null").select(key, "p.*").distinct()
    names = F.array(*map(F.lit, FIRST_FOLDERS))
    place = F.array_position(names, F.col("name"))
    siblings = Window.partitionBy(key, "level", "parent").orderBy(F.when(place > 0, place).otherwise(100), "name")
    ranked = folders_.withColumn("place", F.row_number().over(siblings)).where(F.col("place") <= most)
    ranked = ranked.select(key, "level", F.when(F.col("level") == 1, F.col("name")).otherwise(F.concat("parent", F.lit("/"), "name")).alias("folder"), "place")
    # every array meets the places of all folders above it; one of them that wasn't looked into leaves it out
    arrays = files.where(F.col("is_array") & (size <= depth) & (size > 0)).select(key, size.alias("depth"), F.array_join(F.slice("parts", 1, size), "/").alias("path")).distinct()
    above = arrays.select("*", F.explode(F.sequence(F.lit(1), "depth")).alias("level")).withColumn("folder", F.call_function("substring_index", F.col("path"), F.lit("/"), F.col("level")))
    met = above.join(ranked, [key, "level", "folder"]).groupBy(key, "depth", "path").agg(F.array_sort(F.collect_list(F.struct("level", "place"))).alias("p"))
    reached = met.where(F.size("p") == F.col("depth")).select(key, F.struct("depth", F.col("p.place").alias("places"), "path").alias("first"))
    return reached.groupBy(key).agg(F.min("first").alias("first")).select(key, "first.path", "first.depth")


def validated(found: DataFrame, folder: str, key: str) -> DataFrame:
    """(folder, kind, n, ambiguous, first): datasets of each kind in a folder; more than one of a kind leaves open which is meant."""
    many = F.count(F.lit(1))
    return found.groupBy(folder, "kind").agg(many.alias("n"), (many > 1).alias("ambiguous"), F.min(key).alias("first"))
