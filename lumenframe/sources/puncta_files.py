"""Choice of punctum files for an image, and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.relational import ranked

# ---------------------------------------------------------------- fixed values
# File name rules (extension first; names already filtered are rejected).
EXTENSION = ".nimp"
ACCEPTED = ["_detected_puncta.nimp", "_detected_soma_puncta.nimp", "_puncta.nimp", "_soma_puncta.nimp"]
ACCEPTED_WORD = "assign"
REJECTED = ["_filtered_puncta.nimp", "_filtered_soma_puncta.nimp", "puncta_filtered_puncta",
            "detected_soma_puncta_filtered_soma_puncta"]
# Column titles of the exported punctum table.
INFO_TITLES = ["puncta #", "score", "punctum x", "punctum y", "punctum z", "radius", "volume", "mass",
               "mean intensity", "max intensity", "intensity SD"]
# -----------------------------------------------------------------------------


def accepted(name: Column) -> Column:
    low = F.lower(name)
    rejected = F.lit(False)
    for part in REJECTED:
        rejected = rejected | low.contains(part)
    known = low.contains(ACCEPTED_WORD)
    for end in ACCEPTED:
        known = known | name.endswith(end)
    return name.endswith(EXTENSION) & ~rejected & known


def choose_files(names: DataFrame, folder: str = "folder") -> DataFrame:
    """Accepted files of each image: those naming its stem, else all accepted ones.

    ``names`` (folder, image, name). A folder listing is metadata; the match
    flag is an aggregate joined back, so no folder is sorted in one task.
    """
    usable = names.filter(accepted(F.col("name"))).withColumn(
        "_match", F.col("name").contains(F.regexp_replace("image", r"\.[^.]*$", "")))
    best = usable.groupBy(folder, "image").agg(F.max("_match").alias("_any"))
    return (usable.join(best, [folder, "image"]).filter(F.col("_match") | ~F.col("_any"))
            .drop("_match", "_any"))


def frame_order(names: DataFrame, folder: str = "folder") -> DataFrame:
    """Add z: position of a file in its folder by name. A folder may have any number of files."""
    return ranked(names, [folder], ["name"], "z")


def puncta_info(puncta: DataFrame, legacy: bool = False) -> DataFrame:
    """The 11 export columns; numbering follows ``punctum_id`` (list position).

    ``legacy`` writes y in the z column, as older exports did.
    """
    source = [F.col("punctum_id") + 1, "score", "x", "y", "y" if legacy else "z", "radius", "vol_size", "mass",
              "mean_intensity", "max_intensity", "sd_intensity"]
    return puncta.select(*[(F.col(c) if isinstance(c, str) else c).alias(t) for c, t in zip(source, INFO_TITLES)])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_label(predictions: DataFrame, puncta: DataFrame, path: str) -> None:
    """Puncta as Parquet, one folder per predicted label.

    Without a repartition every task writes its own share of each label, so a
    label holding most of the rows is written by all tasks.
    """
    (puncta.join(predictions.select("punctum_id", "final_prediction"), "punctum_id")
     .write.mode("overwrite").partitionBy("final_prediction").parquet(path))


def write_scenes(image: DataFrame, path: str) -> None:
    """Corrected voxels as Parquet, one folder per scene and channel."""
    image.write.mode("overwrite").partitionBy("scene", "c").parquet(path)
