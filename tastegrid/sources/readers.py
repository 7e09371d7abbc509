"""Readers of rating files and the usual data sets' layouts, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.interactions import Interactions, encode_labels


def delimited(spark: SparkSession, path: str, columns: str, sep: str = "\t", header: bool = False, encoding: str = "UTF-8", quote: str = '"', keep: list[str] | None = None) -> DataFrame:
    """A delimited file with a schema; a quote inside a quoted field is doubled; empty fields stay empty strings; only `keep` is read on."""
    df = spark.read.csv(path, schema=columns, sep=sep, header=header, encoding=encoding, quote=quote, escape=quote, nullValue="\x00", emptyValue="")
    return df.select(*keep) if keep else df


def matrix_market(spark: SparkSession, path: str, one_based: bool = True) -> Interactions:
    """A coordinate MatrixMarket file; the size line gives the shape, the banner the symmetry."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    # Comments and the size line lie in the file's first block, where lines are numbered in order.
    banner = (lines.where((F.col("block") == 0) & F.col("value").startswith("%%")).select("value").first() or [""])[0].lower().split()
    if "array" in banner or "complex" in banner or "hermitian" in banner:
        raise ValueError("only real, integer and pattern coordinate files are read")
    lines = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    top = lines.where("block = 0").orderBy("line").first()
    if top is None:
        raise ValueError("the file has no size line")
    size = top["value"].split()
    cut = F.split(F.trim("value"), r"\s+")
    shift = 1 if one_based else 0
    rows = lines.where((F.col("block") > 0) | (F.col("line") > top["line"])).select(
        (F.get(cut, 0).cast("long") - shift).alias("user_id"),
        (F.get(cut, 1).cast("long") - shift).alias("item_id"),
        F.coalesce(F.get(cut, 2).cast("double"), F.lit(1.0)).alias("weight"),
    )
    kind = banner[-1] if banner else "general"
    if kind in ("symmetric", "skew-symmetric"):
        # One triangle is stored.
        sign = F.lit(-1.0 if kind == "skew-symmetric" else 1.0)
        there = F.struct("user_id", "item_id", "weight")
        back = F.struct(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"), (sign * F.col("weight")).alias("weight"))
        both = F.when(F.col("user_id") == F.col("item_id"), F.array(there)).otherwise(F.array(there, back))
        rows = rows.select(F.inline(both))
    return Interactions.of(rows, n_users=int(size[0]), n_items=int(size[1]))


def from_labels(df: DataFrame, user: str, item: str, weight: str | None) -> tuple[DataFrame, DataFrame, Interactions]:
    """Dictionaries of users (label, user_id) and items (label, item_id), and the summed interactions of their codes."""
    users, items = encode_labels(df, user, "user_id"), encode_labels(df, item, "item_id")
    coded = df.join(users, user).join(items, item)
    return users.withColumnRenamed(user, "label"), items.withColumnRenamed(item, "label"), Interactions.of(coded, weight=weight)


def lastfm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, Interactions]:
    """Plays in a tab-separated file of user, artist id, artist, plays."""
    df = delimited(spark, path, "user string, artist_id string, artist string, plays double", keep=["user", "artist", "plays"])
    return from_labels(df, "user", "artist", "plays")


#: How the MovieLens variants' ratings are laid out: separator, header, encoding.
MOVIELENS = {"20m": (",", True, "UTF-8"), "10m": ("::", False, "UTF-8"), "1m": ("::", False, "ISO-8859-1"), "100k": ("\t", False, "ISO-8859-1")}


def movielens(spark: SparkSession, path: str, variant: str = "20m") -> Interactions:
    """Ratings by user and movie."""
    if variant not in MOVIELENS:
        raise ValueError(f"no variant {variant!r}")
    sep, header, encoding = MOVIELENS[variant]
    df = delimited(spark, path, "user_id long, item_id long, weight double, timestamp long", sep, header, encoding, keep=["user_id", "item_id", "weight"])
    return Interactions.of(df)


#: How the variants' titles are laid out: separator, header, encoding.
MOVIELENS_TITLES = {"20m": (",", True, "UTF-8"), "10m": ("::", False, "UTF-8"), "1m": ("::", False, "ISO-8859-1"), "100k": ("|", False, "ISO-8859-1")}


def movielens_titles(spark: SparkSession, path: str, variant: str = "20m") -> DataFrame:
    """item_id and title from a variant's file of movies."""
    if variant not in MOVIELENS_TITLES:
        raise ValueError(f"no variant {variant!r}")
    sep, header, encoding = MOVIELENS_TITLES[variant]
    return delimited(spark, path, "item_id long, title string, more string", sep, header, encoding, keep=["item_id", "title"])


def dataset(spark: SparkSession, path: str, items: DataFrame, users: DataFrame | None, x: Interactions) -> None:
    """Write a data set read once from its raw files, so that it need not be parsed and coded again: items, users, interactions and the shape."""
    items.write.mode("overwrite").parquet(f"{path}/items")
    if users is not None:
        users.write.mode("overwrite").parquet(f"{path}/users")
    x.df.write.mode("overwrite").parquet(f"{path}/interactions")
    spark.createDataFrame([(x.n_users, x.n_items)], "n_users long, n_items long").write.mode("overwrite").parquet(f"{path}/shape")


def stored_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, Interactions]:
    """Items and interactions of a data set that `dataset` has written."""
    n_users, n_items = spark.read.parquet(f"{path}/shape").first()
    return spark.read.parquet(f"{path}/items"), Interactions.of(spark.read.parquet(f"{path}/interactions"), n_users=n_users, n_items=n_items)


def taste_profile(spark: SparkSession, plays: str, tracks: str) -> tuple[DataFrame, DataFrame, Interactions]:
    """Plays by user and track, with track metadata joined to the track dictionary."""
    df = delimited(spark, plays, "user string, track string, plays double")
    users, items, x = from_labels(df, "user", "track", "plays")
    info = delimited(spark, tracks, "track string, artist string, album string, song string").dropDuplicates(["track"])
    return users, items.join(info, items["label"] == info["track"], "left").drop("track"), x


def reddit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, Interactions]:
    """Votes; a vote against is a negative weight."""
    df = delimited(spark, path, "user string, item string, subreddit string, vote double", ",", keep=["user", "item", "vote"])
    return from_labels(df, "user", "item", "vote")


def sketchfab(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, Interactions]:
    """Likes in a file separated by bars, with a header and backslash quotes."""
    df = spark.read.csv(path, sep="|", header=True, quote="\\")
    return from_labels(df, "uid", "mid", None)


def write_results(results: DataFrame, path: str, left: str, right: str, left_labels: DataFrame, right_labels: DataFrame, popularity: DataFrame | None = None) -> None:
    """Results as tab-separated label, label, score; the most popular left ids first where popularity (id, n) is given.

    left_labels, right_labels: label and the code column.
    """
    a = left_labels.select(F.col(left), F.col("label").alias("left_label"))
    code = [c for c in right_labels.columns if c != "label"][0]
    b = right_labels.select(F.col(code).alias(right), F.col("label").alias("right_label"))
    out = results.join(a, left).join(b, right)
    if popularity is not None:
        out = out.join(popularity.select(F.col("id").alias(left), "n"), left, "left").orderBy(F.col("n").desc_nulls_last(), left, "rank")
    out.select("left_label", "right_label", F.col("score").cast("string")).write.csv(path, sep="\t")
