"""The same or nearly the same places on both sides of a train/evaluation split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshwright.operators.proximity import is_location, near_pairs

#: Canonical spellings of the split names.
SPLIT_NAMES = {
    "train": ["train", "training", "trn", "tr"],
    "val": ["val", "valid", "validation", "dev"],
    "test": ["test", "testing", "tst", "eval"],
}


def canonical(text: Column) -> Column:
    """Lower case, punctuation to spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}]+", " "), r"[\s\p{Z}]+", " "))


def canonical_split(split: Column) -> Column:
    """``train``, ``val`` or ``test`` for any spelling; null for anything else."""
    name = canonical(split)
    out = F.lit(None).cast("string")
    for split_name, spellings in SPLIT_NAMES.items():
        out = F.when(name.isin(spellings), F.lit(split_name)).otherwise(out)
    return out


def place_hash(lat: Column, lng: Column) -> Column:
    """Hash of a canonicalised place: the same for both signs of zero and of the date line."""
    even = lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c)
    east = F.when(lng == -180, F.lit(180.0)).otherwise(lng)
    # punctuation would take signs and points away, so they are named first
    text = F.translate(F.concat_ws(" ", even(lat).cast("string"), even(east).cast("string")), "-.", "np")
    return F.xxhash64(canonical(text))


def _sides(sites: DataFrame, key: str, lat: str, lng: str, split: str, source: str) -> tuple[DataFrame, DataFrame]:
    records = (
        sites.select(
            F.col(key).cast("long").alias("key"),
            F.col(lat).cast("double").alias("lat"),
            F.col(lng).cast("double").alias("lng"),
            canonical_split(F.col(split)).alias("split"),
            F.coalesce(canonical(F.col(source)), F.lit("")).alias("source"),
        )
        .filter("key is not null and split is not null")
        .distinct()
    )
    return records.filter("split = 'train'"), records.filter("split <> 'train'")


def cross_split_pairs(
    sites: DataFrame, key: str, lat: str, lng: str, split: str, source: str, metres: float = 75.0
) -> DataFrame:
    """``(train_key, eval_key, eval_split, train_source, eval_source, exact)``, no row twice.

    Exact overlaps: each record's place is canonicalised (its text form, case, punctuation and white
    space evened out as in names) and hashed; evaluation hashes are joined with training hashes.
    Near ones: distinct places of both sides meet through grid cells of the radius and the
    distance decides. Both give pairs of places, which are then given back to their records.
    ``exact`` tells equal coordinates from moved ones. Rows with a null key, an unknown or null
    split, or a place that is none (null, NaN, out of range, (0, 0)) match nothing. Repeated rows
    count once; a missing source is the empty text.
    """
    train, held = _sides(sites, key, lat, lng, split, source)
    train, held = (df.filter(is_location(F.col("lat"), F.col("lng"))).withColumn("h", place_hash(F.col("lat"), F.col("lng"))) for df in (train, held))
    of_train, of_held = (df.select("h", "lat", "lng").distinct() for df in (train, held))
    named = lambda df, tag: df.select("lat", "lng", F.col("h").alias(f"{tag}h"), F.col("lat").alias(f"{tag}lat"), F.col("lng").alias(f"{tag}lng"))
    a, b = named(of_train, "t").drop("lat", "lng"), named(of_held, "e").drop("lat", "lng")
    same = (F.col("tlat") == F.col("elat")) & (F.col("tlng") == F.col("elng"))
    exact = a.join(b, F.col("th") == F.col("eh")).filter(same).withColumn("exact", F.lit(True))
    near = near_pairs(named(of_train, "t"), named(of_held, "e"), metres).filter(~same).withColumn("exact", F.lit(False)).drop("metres")
    met = exact.unionByName(near).select("tlat", "tlng", "elat", "elng", "exact")
    own = lambda df, tag, *cols: df.select(*[F.col(c).alias(n) for c, n in cols], F.col("lat").alias(f"{tag}lat"), F.col("lng").alias(f"{tag}lng"))
    pairs = met.join(own(train, "t", ("key", "train_key"), ("source", "train_source")), ["tlat", "tlng"])
    pairs = pairs.join(own(held, "e", ("key", "eval_key"), ("split", "eval_split"), ("source", "eval_source")), ["elat", "elng"])
    return pairs.filter("train_key <> eval_key").select("train_key", "eval_key", "eval_split", "train_source", "eval_source", "exact").distinct()


def overlap_report(sites: DataFrame, key: str, lat: str, lng: str, split: str, source: str, metres: float = 75.0) -> DataFrame:
    """Per evaluation split and source: records matched in train, exactly or nearly, and pairs."""
    pairs = cross_split_pairs(sites, key, lat, lng, split, source, metres)
    per_record = pairs.groupBy("eval_key", "eval_split", "eval_source").agg(
        F.max("exact").alias("exact"), F.count(F.lit(1)).alias("pairs")
    )
    return per_record.groupBy("eval_split", "eval_source").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.col("exact").cast("long")).alias("exact_records"),
        F.sum("pairs").alias("pairs"),
    )
