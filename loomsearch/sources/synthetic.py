"""Product documents and queries made by rule, for benchmarks without a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ADJECTIVES = (
    "oak", "brass", "woollen", "enamelled", "hand-carved", "stackable", "fireproof", "quilted", "linen", "rustic",
    "polished", "insulated", "wall-mounted", "double-walled", "braided", "frosted", "galvanised", "cushioned", "hollow", "tempered",
)
NOUNS = (
    "kettle", "lantern", "wheelbarrow", "blanket", "teapot", "bookshelf", "ladder", "hammock", "mirror", "toolbox",
    "birdhouse", "saucepan", "doormat", "curtain", "workbench", "vase", "stool", "greenhouse", "thermos", "clock",
)
BRANDS = ("Harrowgate", "Linden & Co", "Millrace", "Fernhollow", "Quayside", "Bramblewick", "Stonefold", "Larkfield", "Tallow House", "Copperdale")
CATEGORIES = ("kitchen", "garden", "bedroom", "workshop", "lighting", "storage", "dining", "hallway", "bathroom", "balcony")
FEATURES = (
    "made from reclaimed timber", "dries within an hour", "three year guarantee", "fits most windows", "holds twelve litres", "comes flat-packed", "rust resistant",
    "washable at sixty degrees", "with a leather strap", "spare parts included", "stands on uneven ground", "suits narrow rooms", "sold in pairs", "dimmable", "assembled by hand",
)


def _pick(values: tuple[str, ...], factor: int, seed: int) -> Column:
    """The value for a row number; a prime factor for each field mixes them."""
    return F.element_at(F.array(*map(F.lit, values)), ((F.col("i") * factor + seed) % len(values) + 1).cast("int"))


def products(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n documents (id, title, description, brand, category, price, tags)."""
    rows = spark.range(n).withColumnRenamed("id", "i")
    fields = rows.select(
        "i",
        _pick(BRANDS, 7919, seed).alias("brand"),
        _pick(ADJECTIVES, 104729, seed).alias("adjective"),
        _pick(NOUNS, 1299709, seed).alias("noun"),
        _pick(CATEGORIES, 15485863, seed).alias("category"),
        ((F.lit(999) + (F.col("i") * 32452843 + seed) % 29001) / 100).alias("price"),
        F.array_distinct(F.array(_pick(FEATURES, 31, seed), _pick(FEATURES, 49979687, seed), _pick(FEATURES, 67867967, seed))).alias("features"),
    )
    text = F.format_string("%s %s %s. Category: %s. Features: %s. Price: $%.2f.", "brand", "adjective", "noun", "category", F.array_join("features", ", "), "price")
    return fields.select(F.col("i").cast("string").alias("id"), F.concat_ws(" ", "brand", "adjective", "noun").alias("title"), text.alias("description"), "brand", "category", "price", F.array("adjective", "noun", "category").alias("tags"))


def product_queries(spark: SparkSession, n: int, seed: int = 99) -> DataFrame:
    """n queries (qid, text) of three forms."""
    rows = spark.range(n).withColumnRenamed("id", "i")
    adjective, noun, feature = _pick(ADJECTIVES, 104729, seed), _pick(NOUNS, 1299709, seed), _pick(FEATURES, 49979687, seed)
    form = F.element_at(F.array(F.concat_ws(" ", adjective, noun), F.concat_ws(" ", noun, feature), F.concat_ws(" ", F.lit("best"), adjective, noun, feature)), (F.col("i") % 3 + 1).cast("int"))
    return rows.select(F.col("i").alias("qid"), form.alias("text"))
