"""Names and fixed values of the impression model."""

from __future__ import annotations

from pyspark.sql import types as T

NUMERIC = [f"i{n}" for n in range(1, 14)]
CATEGORICAL = [f"c{n}" for n in range(1, 27)]
UNKNOWN = "unknown"
#: Code, label, order, lower and upper bound of the numeric buckets.
BUCKETS = [
    ("negative", "negative values", 1, None, -1),
    ("zero", "0", 2, 0, 0),
    ("1_10", "1 to 10", 3, 1, 10),
    ("11_100", "11 to 100", 4, 11, 100),
    ("101_1000", "101 to 1000", 5, 101, 1000),
    ("1001_10000", "1001 to 10000", 6, 1001, 10000),
    ("10001_plus", "10001 and above", 7, 10001, None),
]
#: The categorical columns that the feature store carries, and those whose sparsity is checked.
STORED = ["c1", "c6", "c19", "c20", "c22", "c25", "c26"]
SPARSE = {"c22": (0.80, 0.90), "c19": (0.50, 0.65), "c20": (0.50, 0.65), "c25": (0.50, 0.65), "c26": (0.50, 0.65)}
SPLITS = ("train", "validation", "test")
#: Impressions from which a segment counts: of features and buckets, and of interactions.
SEGMENT_MIN, INTERACTION_MIN = 10_000, 5_000
HIGH, MEDIUM, MEDIUM_BUCKET = 10_000, 5_000, 1_000


def source_schema() -> T.StructType:
    """The 40 columns of a source file."""
    fields = [T.StructField("label", T.IntegerType())]
    fields += [T.StructField(c.upper(), T.IntegerType()) for c in NUMERIC]
    return T.StructType(fields + [T.StructField(c.upper(), T.StringType()) for c in CATEGORICAL])
