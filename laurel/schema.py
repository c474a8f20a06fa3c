"""Fixed source schemas and domain constants."""

from __future__ import annotations

from pyspark.sql import types as T

NOMINATIONS = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("period", T.IntegerType()),
        T.StructField("work", T.StringType()),
        T.StructField("person", T.StringType()),
        T.StructField("won", T.IntegerType()),
    ]
)
RATINGS = T.StructType(
    [
        T.StructField("work", T.StringType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("season_start", T.IntegerType()),
        T.StructField("num_eps", T.IntegerType()),
        T.StructField("av_rating", T.DoubleType()),
        T.StructField("av_num_votes", T.DoubleType()),
    ]
)
EXTERNAL_WINNERS = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("period", T.IntegerType()),
        T.StructField("winner", T.StringType()),
    ]
)
PENDING = T.StructType(NOMINATIONS.fields[:4])

CONTEST = ["category", "period"]

# Defaults the analysis uses where a measure is missing.
DEFAULT_WIN_RATE = 0.2
DEFAULT_RATING = 7.9
POSITION_CAP = 5
BASE_LOGIT = -1.38
