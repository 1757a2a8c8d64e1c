"""Ratings and survey files: delimited text with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.functions.scalars import (
    epoch_to_timestamp,
    first_flag,
    lenient_int,
    lookup,
    parse_day,
    title_year,
)
from rankweave.schema import (
    ITEM_ID,
    TS,
    USER_ID,
    VALUE,
    Applies,
    Dataset,
    FeatureKind,
    FeatureSpec,
)

# Genre flags in file order.
GENRES = (
    "unknown", "Action", "Adventure", "Animation", "Childrens",
    "Comedy", "Crime", "Documentary", "Drama", "Fantasy",
    "FilmNoir", "Horror", "Musical", "Mystery", "Romance",
    "SciFi", "Thriller", "War", "Western",
)

# Survey answer codes that name an option; all other codes are no choice.
OPTIONS = {
    1: "Likud",
    2: "YeshAtid",
    3: "NationalUnity",
    4: "ReligiousZionism",
    5: "Shas",
    6: "UnitedTorahJudaism",
    7: "YisraelBeiteinu",
    8: "HaDemocratim",
    9: "OtzmaYehudit",
    10: "NationalRight",
    11: "HadashTaal",
    12: "Raam",
    13: "Balad",
}

# Survey columns; the district column is renamed.
SURVEY_ID = "resp_id"
SURVEY_CHOICE = "v104"
SURVEY_DAY = "date"
SURVEY_FEATURES = {
    "agegroup": "agegroup",
    "gender": "gender",
    "educ": "educ",
    "religiosity": "religiosity",
    "sector": "sector",
    "District_CBS": "district",
}


def _schema(fields: Sequence[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


RATING_FIELDS = _schema(
    [("user", T.IntegerType()), ("item", T.IntegerType()), ("rating", T.IntegerType()), ("epoch", T.LongType())]
)
PERSON_FIELDS = _schema(
    [
        ("user", T.IntegerType()),
        ("age", T.IntegerType()),
        ("gender", T.StringType()),
        ("occupation", T.StringType()),
        ("zip_code", T.StringType()),
    ]
)
TITLE_FIELDS = _schema(
    [
        ("item", T.IntegerType()),
        ("title", T.StringType()),
        ("release_date", T.StringType()),
        ("video_release", T.StringType()),
        ("url", T.StringType()),
        *[(f"genre_{g}", T.IntegerType()) for g in GENRES],
    ]
)


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``user, item, rating, epoch seconds`` without header."""
    raw = spark.read.schema(RATING_FIELDS).csv(path, sep="\t")
    return raw.select(
        F.col("user").cast("string").alias(USER_ID),
        F.col("item").cast("string").alias(ITEM_ID),
        F.col("rating").cast("double").alias(VALUE),
        epoch_to_timestamp(F.col("epoch")).alias(TS),
    )


def people(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated ``user, age, gender, occupation, zip code``."""
    raw = spark.read.schema(PERSON_FIELDS).csv(path, sep="|")
    return raw.select(
        F.col("user").cast("string").alias(USER_ID),
        F.col("age").cast("double").alias("age"),
        "gender",
        "occupation",
    )


def titles(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated Latin-1 titles with one flag column per genre.

    ``year`` comes from the title, ``primary_genre`` is the first genre whose flag is set.
    """
    raw = spark.read.schema(TITLE_FIELDS).csv(path, sep="|", encoding="ISO-8859-1")
    flags = {g: F.col(f"genre_{g}") for g in GENRES}
    return raw.select(
        F.col("item").cast("string").alias(ITEM_ID),
        "title",
        first_flag(flags).alias("primary_genre"),
        *[flag.cast("double").alias(f"genre_{g}") for g, flag in flags.items()],
        title_year(F.col("title")).alias("year"),
    )


def movies(spark: SparkSession, ratings_path: str, people_path: str, titles_path: str) -> Dataset:
    specs = [
        FeatureSpec("age", FeatureKind.NUMERIC, Applies.USER),
        FeatureSpec("gender", FeatureKind.CATEGORICAL, Applies.USER),
        FeatureSpec("occupation", FeatureKind.CATEGORICAL, Applies.USER),
        FeatureSpec("year", FeatureKind.NUMERIC, Applies.ITEM),
        FeatureSpec("primary_genre", FeatureKind.CATEGORICAL, Applies.ITEM),
        *[FeatureSpec(f"genre_{g}", FeatureKind.NUMERIC, Applies.ITEM) for g in GENRES],
    ]
    return Dataset(
        "movies",
        ratings(spark, ratings_path),
        people(spark, people_path),
        titles(spark, titles_path),
        tuple(specs),
    )


def survey(spark: SparkSession, path: str) -> DataFrame:
    """Survey CSV with header; every column as text, blank as null, byte order mark tolerated.

    Nothing is inferred: that would read the file twice.  Casts happen where a column is used.
    """
    raw = spark.read.csv(path, header=True, nullValue="")
    first = raw.columns[0].lstrip("﻿")
    return raw.toDF(first, *raw.columns[1:])


def survey_choices(raw: DataFrame) -> DataFrame:
    """One interaction per respondent who named an option; other codes and blank ids drop out.

    A day that does not parse gives a null timestamp.
    """
    code = lenient_int(F.col(SURVEY_CHOICE))
    respondent = F.trim(F.col(SURVEY_ID).cast("string"))
    return raw.filter(code.isin(list(OPTIONS)) & (F.length(respondent) > 0)).select(
        respondent.alias(USER_ID),
        lookup(code, OPTIONS).alias(ITEM_ID),
        F.lit(1.0).alias(VALUE),
        parse_day(F.trim(F.col(SURVEY_DAY))).alias(TS),
    )


def survey_people(raw: DataFrame) -> DataFrame:
    """Coded answers as text: the codes have no known order.  Ids are trimmed, blank ones drop out."""
    respondent = F.trim(F.col(SURVEY_ID).cast("string"))
    return raw.filter(F.length(respondent) > 0).select(
        respondent.alias(USER_ID),
        *[F.col(c).cast("string").alias(name) for c, name in SURVEY_FEATURES.items()],
    )


def elections(spark: SparkSession, path: str) -> Dataset:
    raw = survey(spark, path)
    items = spark.createDataFrame([(n,) for n in OPTIONS.values()], f"{ITEM_ID} string")
    specs = tuple(
        FeatureSpec(n, FeatureKind.CATEGORICAL, Applies.USER) for n in SURVEY_FEATURES.values()
    )
    return Dataset("elections", survey_choices(raw), survey_people(raw), items, specs)


def rating_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Text lines to ``(interactions, rejects)``.

    A line has to have exactly four tab-separated fields with numbers in the last two; rejects keep the
    line and its number of fields.
    """
    fields = F.split(F.col(column), "\t")
    parsed = lines.select(
        F.col(column).alias("line"),
        F.size(fields).alias("fields"),
        F.get(fields, 0).alias(USER_ID),
        F.get(fields, 1).alias(ITEM_ID),
        F.get(fields, 2).try_cast("double").alias(VALUE),
        epoch_to_timestamp(F.get(fields, 3).try_cast("long")).alias(TS),
    )
    good = (F.col("fields") == 4) & F.col(VALUE).isNotNull() & F.col(TS).isNotNull()
    return (
        parsed.filter(good).select(USER_ID, ITEM_ID, VALUE, TS),
        parsed.filter(~good).select("line", "fields"),
    )
