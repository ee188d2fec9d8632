"""Records of a listing as JSON, of which only named fields are read.

Personal fields can't be named: a list that holds one is refused before anything
is read, and as the parser is given a schema of the kept fields alone, others
never leave the text.

Defined results: a field that a record lacks is null; text that is no record has
all fields null; times are seconds since 1970 in UTC, 0 or null is null; a version
that is blank or a placeholder is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.views import duck, view
from tidemark.sources.files import ContractError

QUERIES, ORACLES = {}, {}
#: Fields that tell who wrote a record.
PERSONAL = ("user_id", "user_name", "user_image", "email", "phone")
PLACEHOLDERS = ("", "0")


def parse_records(raw: DataFrame, keep: dict[str, str], text_col: str = "record", personal: tuple[str, ...] = PERSONAL, at: str = "at", version: str = "version", placeholders: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """The kept fields (name and type) of records; `at` is stored as seconds and becomes a time, `version` is null where it is a placeholder."""
    if refused := sorted({name for name in keep if name.casefold().replace("-", "_") in personal}):
        raise ContractError(f"personal fields must not be kept: {', '.join(refused)}")
    schema = ", ".join(f"`{name}` {'double' if name == at else kind}" for name, kind in keep.items())
    found = raw.select(F.from_json(F.col(text_col), schema).alias("r"))

    def field(name: str) -> Column:
        own = F.col(f"r.`{name}`")
        if name == at:
            seconds = F.when(own != 0, own)
            return F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")).alias(name)
        if name == version:
            plain = F.trim(own)
            return F.when(~plain.isin(*placeholders), plain).alias(name)
        return own.alias(name)

    return found.select(*[field(name) for name in keep])


def parse_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews, made records of a listing with their writers, and parsed without them."""
    rows = view(spark, sf_dir, "reviews")
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1_000_000
    names = F.concat(F.lit("writer "), F.col("user_id").cast("string")).alias("user_name")
    raw = rows.select(F.to_json(F.struct("review_id", F.col("text_clean").alias("content"), "score", seconds.alias("at"), F.coalesce("version", F.lit(" 0 ")).alias("version"), "user_id", names)).alias("record"))
    found = parse_records(raw, {"review_id": "long", "content": "string", "score": "int", "at": "timestamp", "version": "string"})
    return found.select("review_id", "content", "score", F.unix_micros("at").alias("at_us"), "version")


QUERIES["parse_listing"] = parse_listing
ORACLES["parse_listing"] = duck("SELECT review_id, text_clean AS content, score, epoch_us(ts) AS at_us, version FROM {reviews}")
