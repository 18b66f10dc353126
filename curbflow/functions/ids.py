"""Vehicle identifiers: parsing, fleet kinds and the filter for one's own fleet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fleet prefixes and their kinds, own prefixes, length of a prefix, texts that mean no value.
KINDS = {"100": "AUTO", "200": "AUTO", "300": "MANUAL", "400": "MANUAL"}
OUR_PREFIXES = ("100", "200")
PREFIX_LENGTH = 3
NO_VALUE = ("", "NA", "NAN", "NONE", "NULL", "<NA>")


def clean_id(raw: Column) -> Column:
    """Text without commas and blanks, cut at the first dot; null for texts that mean no value."""
    text = F.trim(F.replace(raw.cast("string"), F.lit(","), F.lit("")))
    text = F.trim(F.substring_index(text, ".", 1))
    return F.when(~F.upper(text).isin(*NO_VALUE), text)


def parse_vehicle(raw: Column) -> Column:
    """struct<raw, prefix, number, kind>, or null unless the text is digits, longer than a prefix."""
    text = clean_id(raw)
    good = text.rlike("^[0-9]+$") & (F.length(text) > PREFIX_LENGTH)
    prefix = F.substring(text, 1, PREFIX_LENGTH)
    number = F.substr(text, F.lit(PREFIX_LENGTH + 1))
    return F.when(good, F.struct(text.alias("raw"), prefix.alias("prefix"), number.alias("number"), fleet_kind(prefix).alias("kind")))


def fleet_kind(prefix: Column) -> Column:
    """Kind of a fleet prefix; OTHER if it is unknown."""
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, prefix), F.lit("OTHER"))


def is_our_fleet(raw: Column, prefixes: tuple[str, ...] = OUR_PREFIXES) -> Column:
    """Whether an identifier parses and has one of the prefixes; never null."""
    return F.coalesce(parse_vehicle(raw)["prefix"].isin(*prefixes), F.lit(False))
