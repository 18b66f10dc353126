"""Weighbridge ticket fields: cleaners, material maps and stable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbflow.functions.ids import NO_VALUE

# Materials as scales and field forms write them.
SCALE_MATERIALS = {"RECYCLING": "RECYCLING", "REFUSE": "REFUSE", "COLLECTIONS ORGANICS": "ORGANIC"}
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy")
BETWEEN = "||"


def fleet_id(raw: Column) -> Column:
    """Fleet number as text: no commas, nothing from the first dot on; null for texts that mean no value."""
    text = F.trim(F.regexp_replace(F.trim(F.replace(raw.cast("string"), F.lit(","), F.lit(""))), r"\..*$", ""))
    return F.when(~F.upper(text).isin(*NO_VALUE), text)


def moment(raw: Column) -> Column:
    """Wall-clock time of a text in one of DATE_FORMATS, null if none fits."""
    text = F.trim(raw.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(F.when(text.rlike(_SHAPES[f]), text), F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS])


_SHAPES = {
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01]) ([01]\d|2[0-3]):[0-5]\d:[0-5]\d$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d$",
    "yyyy-MM-dd": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "M/d/yyyy H:mm:ss": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$",
    "M/d/yyyy H:mm": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
}


def number(raw: Column) -> Column:
    return F.trim(raw.cast("string")).try_cast("double")


def material_scale(raw: Column) -> Column:
    """Material class of a scale ticket; OTHER if it is unknown or missing."""
    table = F.create_map(*[F.lit(x) for pair in SCALE_MATERIALS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(raw))), F.lit("OTHER"))


def material_field(raw: Column) -> Column:
    """Material class of a field ticket: whatever is neither refuse nor a tree is organic, a missing one too."""
    text = F.upper(F.trim(raw))
    return F.when(text == "REFUSE", "REFUSE").when(text == "CHRISTMAS TREES", "OTHER").otherwise("ORGANIC")


def is_demo(raw: Column) -> Column:
    return F.coalesce(F.upper(F.trim(raw)) == "DEMO", F.lit(False))


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | F.coalesce(text.startswith(prefix), F.lit(False))
    return found


def normal_text(raw: Column) -> Column:
    """Upper case, blanks collapsed, no-break spaces too; null as the empty text."""
    text = F.replace(F.upper(F.coalesce(raw.cast("string"), F.lit(""))), F.lit(" "), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")


def minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def minute_text(ts: Column) -> Column:
    """Minute of a wall-clock time as text, always with its time of day; null as the empty text."""
    return F.coalesce(F.date_format(minute(ts), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def tons_text(tons: Column) -> Column:
    """Tons to three places, halves to even; null as the empty text."""
    return F.coalesce(F.bround(tons, 3).cast("string"), F.lit(""))


def hash_key(*parts: Column) -> Column:
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit(BETWEEN), part)
    return F.sha1(joined.cast("binary"))


def key_scale(event: Column, fleet: Column, route: Column, load: Column, dump: Column, material: Column, tons: Column) -> Column:
    return hash_key(minute_text(event), *map(normal_text, (fleet, route, load, dump, material)), tons_text(tons))


def key_field(event: Column, fleet: Column, landfill: Column, material: Column, tons: Column, transaction: Column | None = None) -> Column:
    extra = [] if transaction is None else [normal_text(transaction)]
    return hash_key(minute_text(event), *map(normal_text, (fleet, landfill, material)), tons_text(tons), *extra)


def source_of(file_name: Column) -> Column:
    name = F.upper(file_name)
    return F.when(name.startswith("SCALE"), "SCALE").when(name.startswith("FIELD"), "FIELD")


def file_date(file_name: Column) -> Column:
    """Date of a name that ends in _MMDDYY before its suffix; null if it has none or no such day exists."""
    part = F.nullif(F.regexp_extract(file_name, r"_(\d{6})(?:\.\w+)?$", 1), F.lit(""))
    year = F.substring(part, 5, 2).cast("int")
    century = F.when(year >= 69, F.lit("19")).otherwise(F.lit("20"))
    text = F.concat(century, F.substring(part, 5, 2), F.lit("-"), F.substring(part, 1, 2), F.lit("-"), F.substring(part, 3, 2))
    return text.try_cast("date")


def canonical_header(name: str) -> str:
    """Header in upper case with single spaces."""
    return " ".join(name.replace(" ", " ").split()).upper()


def resolve_column(columns: list[str], wanted: list[str]) -> str | None:
    """The first wanted header that is present, as it is written there."""
    own = {}
    for c in columns:
        own.setdefault(canonical_header(c), c)
    return next((own[canonical_header(w)] for w in wanted if canonical_header(w) in own), None)
