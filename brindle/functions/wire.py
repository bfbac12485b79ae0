"""Requests, identifiers and number forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

MAX_BODY = 1 << 20


def limited(body: Column, most: int = MAX_BODY) -> Column:
    """A body of at most `most` bytes, else null: a longer one is an error, not a prefix."""
    return F.when(F.octet_length(body) <= most, body)


def request_problem(body: Column, content_type: Column, most: int = MAX_BODY, required: bool = False, members: tuple[str, ...] = ()) -> Column:
    """status and code of what is wrong with a JSON request; null if nothing.  members: the only ones that an object may have (none given: any)."""
    kind = trimmed(F.coalesce(content_type, F.lit("")))
    media = F.lower(trimmed(F.substring_index(kind, ";", 1)))
    bad = lambda status, code: F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"))
    blank = F.coalesce(body, F.lit("")).rlike(r"^[ \n\r\t]*\z")
    # as the member of an array that has no other: what stands behind the first value shows
    single = F.coalesce(F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1, F.lit(False))
    unknown = F.size(F.array_except(F.json_object_keys(body), F.array(*[F.lit(m) for m in members]))) > 0 if members else F.lit(False)
    return (
        F.when(body.isNull(), bad(400, "invalid_request")).when((media != "application/json") & ((kind != "") | F.lit(required)), bad(415, "unsupported_media_type")).when(F.octet_length(body) > most, bad(413, "request_entity_too_large"))
        .when(blank, bad(400, "invalid_request")).when(F.try_parse_json(body).isNull() | ~single, bad(400, "invalid_json")).when(F.coalesce(unknown, F.lit(False)), bad(400, "invalid_json"))
    )


def reissue_id(base: Column, generation: Column, most: int) -> Column:
    """The id under which a request goes out again: the base itself, then base:r1 up to base:r<most>; null beyond."""
    return F.when(generation == 0, base).when(generation.between(1, most), F.concat(base, F.lit(":r"), generation.cast("string")))


def generation_of(base: Column, stored: Column, most: int) -> Column:
    """The generation that has the stored id; null if none up to `most` has."""
    every = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda g: reissue_id(base, g, most))
    return F.nullif(F.array_position(every, stored), F.lit(0)) - 1


def open_chat(room_type: Column, link: Column) -> Column:
    """Whether a room has a link or a type that begins with O."""
    return (trimmed(F.coalesce(link, F.lit(""))) != "") | F.startswith(F.upper(trimmed(F.coalesce(room_type, F.lit("")))), F.lit("O"))


def escape_date_lists(c: Column) -> Column:
    """A backslash before the first stop of lines that begin with a date as in `2024. 5.`, which would be a list."""
    return F.regexp_replace(c, r"(?dm)^([ \t]{0,3}[0-9]{4})(?=\.[ \t]+[0-9]{1,2}\.)", r"$1\\")


def float_text(c: Column) -> Column:
    """A number in its shortest form: an exponent of two digits or more below 1e-4 and from 1e6 on, no point after whole numbers."""
    s = F.abs(c).cast("string")
    mantissa, power = F.substring_index(s, "E", 1), F.coalesce(F.when(F.contains(s, F.lit("E")), F.substring_index(s, "E", -1)).cast("int"), F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise("")
    every = F.concat(whole, part)
    lead = F.length(every) - F.length(F.ltrim(every, F.lit("0")))
    digits = F.rtrim(F.ltrim(every, F.lit("0")), F.lit("0"))
    # the number is 0.digits times ten to the point
    point = F.length(whole) + power - lead
    x = point - 1
    shown = F.when(F.length(digits) > 1, F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))).otherwise(digits)
    scientific = F.concat(shown, F.when(x < 0, "e-").otherwise("e+"), F.lpad(F.abs(x).cast("string"), F.greatest(F.length(F.abs(x).cast("string")), F.lit(2)), F.lit("0")))
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)).cast("int"))
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits)).when(point >= F.length(digits), F.concat(digits, zeros(point - F.length(digits))))
        .otherwise(F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1)))
    )
    text = F.when((x < -4) | (x >= 6), scientific).otherwise(plain)
    number = F.when(digits == "", "0").otherwise(text)
    return F.when(F.isnan(c), "NaN").when(s == "Infinity", F.when(c < 0, "-Inf").otherwise("+Inf")).otherwise(F.concat(F.when(c < 0, "-").otherwise(""), number))


def duration_text(seconds: Column) -> Column:
    """Whole seconds as hours, minutes and seconds: 1h2m3s, 2m0s, 3s."""
    s = F.abs(seconds)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    part = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(unit))
    text = F.concat(F.when(h > 0, part(h, "h")).otherwise(""), F.when((h > 0) | (m > 0), part(m, "m")).otherwise(""), part(s % 60, "s"))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), text)
