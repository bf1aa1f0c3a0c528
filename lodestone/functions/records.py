"""Column functions over JSON that isn't quite JSON, schedules, tiers and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields that a description has at least.
DESCRIPTION = "struct<image_type:string,caption:string,tags:array<string>,art_style:string,color_palette:string>"
# What missing fields are.
MINIMUM = {"image_type": "other", "caption": "", "art_style": "other", "color_palette": "neutral"}
CAPTION = 500


def array_or_empty(col: Column) -> Column:
    """A JSON text's array of strings; empty if it isn't one."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))


def map_or_empty(col: Column) -> Column:
    return F.coalesce(F.from_json(col, "map<string,string>"), F.create_map().cast("map<string,string>"))


def allowed(col: Column, keys: list[str]) -> Column:
    """The entries of a map under these keys that aren't null."""
    return F.map_filter(col, lambda k, v: k.isin(*keys) & v.isNotNull())


def _let(value: Column, use) -> Column:
    """use(value), with the value made once for each row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repaired(raw: Column) -> Column:
    """Without code fences and trailing commas, keys in double quotes, brackets closed (braces first)."""

    def bare(text: Column) -> Column:
        fenced = F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", "")
        return F.regexp_replace(F.when(F.startswith(text, F.lit("```")), fenced).otherwise(text), r",\s*([}\]])", "$1")

    count = lambda text, mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    lack = lambda text, a, b: F.greatest(F.lit(0), count(text, a) - count(text, b))
    closed = lambda text: F.concat(text, F.repeat(F.lit("}"), lack(text, "{", "}")), F.repeat(F.lit("]"), lack(text, "[", "]")))
    return F.regexp_replace(_let(_let(F.trim(raw), bare), closed), r"'(\w+)'\s*:", '"$1":')


def description(raw: Column) -> Column:
    """A description struct from a model's answer, never null: as JSON, else repaired, else field by field.

    An object counts if it has a caption or an image type. What is then missing has its MINIMUM value; a caption that
    isn't to be found is the answer's text without JSON marks, CAPTION characters of it.
    """
    usable = lambda x: F.when(x["caption"].isNotNull() | x["image_type"].isNotNull(), x)
    parsed = lambda text: _let(F.from_json(text, DESCRIPTION), usable)
    text = lambda k: F.nullif(F.regexp_extract(raw, rf'"{k}"\s*:\s*"([^"]*)"', 1), F.lit(""))
    tags = F.regexp_extract_all(F.regexp_extract(raw, r'"tags"\s*:\s*\[([^\]]*)\]', 1), F.lit(r'"([^"]*)"'), F.lit(1))
    plain = F.substring(F.trim(F.regexp_replace(F.regexp_replace(raw, r'[{}\[\]":]', " "), r"\s+", " ")), 1, CAPTION)
    found = F.struct(text("image_type").alias("image_type"), F.coalesce(text("caption"), plain).alias("caption"), tags.alias("tags"), text("art_style").alias("art_style"), text("color_palette").alias("color_palette"))

    def filled(x: Column) -> Column:
        fields = [F.coalesce(x[k], F.lit(v)).alias(k) for k, v in MINIMUM.items()]
        return F.struct(*fields, F.coalesce(x["tags"], F.array().cast("array<string>")).alias("tags"))

    return _let(F.coalesce(parsed(F.trim(raw)), parsed(repaired(raw)), found), filled)


def active(now: Column, hours: Column, days: Column, zone: str | None = None) -> Column:
    """Whether now (UTC) lies in the hours `HH:MM-HH:MM` (both ends in; overnight if the first is later) and the days
    (1 for Monday to 7). Null, empty or malformed hours and null or empty days let all pass."""
    local = now if zone is None else F.from_utc_timestamp(now, zone)
    span = r"^\s*(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})\s*$"
    part = lambda i: F.nullif(F.regexp_extract(hours, span, i), F.lit("")).cast("int")
    start, end = part(1) * 3600 + part(2) * 60, part(3) * 3600 + part(4) * 60
    valid = (part(1) < 24) & (part(3) < 24) & (part(2) < 60) & (part(4) < 60)
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    within = F.when(start <= end, (second >= start) & (second <= end)).otherwise((second >= start) | (second <= end))
    day = (F.size(F.coalesce(days, F.array().cast("array<int>"))) == 0) | F.array_contains(days, F.weekday(local) + 1)
    return F.coalesce(day, F.lit(True)) & F.when(F.coalesce(valid, F.lit(False)), within).otherwise(True)


# Tiers whose text vectors are of one model, by that model; all share the visual one.
TEXT_MODELS = {"standard": "small", "pro": "small", "ultra": "large"}


def tier_action(stored: Column, current: Column, stored_dim: Column, current_dim: Column) -> Column:
    """What moving a catalog to another tier asks for: none, mv_only (text vectors anew) or block.

    An empty catalog (null tier) asks for nothing, an unknown tier blocks. Visual vectors of another length than the
    tier's block too, where both lengths are known.
    """
    model = F.create_map(*(F.lit(x) for kv in TEXT_MODELS.items() for x in kv))
    a, b = F.try_element_at(model, stored), F.try_element_at(model, current)
    return F.when(stored.isNull(), "none").when(a.isNull() | b.isNull(), "block").when(F.coalesce(stored_dim != current_dim, F.lit(False)), "block").when(a == b, "none").otherwise("mv_only")
