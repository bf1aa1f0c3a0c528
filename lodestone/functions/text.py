"""Column functions over names, paths and text."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Words of paths that say nothing about what they hold, and image file extensions.
STOP_TERMS = ("assets", "asset", "images", "image", "img", "files", "file", "data", "resource", "resources", "output", "outputs", "tmp", "temp", "test")
EXTENSIONS = ("psd", "png", "jpg", "jpeg")
#: In a character class.
PUNCTUATION = r""",.;:!?"'()\[\]{}"""

# Noise in layer names, in this order, and names that editors give by default.
LAYER_NOISE = (
    r"(?<![\p{L}\p{N}_])copy(?![\p{L}\p{N}_])",
    r"(?<![\p{L}\p{N}_])복사(?![\p{L}\p{N}_])",
    r"(?<![\p{L}\p{N}_])のコピー\s*\d*(?![\p{L}\p{N}_])",
    r"\d+$",
    r"^\d+\s*",
    r"[_\-]+$",
    r"^[_\-]+",
)
DEFAULT_LAYERS = (
    "layer", "group", "shape", "untitled", "레이어", "그룹", "모양", "무제", "レイヤー", "グループ", "シェイプ",
    "levels", "curves", "brightness/contrast", "hue/saturation", "color balance", "black & white", "photo filter", "exposure",
    "明るさ・コントラスト", "カラーバランス", "色相・彩度", "トーンカーブ", "☆", "★", "ｔ",
)
NUMBERED_LAYER = r"(?i)^(?:layer|group|shape|レイヤー|グループ|シェイプ|明るさ・コントラスト|カラーバランス|色相・彩度|levels|curves)\s*\d*$"
# What parts of a layer's name say about its content, in order of precedence.
CONTENT_WORDS = {
    "background": ("bg", "background", "배경"),
    "character": ("char", "character", "캐릭터", "body", "face"),
    "effect": ("fx", "effect", "효과", "glow", "shadow"),
    "ui": ("ui", "button", "버튼", "icon"),
    "text": ("text", "텍스트", "label"),
}
# Folders that begin a relative path, in order of precedence.
ROOT_MARKERS = ("/assets/", "/Assets/", "/resources/", "/Resources/")


def meaningful(token: Column) -> Column:
    """Two characters or more, no number, no version mark, no extension, no stop word."""
    return (F.length(token) >= 2) & ~token.rlike(r"^[0-9]+$") & ~token.rlike(r"^v[0-9]+$") & ~token.isin(*EXTENSIONS, *STOP_TERMS)


def path_terms(path: Column) -> Column:
    """The segments of a path that are one word, and the words of all, once each in order."""
    segments = F.split(F.lower(F.coalesce(path, F.lit(""))), "/")
    words = F.flatten(F.transform(segments, lambda s: F.split(s, "[^0-9a-z가-힣]+")))
    return F.array_distinct(F.filter(words, meaningful))


def fold(text: str) -> str:
    """Lower case without diacritics; composed, so that Hangul syllables stay whole."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn"))


def folded(text: Column) -> Column:
    """fold in Arrow batches: there is no built-in for it."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(fold)

    return run(F.coalesce(text, F.lit("")))


def tokens(text: Column) -> Column:
    """Words of letters and digits of any script, in lower case and without diacritics."""
    return F.array_remove(F.split(folded(text), r"[^\p{L}\p{N}]+"), "")


def ascii_tokens(text: Column) -> Column:
    """Lower-cased words of letters a-z and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z]+"), "")


def query_tokens(query: Column) -> Column:
    """Words of two characters or more without the listed punctuation at their ends, once each."""
    words = F.transform(F.split(F.lower(query), r"\s+"), lambda w: F.regexp_replace(w, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def joined(*parts: Column) -> Column:
    """Parts with a space between, empty ones left out."""
    return F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def document_text(caption: Column, tags: Column, facts: Column) -> Column:
    """Two sections: what is seen, and what is known. Empty sections are left out."""
    seen = joined(caption, F.array_join(tags, ", "))
    known = F.array_join(facts, "; ")
    return F.concat_ws("\n", F.when(seen != "", F.concat(F.lit("[SEMANTIC] "), seen)), F.when(known != "", F.concat(F.lit("[FACTS] "), known)))


def clean_name(name: Column) -> Column:
    """A layer's name without copy marks, outer numbers and underscores; empty for default names."""
    out = F.trim(F.coalesce(name, F.lit("")))
    for noise in LAYER_NOISE:
        out = F.regexp_replace(out, f"(?i){noise}", "")
    out = F.trim(F.regexp_replace(F.replace(out, F.lit("_"), F.lit(" ")), r"\s+", " "))
    lone = (F.length(out) == 1) & ~out.rlike("^[一-鿿]$")
    return F.when(F.lower(out).isin(*DEFAULT_LAYERS) | out.rlike(NUMBERED_LAYER) | lone, "").otherwise(out)


def semantic_tags(layer_paths: Column) -> Column:
    """The cleaned names of all segments of the paths, once each in order."""
    segments = F.flatten(F.transform(F.coalesce(layer_paths, F.array().cast("array<string>")), lambda p: F.split(p, "/")))
    return F.array_join(F.array_distinct(F.filter(F.transform(segments, clean_name), lambda n: n != "")), " ")


def layer_names(names: Column, most: int = 50) -> Column:
    """The raw names of layers, once each in order, the first `most` of them."""
    return F.slice(F.array_distinct(F.filter(names, lambda n: F.trim(n) != "")), 1, most)


def name_tags(file_name: Column) -> Column:
    """A file's name without extension, with spaces for underscores and hyphens."""
    return F.trim(F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), r"[_\-]+", " "))


def split_root(path: Column) -> Column:
    """(storage_root, relative_path): split before the first marker folder, in order of the list, else at the name."""
    none = F.lit(None).cast("struct<storage_root:string,relative_path:string>")
    out = none
    for m in reversed(ROOT_MARKERS):
        at = F.locate(m, path)
        pair = F.struct(F.substring(path, F.lit(1), at - 1).alias("storage_root"), F.regexp_replace(F.substring(path, at, F.length(path)), "^/+", "").alias("relative_path"))
        out = F.when(at > 0, pair).otherwise(out)
    whole = F.struct(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("storage_root"), F.regexp_extract(path, r"([^/]*)$", 1).alias("relative_path"))
    return F.when(path.isNull(), none).otherwise(F.coalesce(out, whole))


def root_of(root: Column, path: Column, name: Column) -> Column:
    """The storage root, or the path without the file name where it is blank."""
    return F.coalesce(F.nullif(F.trim(root), F.lit("")), F.replace(path, F.concat(F.lit("/"), name), F.lit("")))


def folder_depth(relative: Column) -> Column:
    return F.when(F.coalesce(relative, F.lit("")) == "", 0).otherwise(F.size(F.split(relative, "/")))


def content_type(name: Column, canvas_w: Column, canvas_h: Column, width: Column, height: Column, left: Column, top: Column, alpha: Column) -> Column:
    """What a layer shows, by its name, else by its size and place: the first rule that holds."""
    low, area = F.lower(name), width * height / F.nullif(canvas_w * canvas_h, F.lit(0))
    off = F.sqrt(F.pow(left + width / 2 - canvas_w / 2, 2) + F.pow(top + height / 2 - canvas_h / 2, 2))
    centred = off / (F.sqrt(F.pow(canvas_w, 2) + F.pow(canvas_h, 2)) / 2) < 0.3
    corner = ((left < canvas_w * 0.1) | (left + width > canvas_w * 0.9)) & ((top < canvas_h * 0.1) | (top + height > canvas_h * 0.9))
    out = F.when(area.isNull(), "unknown")
    for kind, words in CONTENT_WORDS.items():
        out = out.when(reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in words]), kind)
    out = out.when(area > 0.9, "background").when((area < 0.05) & (alpha < 0.3), "effect")
    return out.when(centred & (area > 0.1), "character").when(centred, "object").when(corner & (area < 0.1), "ui").otherwise("unknown")
