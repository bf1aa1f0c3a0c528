"""The two text fields that a file is searched by, from its catalog row."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestone.functions.records import array_or_empty
from lodestone.functions.text import path_terms

#: The name of a tree's top, which says nothing.
TOP = "Root"


def _tree_names(tree: str | None) -> list[str]:
    try:
        top = json.loads(tree) if tree else None
    except ValueError:
        return []
    names, waiting = {}, [top]
    while waiting:
        node = waiting.pop()
        if not isinstance(node, dict):
            continue
        name, cleaned = node.get("name") or "", node.get("cleaned_name") or ""
        for n in (name, cleaned if cleaned != name else ""):
            if n and n != TOP:
                names[str(n)] = None
        children = node.get("children")
        waiting += reversed(children) if isinstance(children, list) else []
    return list(names)


def layer_tree_names(tree: Column) -> Column:
    """Names of a tree of layers (JSON text: name, cleaned_name, children, of any depth), once each: a layer's own, its
    cleaned one where that differs, then those below it in order. No built-in walks a tree of unknown depth."""

    @pandas_udf("array<string>")
    def walk(s: pd.Series) -> pd.Series:
        return s.map(_tree_names)

    return walk(tree)


def _list_words(metadata: Column, path: str) -> Column:
    """The entries of a list in a JSON text, with spaces between; empty if it is no list."""
    value = F.get_json_object(metadata, path)
    return F.array_join(array_or_empty(F.when(F.startswith(F.ltrim(value), F.lit("[")), value)), " ")


def _together(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda p: p != ""), " ")


def strong_field(file_name: Column, metadata: Column, user_tags: Column, ocr_text: Column) -> Column:
    """What names a file: its name, its layers and their tags, its fonts, the user's tags, text in the picture.

    metadata: JSON with layer_tree, semantic_tags and used_fonts; user_tags: a JSON list. What is missing, or isn't of
    its kind, is left out.
    """
    layers = F.array_join(layer_tree_names(F.get_json_object(metadata, "$.layer_tree")), " ")
    return _together(file_name, layers, F.get_json_object(metadata, "$.semantic_tags"), _list_words(metadata, "$.used_fonts"), _list_words(user_tags, "$"), ocr_text)


def weak_field(file_path: Column, folder_path: Column, relative_path: Column, metadata: Column, user_note: Column, folder_tags: Column, *classes: Column) -> Column:
    """What says where a file belongs: terms of its paths, text in its layers, the user's note, folder tags, classes."""
    paths = [F.array_join(path_terms(p), " ") for p in (file_path, folder_path, relative_path)]
    return _together(*paths, _list_words(metadata, "$.text_content"), user_note, _list_words(folder_tags, "$"), *classes)
