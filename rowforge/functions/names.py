"""Document ids, collection names and document paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# What a name or path must not contain.
TRAVERSAL = ".."
SEPARATOR = "/"
URL_CHARS = "[?#&]"
CONTROL = r"[\x00-\x1f\x7f]"


def doc_id_from_path(name: Column) -> Column:
    return F.substring_index(name, SEPARATOR, -1)


def _common_issue(text: Column) -> Column:
    trimmed = strip(text)
    return (
        F.when(text.isNull() | (trimmed == ""), "empty")
        .when(F.contains(trimmed, F.lit(TRAVERSAL)), "traversal")
        .when(trimmed.rlike(URL_CHARS), "url_characters")
        .when(trimmed.rlike(CONTROL), "control_characters")
    )


def collection_name_issue(name: Column) -> Column:
    """What is wrong with a collection name, or null."""
    return F.coalesce(
        _common_issue(name), F.when(F.contains(strip(name), F.lit(SEPARATOR)), "separator")
    )


def valid_collection_name(name: Column) -> Column:
    return collection_name_issue(name).isNull()


def document_path_issue(path: Column) -> Column:
    """What is wrong with a path of collection/document pairs, or null."""
    parts = F.split(strip(path), SEPARATOR)
    return F.coalesce(
        _common_issue(path),
        F.when((F.size(parts) < 2) | (F.size(parts) % 2 != 0), "odd_segments"),
        F.when(F.exists(parts, lambda part: strip(part) == ""), "empty_segment"),
    )


def valid_document_path(path: Column) -> Column:
    return document_path_issue(path).isNull()
