from factloom.functions.ids import name_uuid
from factloom.functions.text import (
    alias_map_from_list,
    capitalize,
    embedding_input,
    first_filled,
    iso_time,
    metadata_from_json,
    normalize_category,
    relation_type,
    strip,
    tag_list,
    title_key,
    word_count,
    words,
)
from factloom.functions.vectors import cosine, dot, norm

__all__ = [
    "alias_map_from_list",
    "capitalize",
    "cosine",
    "dot",
    "embedding_input",
    "first_filled",
    "iso_time",
    "metadata_from_json",
    "name_uuid",
    "norm",
    "normalize_category",
    "relation_type",
    "strip",
    "tag_list",
    "title_key",
    "word_count",
    "words",
]
