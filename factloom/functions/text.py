"""Text expressions. All of them are built-in column functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: white space as Python's str.split() and str.strip() see it. Java's plain
# \s is ASCII only; (?U) widens it, and the four separators \x1c-\x1f come on top.
SPACE = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)^{SPACE}+|{SPACE}+\z"
_RUN = rf"(?U){SPACE}+"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove white space at both ends, Unicode spaces included."""
    return F.regexp_replace(_col(value), _EDGES, "")


def capitalize(value: Column | str) -> Column:
    """First character upper case, the rest lower case (not word by word)."""
    value = _col(value)
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substring(value, 2, 2**31 - 1)))


def normalize_category(value: Column | str) -> Column:
    return capitalize(strip(value))


def words(value: Column | str) -> Column:
    """Tokens between white space; the empty string has none."""
    return F.filter(F.split(_col(value), _RUN), lambda token: token != "")


def word_count(value: Column | str) -> Column:
    return F.size(words(value))


def title_key(title: Column | str) -> Column:
    """Comparison form of a title; null for a missing or empty title.

    A title of blanks only is not empty: it compares equal to other blank titles.
    """
    title = _col(title)
    return F.when(title != "", F.lower(strip(title)))


def embedding_input(title: Column | str, text: Column | str) -> Column:
    """``title: text``, or the text alone where there is no title."""
    title, text = _col(title), _col(text)
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(": "), text)).otherwise(text)


def relation_type(value: Column | str) -> Column:
    """Name of an edge type: upper case, spaces as underscores."""
    return F.replace(F.upper(_col(value)), F.lit(" "), F.lit("_"))


def tag_list(csv: Column | str) -> Column:
    """Comma separated tags as an array, trimmed, blanks dropped."""
    parts = F.transform(F.split(_col(csv), ","), strip)
    return F.filter(parts, lambda tag: tag != "")


def alias_map_from_list(aliases: Column | str) -> Column:
    """A plain list of aliases as alias -> confidence, every confidence 1."""
    distinct = F.array_distinct(_col(aliases))
    return F.map_from_arrays(distinct, F.transform(distinct, lambda _: F.lit("1.0")))


def iso_time(ts: Column | str) -> Column:
    """Timestamp as text: 2024-01-31T08:30:00.000000, as stored without a zone."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def metadata_from_json(value: Column | str) -> Column:
    """Metadata kept as a JSON object; anything else is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(_col(value), "map<string,string>"), empty)


def first_filled(*values: Column | str) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(_col(v), F.lit("")) for v in values], F.lit(""))
