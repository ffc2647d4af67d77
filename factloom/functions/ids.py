"""Identifiers."""

from __future__ import annotations

from uuid import NAMESPACE_DNS, UUID

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_uuid(name: Column | str, namespace: UUID = NAMESPACE_DNS) -> Column:
    """Name-based UUID (version 5) of a string column.

    RFC 4122: SHA-1 over namespace and name, the version digit set to 5 and the two
    top bits of the variant digit set to 10.
    """
    name = F.col(name) if isinstance(name, str) else name
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
