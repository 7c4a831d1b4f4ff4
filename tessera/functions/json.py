"""Values out of JSON texts that may be broken or lack what is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The text as a variant, null where it is no JSON."""
    return F.try_parse_json(text)


def broken(text: Column) -> Column:
    """Is there a text that is no JSON?"""
    return text.isNotNull() & F.try_parse_json(text).isNull()


def value(variant: Column, path: str, kind: str, default=None) -> Column:
    """What lies at path, as kind; default where nothing does. A JSON null that is there is null, and so is a value of another kind."""
    found = F.variant_get(variant, path, "variant")
    return F.when(found.isNull(), F.lit(default).cast(kind)).otherwise(F.try_variant_get(variant, path, kind))
