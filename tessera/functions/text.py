"""Cleaning of texts, in column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that also count without their semicolon, and then as the beginning of a longer word.
_OPEN = {k: v for k, v in html5.items() if not k.endswith(";")}
_LONGEST = max(map(len, _OPEN))


def _windows(n: int) -> str:
    """What browsers take a number of 128 to 159 for: the byte of that value in Windows-1252, where it has one."""
    try:
        return bytes([n]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(n)


_OTHER = {"0": "�", "13": "\r"} | {str(n): _windows(n) for n in range(0x80, 0xA0)}


def _map(values: dict[str, str]) -> Column:
    """A map as one literal."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _numbered(body: Column) -> Column:
    """The character of a numeric reference, without its ampersand; none for a code point that is no character."""
    digits = F.regexp_extract(body, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
    n = F.when(F.length(digits) > 9, F.lit(1 << 32)).when(body.rlike("^#[xX]"), F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("bigint")).otherwise(F.concat(F.lit("0"), digits).try_cast("bigint"))
    wrong = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    none = n.between(1, 8) | n.between(14, 31) | n.isin(11, 127) | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
    return F.coalesce(F.try_element_at(_map(_OTHER), n.cast("string")), F.when(wrong, "�").when(none, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(F.when(wrong | none, 32).otherwise(n)), 8, "0")), "UTF-32")))


def _named(body: Column) -> Column:
    """The characters of a named reference; of an unknown name its longest beginning that is known without a semicolon, and the rest."""
    begun = [F.when(F.length(body) > k, F.concat(F.try_element_at(_map(_OPEN), F.substring(body, 1, k)), F.substring(body, F.lit(k + 1), F.length(body)))) for k in range(_LONGEST, 1, -1)]
    return F.coalesce(F.try_element_at(_map(html5), body), *begun, F.concat(F.lit("&"), body))


def unescaped(text: Column) -> Column:
    """Character references undone, as HTML reads them: names with and without a semicolon, decimal and hexadecimal numbers. Null stays null."""
    body = lambda ref: F.substring(ref, F.lit(2), F.length(ref))
    plain, found = F.split(text, _REFERENCE, -1), F.regexp_extract_all(text, F.lit(_REFERENCE), 0)
    said = F.transform(found, lambda ref: F.when(ref.startswith("&#"), _numbered(body(ref))).otherwise(_named(body(ref))))
    woven = F.array_join(F.flatten(F.zip_with(plain, F.concat(said, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return F.when(text.contains("&"), woven).otherwise(text)


def cleaned(text: Column) -> Column:
    """References undone twice, as texts that were escaped twice need, white space runs one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(unescaped(unescaped(text)), r"\s+", " ")))
