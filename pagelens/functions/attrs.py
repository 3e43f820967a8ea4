"""Values read out of object text, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the form of a number.
_NUMBER = r"[+\-]?(?:\d+\.\d+|\d+|\.\d+)"
# Fixed value: a reference, with the name in front of it when there is one.
REFERENCE = r"(?:/([^/\s<>\[\]\(\)]+)\s+\[?\s*)?(\d+)\s+(\d+)\s+R\b"


_UNSIGNED, _SIGNED = r"\d+", r"[+\-]?\d+"


def _first(body: Column, names: tuple[str, ...], value: str) -> Column:
    """Text of the first name that has a value, in the order given."""
    found = [F.regexp_extract(body, re.escape(n) + r"\s+(" + value + ")", 1) for n in names]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def _read(body: Column, names: tuple[str, ...], value: str, as_type: str, default: float | None) -> Column:
    """The value; the default where it is missing; null where it is there but does not fit the type."""
    text = _first(body, names, value)
    return F.when(text.isNull(), F.lit(default).cast(as_type)).otherwise(text.try_cast(as_type))


def attr_int(body: Column, *names: str, default: int | None = None) -> Column:
    """Unsigned integer after a name. A missing value without a default and one too large are null, for ``quarantine``."""
    return _read(body, names, _UNSIGNED, "int", default)


def attr_signed(body: Column, *names: str, default: int | None = None) -> Column:
    return _read(body, names, _SIGNED, "int", default)


def attr_float(body: Column, *names: str, default: float | None = None) -> Column:
    return _read(body, names, _NUMBER, "double", default)


def number_state(body: Column, *names: str, signed: bool = False) -> Column:
    """missing, bad (there, but beyond an integer) or value, so that ``quarantine`` can name the reason."""
    text = _first(body, names, _SIGNED if signed else _UNSIGNED)
    return F.when(text.isNull(), "missing").when(text.try_cast("int").isNull(), "bad").otherwise("value")


def attr_numbers(body: Column, name: str, default: list[float]) -> Column:
    """Numbers of the array after a name; the default when it is missing or empty."""
    inside = F.regexp_extract(body, r"(?s)" + re.escape(name) + r"\s*\[(.*?)\]", 1)
    numbers = F.transform(F.regexp_extract_all(inside, F.lit(_NUMBER), F.lit(0)), lambda n: n.cast("double"))
    return F.when(F.size(numbers) > 0, numbers).otherwise(F.array(*[F.lit(float(v)) for v in default]))


# Magic bytes and markers of payloads.
JPEG_MAGIC = "FFD8FF"
JP2_BOX = "0000000C6A502020"
CODESTREAM_MAGIC = "FF4F"
TYPE1_MARKS = ("%!PS-AdobeFont-", "%!FontType1-", "/FontType 1")


def sniff_payload(payload: Column) -> Column:
    """jpeg, jp2, codestream, type1 or other, from the first bytes."""
    head = F.decode(F.substring(payload, 1, 512), "ISO-8859-1")
    starts = F.hex(F.substring(payload, 1, 12))
    return (
        F.when(starts.startswith(JPEG_MAGIC), "jpeg")
        .when(starts.startswith(JP2_BOX) & (F.octet_length(payload) >= 12), "jp2")
        .when(starts.startswith(CODESTREAM_MAGIC), "codestream")
        .when(head.contains(TYPE1_MARKS[0]) | head.contains(TYPE1_MARKS[1]) | head.contains(TYPE1_MARKS[2]), "type1")
        .otherwise("other")
    )


# Short filter names, and the filters that only wrap another format.
FILTER_ALIASES = {
    "/Fl": "/FlateDecode", "/A85": "/ASCII85Decode", "/AHx": "/ASCIIHexDecode", "/DCT": "/DCTDecode",
    "/CCF": "/CCITTFaxDecode", "/LZW": "/LZWDecode", "/RL": "/RunLengthDecode",
}
WRAPPERS = ("/FlateDecode", "/ASCII85Decode", "/ASCIIHexDecode")


def classify_filter_chain(filters: Column, payload: Column) -> Column:
    """The first filter that is not a wrapper; without one, the image format of the payload or ''."""
    aliases = F.create_map(*[F.lit(v) for pair in FILTER_ALIASES.items() for v in pair])
    full = F.transform(filters, lambda f: F.coalesce(aliases[f], f))
    final = F.get(F.filter(full, lambda f: ~f.isin(*WRAPPERS)), F.lit(0))
    kind = sniff_payload(payload)
    guess = F.when(kind == "jpeg", "/DCTDecode").when(kind == "jp2", "/JPXDecode").otherwise("")
    return F.coalesce(final, guess)


def is_typed(body: Column, want: str, but_not: str) -> Column:
    """``/Type /want`` is there and ``/Type /but_not`` is not."""
    def has(name: str) -> Column:
        return F.regexp_like(body, F.lit(rf"/Type\s*/{name}\b"))

    return has(want) & ~has(but_not)


# The device spaces that a value stands for, by its first name; a bracket marks the array forms.
PLAIN_SPACES = {
    "DeviceGray": "DeviceGray", "DeviceRGB": "DeviceRGB", "DeviceCMYK": "DeviceCMYK",
    "[CalRGB": "DeviceRGB", "[Lab": "DeviceRGB", "[CalGray": "DeviceGray",
}
# Which form counts where a text holds several (least first), in an object and in a definition.
IN_OBJECT = {
    "DeviceGray": 0, "DeviceRGB": 0, "DeviceCMYK": 0, "[ICCBased": 1, "[CalRGB": 2, "[Lab": 2, "[CalGray": 3,
    "[Indexed": 4, "reference": 5, "name": 6,
}
IN_DEFINITION = {
    "DeviceGray": 0, "DeviceRGB": 0, "DeviceCMYK": 0, "[Pattern": 1, "[Indexed": 2, "[CalRGB": 3, "[Lab": 3,
    "[CalGray": 4, "[ICCBased": 5,
}
_NAME_CHARS = r"[^/\s<>\[\]\(\)]+"
_ARRAY = r"\[\s*/\w+[^\[\]]*\]?"


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[key]


def _spaces_of(values: Column, ranks: dict[str, int]) -> Column:
    """Structs (rank, at, kind, target) of values: names, heads of arrays, or references.

    One step after the other, so that each pattern runs once for a value.
    """
    def part(value: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(value, "(?s)" + pattern, 1), F.lit(""))

    def parts(v: Column) -> Column:
        return F.struct(
            F.regexp_replace(F.regexp_extract(v, r"^\[?\s*/\w+", 0), r"[\s/]", "").alias("head"),
            part(v, r"^(\d+)\s+\d+\s+R\b").alias("number"), part(v, f"^(/{_NAME_CHARS})").alias("name"),
            part(v, r"^\[\s*/\w+\s+(\d+)\s+\d+\s+R\s*\]").alias("profile"),
            part(v, rf"^\[\s*/\w+\b\s*/?({_NAME_CHARS})").alias("base"),
            part(v, r"^(\[\s*/\w+(?:\s*/(?:DeviceGray|DeviceRGB|DeviceCMYK))?\s*\])").alias("pattern"))

    def formed(p: Column) -> Column:
        plain = _lookup(PLAIN_SPACES, p["head"])
        form = F.when(plain.isNotNull(), p["head"]).when(p["number"].isNotNull(), "reference").when(
            p["name"].isNotNull(), "name").otherwise(p["head"])
        return F.struct(p.alias("p"), plain.alias("plain"), form.alias("form"))

    def known(f: Column, at: Column) -> Column:
        by_form = {
            "[ICCBased": ("icc", "profile"), "[Indexed": ("indexed", "base"), "[Pattern": ("pattern", "pattern"),
            "reference": ("indirect", "number"), "name": ("named", "name"),
        }
        kind, target = f["plain"], F.lit(None).cast("string")
        for key, (known_as, held) in by_form.items():
            found = f["p"][held]
            kind = F.when((f["form"] == key) & found.isNotNull(), F.lit(known_as)).otherwise(kind)
            if known_as != "pattern":
                target = F.when(f["form"] == key, found).otherwise(target)
        return F.struct(f["form"].alias("form"), at.alias("at"), kind.alias("kind"), target.alias("target"))

    def ranked(k: Column) -> Column:
        rank = F.when(k["kind"].isNotNull(), _lookup(ranks, k["form"]))
        return F.struct(rank.alias("rank"), k["at"].alias("at"), k["kind"].alias("kind"), k["target"].alias("target"))

    bare = F.transform(values, lambda v: F.regexp_replace(v, r"^\s+", ""))
    return F.transform(F.transform(F.transform(F.transform(bare, parts), formed), known), ranked)


def _first_space(values: Column, ranks: dict[str, int]) -> Column:
    """Struct (kind, target) of the value whose form comes first, of equal ones the leftmost; else null."""
    found = F.filter(_spaces_of(values, ranks), lambda s: s["rank"].isNotNull())
    best = F.slice(F.array_sort(found), 1, 1)
    return F.get(F.transform(best, lambda s: F.struct(s["kind"].alias("kind"), s["target"].alias("target"))), F.lit(0))


def classify_color_space(body: Column) -> Column:
    """Struct (kind, target) of the color space an object names; DeviceRGB where it names none that is known.

    Kinds icc, indirect and named carry a target to resolve: the profile's or definition's object
    number, or the resource name. Kind indexed carries its base name.
    """
    value = rf"/ColorSpace(\s*{_ARRAY}|\s*/{_NAME_CHARS}|\s+\d+\s+\d+\s+R\b)"
    default = F.struct(F.lit("DeviceRGB").alias("kind"), F.lit(None).cast("string").alias("target"))
    return F.coalesce(_first_space(F.regexp_extract_all(body, F.lit(value), F.lit(1)), IN_OBJECT), default)


def classify_definition(body: Column) -> Column:
    """The same for the text of a color space object; null where it is none that is known."""
    return _first_space(F.regexp_extract_all(body, F.lit(rf"^\s*/\w+|{_ARRAY}"), F.lit(0)), IN_DEFINITION)


def icc_fallback(alternate: Column, components: Column) -> Column:
    """The alternate space of a profile, else the device space of its component count, else null."""
    by_count = F.when(components == 1, "DeviceGray").when(components == 3, "DeviceRGB").when(components == 4, "DeviceCMYK")
    return F.coalesce(alternate, by_count)
