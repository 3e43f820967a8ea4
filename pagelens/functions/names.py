"""Name, code and text lookups as Column expressions, with their fixed tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The code page's special codes from 0x80 to 0x9F; codes left out stay unmapped.
WINANSI_SPECIALS = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰",
    0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•",
    0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}

# Glyph names of symbols, punctuation and ligatures.
SYMBOLS = {
    "space": " ", "nbspace": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$",
    "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "-", "period": ".", "slash": "/",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_",
    "quoteleft": "‘", "quoteright": "’", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "bullet": "•", "ellipsis": "…", "endash": "–", "emdash": "—", "quotedblleft": "“", "quotedblright": "”",
    "quotedblbase": "„", "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹",
    "guilsinglright": "›", "periodcentered": "·", "dotmath": ".", "degree": "°", "multiply": "×",
    "divide": "÷", "plusminus": "±", "lessequal": "≤", "greaterequal": "≥", "summation": "∑",
    "ordmasculine": "º", "onesans": "1", "foursans": "4", "fiveoclock": "◴", "tenoclock": "◷",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "Lslash": "Ł", "lslash": "ł",
    "partialdiff": "∂", "gradient": "∇", "product": "∏", "integral": "∫", "radical": "√", "radicalex": "√",
    "infinity": "∞", "approxequal": "≈", "notequal": "≠", "equivalence": "≡", "proportional": "∝",
    "similar": "∼", "intersection": "∩", "union": "∪", "element": "∈", "notelement": "∉",
    "propersubset": "⊂", "propersuperset": "⊃", "reflexsubset": "⊆", "reflexsuperset": "⊇",
    "logicaland": "∧", "logicalor": "∨", "therefore": "∴", "angle": "∠", "perpendicular": "⟂",
    "emptyset": "∅", "lozenge": "◊", "asteriskmath": "∗", "circleplus": "⊕", "circlemultiply": "⊗",
    "lessmuch": "≪", "muchless": "≪", "greatermuch": "≫", "muchgreater": "≫", "arrowdblboth": "⇔",
    "negationslash": "̸", "openbullet": "◦", "prime": "′", "dprime": "″", "trprime": "‴",
    "bardbl": "‖", "vextendsingle": "|", "braceex": "{", "integraldisplay": "∫", "planckover2pi1": "ħ",
    "phi1": "ϕ", "dotaccent": "˙", "dieresis": "¨", "arrowleft": "←", "arrowright": "→", "arrowup": "↑",
    "arrowdown": "↓", "arrowdblleft": "⇐", "arrowdblright": "⇒", "arrowdblup": "⇑", "arrowdbldown": "⇓",
    "AE": "Æ", "ae": "æ", "Eth": "Ð", "eth": "ð", "Oslash": "Ø", "oslash": "ø", "Thorn": "Þ", "thorn": "þ",
    "germandbls": "ß", "Dcroat": "Đ", "dcroat": "đ", "dotlessi": "ı", "OE": "Œ", "oe": "œ",
    "varepsilon": "ε", "vartheta": "ϑ", "varpi": "ϖ", "varsigma": "ς", "varphi": "ϕ",
}

# Glyph names of accented letters. Each is a letter and the name of its accent.
ACCENTED = """
    Aacute Abreve Acircumflex Adieresis Agrave Aogonek Aring Atilde Cacute Ccaron Ccedilla Dcaron
    Eacute Ecaron Ecircumflex Edieresis Egrave Eogonek Gbreve Iacute Icircumflex Idieresis Idotaccent Igrave
    Lacute Lcaron Nacute Ncaron Ntilde Oacute Ocircumflex Odieresis Ograve Otilde Racute Rcaron
    Sacute Scaron Scommaaccent Tcaron Tcommaaccent Uacute Ucircumflex Udieresis Ugrave Uhungarumlaut Uring
    Yacute Ydieresis Zacute Zcaron Zdot Zdotaccent
    aacute abreve acircumflex adieresis agrave aogonek aring atilde cacute ccaron ccedilla dcaron
    eacute ecaron ecircumflex edieresis egrave eogonek gbreve iacute icircumflex idieresis igrave
    lacute lcaron nacute ncaron ntilde oacute ocircumflex odieresis ograve otilde racute rcaron
    sacute scaron scommaaccent tcaron tcommaaccent uacute ucircumflex udieresis ugrave uhungarumlaut uring
    yacute ydieresis zacute zcaron zdot zdotaccent
""".split()

# Combining characters of the accents.
ACCENTS = {
    "acute": "́", "breve": "̆", "caron": "̌", "cedilla": "̧", "circumflex": "̂",
    "commaaccent": "̦", "dieresis": "̈", "dot": "̇", "dotaccent": "̇", "grave": "̀",
    "hungarumlaut": "̋", "ogonek": "̨", "ring": "̊", "tilde": "̃",
}

# Greek letters by name; the capitals have no final sigma.
GREEK = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma "
         "tau upsilon phi chi psi omega").split()
# The Russian alphabet, whose glyph names afii10017 and afii10065 onwards count its letters.
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
# Glyph names of stretched signs by the text they stand for.
STRETCHED = {
    "(": "parenleftbig parenleftBig parenleftbigg parenleftBigg parenlefttp parenleftex parenleftbt",
    ")": "parenrightbig parenrightBig parenrightbigg parenrightBigg parenrighttp parenrightex parenrightbt",
    "[": "bracketleftbig bracketleftBig bracketleftbigg bracketleftBigg bracketlefttp bracketleftex bracketleftbt",
    "]": "bracketrightbig bracketrightBig bracketrightbigg bracketrightBigg bracketrighttp bracketrightex "
         "bracketrightbt",
    "{": "braceleftbig braceleftBig braceleftbigg braceleftBigg bracelefttp braceleftmid braceleftbt braceleftex",
    "}": "bracerightbig bracerightBig bracerightbigg bracerightBigg bracerighttp bracerightmid bracerightbt "
         "bracerightex",
    "√": "radicalbig radicalBig radicalbigg radicalBigg",
}
DIGITS = "zero one two three four five six seven eight nine".split()


def glyph_names() -> dict[str, str]:
    """Glyph name -> text, built from Unicode names and the fixed values above."""
    names = dict(SYMBOLS)
    for first, last in (("A", "Z"), ("a", "z")):
        names.update({chr(c): chr(c) for c in range(ord(first), ord(last) + 1)})
    names.update({name: str(value) for value, name in enumerate(DIGITS)})
    names.update({name: unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]]) for name in ACCENTED})
    for name in GREEK:
        # Unicode spells this letter "lamda".
        letter = name.replace("lambda", "lamda").upper()
        names[name] = unicodedata.lookup(f"GREEK SMALL LETTER {letter}")
        names[name.capitalize()] = unicodedata.lookup(f"GREEK CAPITAL LETTER {letter}")
    names.update({name: text for text, stretched in STRETCHED.items() for name in stretched.split()})
    for n, letter in enumerate(CYRILLIC):
        names[f"afii{10017 + n}"] = letter.upper()
        names[f"afii{10065 + n}"] = letter
    return names


def name_table(spark: SparkSession) -> DataFrame:
    """The glyph names as a table (glyph, known); fixed size, safe to broadcast."""
    return spark.createDataFrame(sorted(glyph_names().items()), "glyph string, known string")


def winansi_table(spark: SparkSession) -> DataFrame:
    """The code page (code, text); fixed size, safe to broadcast."""
    plain = {c: chr(c) for c in [*range(32, 127), *range(0xA0, 0x100)]}
    return spark.createDataFrame(sorted({**plain, **WINANSI_SPECIALS}.items()), "code int, text string")


def is_scalar(code: Column) -> Column:
    """A valid Unicode scalar value: no surrogate, at most 10FFFF."""
    return code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)


def char_of(code: Column) -> Column:
    """Text of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def plain_glyph_name(name: Column) -> Column:
    """``#xx`` escapes decoded and anything from the first later dot cut off."""
    pieces = F.regexp_extract_all(name, F.lit("#[0-9A-Fa-f]{2}|[^#]+|#"), F.lit(0))
    decoded = F.array_join(
        F.transform(pieces, lambda p: F.when(
            F.regexp_like(p, F.lit("^#[0-9A-Fa-f]{2}$")),
            char_of(F.conv(F.substring(p, 2, 2), 16, 10).cast("long"))).otherwise(p)), "")
    return F.when(F.instr(decoded, ".") > 1, F.substring_index(decoded, ".", 1)).otherwise(decoded)


def unicode_name_text(name: Column) -> Column:
    """Text of a ``uniXXXX...`` or ``uXXXX`` to ``uXXXXXX`` name, else null."""
    unit = "(?:[0-9A-CE-Fa-ce-f][0-9A-Fa-f]{3}|[Dd][0-7][0-9A-Fa-f]{2})"
    code = F.conv(F.substring(name, 2, 6), 16, 10).cast("long")
    return F.when(
        F.regexp_like(name, F.lit(f"^uni{unit}+$")), F.decode(F.unhex(F.substr(name, F.lit(4))), "UTF-16BE")
    ).when(
        F.regexp_like(name, F.lit("^u[0-9A-Fa-f]{4,6}$")) & is_scalar(code), char_of(code)
    )


def normalise_name(df: DataFrame, name: str, out: str) -> DataFrame:
    """Adds the text of a glyph name: known name, then Unicode form, then single character, else null."""
    keyed = df.withColumn("_glyph", plain_glyph_name(F.col(name)))
    known = F.broadcast(name_table(df.sparkSession)).withColumnsRenamed({"glyph": "_glyph", "known": "_known"})
    single = F.when(F.length("_glyph") == 1, F.col("_glyph"))
    return keyed.join(known, "_glyph", "left").withColumn(
        out, F.coalesce("_known", unicode_name_text(F.col("_glyph")), single)
    ).drop("_glyph", "_known")


def strip_subset_prefix(font: Column) -> Column:
    """Font name after the first plus sign, unless nothing follows it."""
    at = F.instr(font, "+")
    return F.when((at > 0) & (at < F.length(font)), F.substr(font, at + 1)).otherwise(font)


# Ordered font rules (kind of test, text, result); the first that fits wins.
STYLE_RULES = (("starts", "cmmi", "Italic"), ("contains", "bold", "Bold"), ("contains", "italic", "Italic"),
               ("contains", "oblique", "Italic"))
FAMILY_RULES = (
    ("starts", "cmmi", "Cambria Math"), ("starts", "cmsy", "Cambria Math"), ("starts", "cmex", "Cambria Math"),
    ("starts", "msbm", "Cambria Math"), ("starts", "timesnewroman", "Times New Roman"),
    ("starts", "arial", "Arial"), ("starts", "couriernew", "Courier New"), ("starts", "cmr", "Times New Roman"),
    ("starts", "cmss", "Arial"), ("starts", "cmtt", "Courier New"), ("is", "Helvetica", "Arial"),
    ("is", "Helvetica-Bold", "Arial"), ("is", "Times-Roman", "Times New Roman"),
    ("is", "Times-Bold", "Times New Roman"), ("is", "Courier", "Courier New"),
    ("is", "Courier-Bold", "Courier New"), ("contains", "classic", "Palatino Linotype"),
    ("contains", "switzer", "Arial"), ("contains", "serif", "Times New Roman"), ("contains", "mono", "Courier New"),
)


def _first_rule(name: Column, rules, default: str) -> Column:
    low = F.lower(name)
    tests = {"starts": low.startswith, "contains": low.contains, "is": name.eqNullSafe}
    out = None
    for kind, text, result in rules:
        out = (F if out is None else out).when(tests[kind](text), result)
    return out.otherwise(default)


def font_style(font: Column) -> Column:
    return _first_rule(strip_subset_prefix(font), STYLE_RULES, "Regular")


def font_family(font: Column) -> Column:
    return _first_rule(strip_subset_prefix(font), FAMILY_RULES, "Arial")


def prefers_glyph_codes(font: Column, body: Column, file_size: Column, file_type: Column) -> Column:
    """A barcode font, or an identity-mapped font with an embedded TrueType program."""
    low = F.lower(strip_subset_prefix(font))
    barcode = low.contains("code128") | low.contains("code39") | low.contains("barcode")
    identity = F.regexp_like(body, F.lit(r"/Subtype\s*/CIDFontType2\b")) & F.regexp_like(
        body, F.lit(r"/CIDToGIDMap\s*/Identity\b"))
    compact = F.coalesce(F.lower(file_type).isin("/type1c", "/cidfonttype0c"), F.lit(False))
    return barcode | (identity & (F.coalesce(file_size, F.lit(0)) > 0) & ~compact)


def hex_to_bytes(text: Column) -> Column:
    """Bytes of a hex string: blanks dropped, an odd last digit padded on the right with 0."""
    digits = F.regexp_replace(text, r"\s+", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def hex_to_text(text: Column) -> Column:
    """Hex digits read as UTF-16 big endian text."""
    return F.decode(hex_to_bytes(text), "UTF-16BE")
