"""Secret scans: keyword automaton, anchored patterns at hits, checksum validation.

An Aho-Corasick automaton finds the keywords in one pass; patterns are only tried where a keyword starts.
Long hexadecimal runs have no keyword and are found by their own run pattern. Tokens with an embedded
CRC-32 (six base-62 digits at the end) count only if it agrees.

A null text is empty. Repeated rows give repeated results, a null doc_id stays, an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import fold_case, per_row, table, whole

# The formats of the contract and of public token kinds with an embedded checksum.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:ghp|gho|ghu|ghs|ghr|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CHECKED_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ["assign", "access", "hex", "checked"]
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ["akia"]), ("checked", CHECKED_WORDS)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum_ok(body: str, tail: str) -> bool:
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(6, "0") == tail


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all secrets, in that order."""
    spans = []
    after = {"assign": 0, "access": 0, "checked": 0}
    starts = sorted((end - size + 1, kind) for end, (kind, size) in automaton().iter(fold_case(text)))
    for start, kind in starts:
        if start < after[kind]:
            continue
        pattern = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}[kind]
        hit = pattern.match(text, start)
        if hit is None:
            continue
        after[kind] = hit.end()
        if kind == "assign":
            right = hit.end(2) - hit.start(2) >= 6
        elif kind == "access":
            right = hit.end() - hit.start() >= 20
        else:
            right = checksum_ok(hit[1], hit[2])
        if right:
            spans.append((start, KINDS.index(kind), hit.end()))
    spans += [(hit.start(), KINDS.index("hex"), hit.end()) for hit in HEX.finditer(text)]
    return sorted(spans)


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def digest(doc_id, text) -> tuple:
    spans = find_secrets(whole(text))
    base = [s for s in spans if s[1] < 3]
    counts = [sum(s[1] == k for s in base) for k in range(3)]
    return (doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts, digest and all spans of every document."""
    return per_row(docs, SCHEMA, ["doc_id", "text"], digest)


def masked(text: str) -> str:
    """The text with every secret replaced by the name of its kind; overlapping secrets become one."""
    out, at = [], 0
    for start, kind, end in find_secrets(text):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame) -> DataFrame:
    """Documents with secrets masked; n_chars follows. A null text stays null."""
    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: masked(t) if isinstance(t, str) else None)

    safe = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        safe = safe.withColumn("n_chars", F.when(F.col("text").isNotNull(), changed).otherwise(F.col("n_chars")))
    return safe


def query(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents"))
