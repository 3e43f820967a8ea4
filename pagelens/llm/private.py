"""Removal of personal data, with terms that reveal it, in built-in expressions only.

Patterns find protected entities; the words outside of entities are terms. How much a term reveals an entity is
estimated over the whole corpus, in whole documents and at any distance: with n(t) the texts that hold term t,
n(te) those that also hold entity e, and p(e) the share of all texts with e, the smoothed estimate is
p(e|t) = (n(te) + WEIGHT * p(e)) / (n(t) + WEIGHT), and the disclosure is log2(p(e|t) / p(e)) bits. A term is telling
when p(e|t) and the disclosure are large enough for some entity. Copies of one text count once; one text alone
is no evidence, since each of its rare words would then reveal its entities. Nor are near copies: texts with entities
are grouped by MinHash bands over runs of SHINGLE words, and the texts of a group count once, as entity and as term.

A telling term is masked wherever it stands in a document that holds the entity, and with ``everywhere`` in
any document, which is what the query does.

A null text is empty. Repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import table
from pagelens.session import written

# The patterns of the contract, written so that no start inside a run is tried again and
# no repeated group recurses. \G lets a match begin where the last one ended.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?=[A-Za-z0-9-]|\.[A-Za-z0-9-])[A-Za-z0-9.-])*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?=[0-9]|[ -][0-9])[0-9 -])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
TERM = r"[\p{L}\p{N}_]{2,}+"
SHINGLE = 3  # words
BANDS, PER_BAND = 6, 2  # near copies at a similarity of 0.8 share a band with a chance of 0.998, at 0.1 of 0.06
WEIGHT = 2.0  # texts that the prior p(e) counts as
MIN_SHARE = 0.5
MIN_BITS = 4.0
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often lambdas read it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before_each(values: Column, fold, start: Column) -> Column:
    """``fold`` (sum or maximum) of all values before each position, by runs of about the root of their number."""
    def folded(array: Column, first: Column, count: Column) -> Column:
        return F.aggregate(F.slice(array, first, count), start, fold)

    def with_root(v: Column, root: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), root), lambda j: folded(v, j * root + 1, root))

        def place(heads: Column, i: Column) -> Column:
            run = F.floor(i / root).cast("int")
            return fold(F.get(heads, run), folded(v, run * root + 1, i - run * root))

        def from_runs(r: Column) -> Column:
            heads = F.transform(F.sequence(F.lit(0), root), lambda j: folded(r, F.lit(1), j))
            return let(heads, lambda h: F.transform(v, lambda _, i: place(h, i)))

        return let(runs, from_runs)

    return let(values, lambda v: let(
        F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int")), lambda root: with_root(v, root)))


def spans_of(text: Column, pattern: str | Column, kind: int = 0) -> Column:
    """Leftmost non-overlapping matches with their positions in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(hits: Column) -> Column:
        ends = F.zip_with(gaps, hits, lambda g, hit: g + F.coalesce(F.length(hit), F.lit(0)))
        starts = F.zip_with(before_each(ends, lambda a, b: a + b, F.lit(0)), gaps, lambda at, g: at + g)
        spans = F.zip_with(starts, hits, lambda at, hit: F.struct(
            at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(hit)).alias("stop"), hit.alias("value")))
        return F.when(F.size(hits) == 0, F.array().cast(SPAN)).otherwise(F.slice(spans, F.lit(1), F.size(hits)))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def valid(span: Column) -> Column:
    """Whether a match of a kind passes its check."""
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    parts = F.transform(F.split(span["value"], r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    card = F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return (
        F.when(span["kind"] == 1, small)
        .when(span["kind"] == 2, card)
        .when(span["kind"] == 3, F.length(digits).between(10, 15))
        .otherwise(True)
    )


def base_spans(text: Column) -> Column:
    found = [spans_of(text, pattern, k) for k, pattern in enumerate(PATTERNS.values())]
    return F.array_sort(F.filter(F.concat(*found), valid))


def rewritten(text: Column, spans: Column, mark) -> Column:
    """The text with ``mark(span, size)`` in place of the part of each span that no earlier one covers."""
    covered = before_each(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b), F.lit(0))

    def made(chars: Column) -> Column:
        def piece(span: Column, at: Column) -> Column:
            gap = F.array_join(F.slice(chars, at + 1, F.greatest(F.lit(0), span["start"] - at)), "")
            return F.concat(gap, mark(span, F.greatest(F.lit(0), span["stop"] - F.greatest(at, span["start"])), at))

        last = F.array_max(F.transform(spans, lambda s: s["stop"]))
        rest = F.array_join(F.slice(chars, last + 1, F.greatest(F.lit(0), F.size(chars) - last)), "")
        return F.concat(F.array_join(F.zip_with(spans, covered, piece), ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.split(text, ""), made))


def cleared(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans; positions stay the same."""
    return rewritten(text, spans, lambda span, size, at: F.repeat(F.lit(" "), size))


def entities_of(base: str) -> Column:
    return F.array_distinct(F.transform(base, lambda b: F.lower(b["value"])))


def bands_of(words: Column) -> Column:
    """MinHash bands of the runs of words."""
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - SHINGLE + 1)), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))

    def least(seed: int) -> Column:
        return F.array_min(F.transform(runs, lambda h: F.xxhash64(h, F.lit(seed))))

    return F.array(*[
        F.xxhash64(F.lit(band), *[least(band * PER_BAND + k) for k in range(PER_BAND)]) for band in range(BANDS)])


def contexts(texts: DataFrame) -> DataFrame:
    """Adds ``label``, one for texts (_key, words) that are near copies: the least key two bands away."""
    bands = written(texts.repartition("_key").select("_key", F.explode(bands_of(F.col("words"))).alias("band")))
    labels = texts.select("_key", F.col("_key").alias("label"))
    for _ in range(2):
        least = bands.join(labels, "_key").groupBy("band").agg(F.min("label").alias("label"))
        labels = bands.join(least, "band").groupBy("_key").agg(F.min("label").alias("label"))
    return texts.join(labels, "_key")


def telling_terms(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, entity) of all terms that reveal an entity, and the rows (doc_id, _key, base, word, term) of such terms.

    Counts are over distinct texts. Terms are counted among the texts with an entity first; that is at most their
    number of texts, so only terms that pass by it need to be counted in the others.
    """
    total = found.agg(F.count_distinct("_key").alias("n")).scalar()
    holding = found.filter(F.size("base") > 0).groupBy("_key").agg(F.first("words").alias("words"), F.first("base").alias("base"))
    holding = written(contexts(written(holding)).select(
        "label", F.array_distinct(F.transform("words", F.lower)).alias("terms"), entities_of("base").alias("entities")))
    prior = F.col("n_entity") / total
    share = (F.col("n_both") + WEIGHT * prior) / (F.col("n_term") + WEIGHT)
    enough = (share >= MIN_SHARE) & (F.log2(share / prior) >= MIN_BITS)
    # in one text, or in more than 2 ** -MIN_BITS of all, an entity has no term that reaches both limits
    entity = holding.select("label", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("entity").alias("n_entity"))
    entity = written(entity.filter((F.col("n_entity") >= 2) & (prior <= 2.0**-MIN_BITS)))
    both = holding.select("label", "terms", F.explode("entities").alias("entity")).join(entity, "entity", "left_semi")
    both = both.select("label", "entity", F.explode("terms").alias("term")).distinct().groupBy("term", "entity").agg(F.count("term").alias("n_both"))
    least = written(holding.select("label", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("term").alias("n_term")))
    some = written(both.filter("n_both >= 2").join(entity, "entity").join(least, "term").filter(enough).drop("n_term"))
    rows = found.select("doc_id", "_key", "base", F.explode("words").alias("word")).withColumn("term", F.lower("word"))
    rows = written(rows.join(written(some.select("term").distinct()), "term", "left_semi"))
    others = rows.filter(F.size("base") == 0).select("term", "_key").distinct().groupBy("term").agg(F.count("_key").alias("n_other"))
    counted = some.join(least, "term").join(others, "term", "left").withColumn(
        "n_term", F.col("n_term") + F.coalesce("n_other", F.lit(0)))
    return counted.filter(enough).select("term", "entity"), rows


def find_private(docs: DataFrame, everywhere: bool = False) -> DataFrame:
    """doc_id, text hash, and the sorted spans of entities and of telling terms of every document."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("_key"), "text")
    words = F.array_distinct(F.regexp_extract_all(cleared(F.col("text"), F.col("base")), F.lit(TERM), F.lit(0)))
    found = written(texts.withColumn("base", base_spans(F.col("text"))).select("doc_id", "_key", "base", words.alias("words")))
    telling, rows = telling_terms(found)
    if everywhere:
        hits = rows.join(telling.select("term").distinct(), "term", "left_semi")
    else:
        hits = rows.withColumn("entity", F.explode(entities_of("base"))).join(telling, ["term", "entity"], "left_semi")
    hits = written(hits.groupBy("doc_id", "_key").agg(F.first("base").alias("base"), F.collect_set("word").alias("hit")))
    hits = hits.withColumnsRenamed({"doc_id": "_id", "_key": "_hash"})
    # terms hold letters, digits and underscores only, so they can stand in a pattern as they are
    whole_words = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join("hit", "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    held = (texts["_key"] == hits["_hash"]) & texts["doc_id"].eqNullSafe(hits["_id"])
    marked = texts.join(hits, held).select("_id", "_hash", cleared(F.col("text"), F.col("base")).alias("text"), whole_words.alias("pattern"))
    marked = marked.groupBy("_id", "_hash").agg(F.first("text").alias("text"), F.first("pattern").alias("pattern"))
    marked = marked.select("_id", "_hash", spans_of(F.col("text"), F.col("pattern"), KINDS.index("term")).alias("terms"))
    joined = found.join(marked, (found["_key"] == marked["_hash"]) & found["doc_id"].eqNullSafe(marked["_id"]), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(SPAN))))
    return joined.select("doc_id", "_key", "base", spans.alias("spans"))


def named(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ","
    )


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span generalised to the name of its kind; overlapping spans become one."""
    names = F.array(*map(F.lit, KINDS))

    def mark(span: Column, size: Column, at: Column) -> Column:
        return F.when(span["start"] >= at, F.concat(F.lit("<"), F.get(names, span["kind"]), F.lit(">"))).otherwise("")

    return rewritten(text, spans, mark)


def sanitise(docs: DataFrame, everywhere: bool = False) -> DataFrame:
    """doc_id, the sanitised text and its spans for every row. Rows of one doc_id and text share their spans."""
    found = find_private(docs, everywhere).groupBy("doc_id", "_key").agg(F.first("spans").alias("spans"))
    found = found.withColumnsRenamed({"doc_id": "_id", "_key": "_hash"})
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    same = (F.xxhash64(texts["text"]) == found["_hash"]) & texts["doc_id"].eqNullSafe(found["_id"])
    return texts.join(found, same).select(
        "doc_id", sanitised(F.col("text"), F.col("spans")).alias("text"), named("spans").alias("spans")
    )


def counted(spans: str, kind: int) -> Column:
    """Number of spans of a kind. The lambda takes one argument: a second one would be the position."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = find_private(table(spark, folder, "documents"), everywhere=True)
    counts = [counted("base", k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(named("base"), 256).alias("base_sha256"), named("spans").alias("spans"))
