"""Object catalogue: revisions, references, trees, scopes and maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.attrs import classify_color_space, classify_definition, icc_fallback
from pagelens.functions.geom import Rect, rect_path_bounds
from pagelens.operators.skew import first_by, join_null_safe
from pagelens.session import checkpointed, written


def latest_definition(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The last definition of each key."""
    return first_by(df, keys, [-F.col(pos)])


def overlay(primary: DataFrame, secondary: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The last primary definition of a key wherever it stands, else the last secondary one."""
    both = primary.withColumn("_rank", F.lit(0)).unionByName(secondary.withColumn("_rank", F.lit(1)))
    return first_by(both, keys, ["_rank", -F.col(pos)]).drop("_rank")


def first_seen_order(df: DataFrame, keys: list[str], value: str, pos: str = "pos") -> DataFrame:
    """The last value of each key, with the position of its first definition as the listing order."""
    return df.groupBy(*keys).agg(F.min(pos).alias("listed_at"), F.max_by(value, pos).alias(value))


def resolve_refs(
    edges: DataFrame, objects: DataFrame, target: str, node: str, keys: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Edges joined to the object they point to, and dangling edges. Objects of another document (``keys``) do not count."""
    renamed = objects.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    on = reduce(Column.__and__, [edges[k] == renamed[f"_on_{k}"] for k in keys], edges[target] == renamed[node])
    return edges.join(renamed, on).drop(*[f"_on_{k}" for k in keys]), edges.join(renamed, on, "left_anti")


def walk_tree(
    edges: DataFrame, roots: DataFrame, attrs: DataFrame | None = None, inherited: tuple[str, ...] = (), keys: tuple[str, ...] = ()
) -> DataFrame:
    """Nodes in depth-first order: keys, node, depth, path, and inherited attributes.

    ``edges`` is (parent, child, ord), ``roots`` is (node, ord), ``attrs`` has a row for each node; all with the
    document ``keys``, as object numbers start again in every file. Trees of all documents are walked together. A node counts once, on its first visit,
    which is the path with the least sequence of ``ord``. Paths are extended level by level; a node is
    extended again only if a lesser path to it turns up, so cycles end by themselves. An attribute is
    the node's own value or the nearest ancestor's, each on its own.
    """
    place = [*keys, "node"]

    def with_own(nodes: DataFrame) -> DataFrame:
        if attrs is None:
            return nodes
        own = attrs.select(*place, *[F.col(c).alias(f"_own_{c}") for c in inherited])
        return nodes.join(own, place, "left").select(
            *place, "depth", "path", *[F.coalesce(f"_own_{c}", c).alias(c) for c in inherited]
        )

    nothing = [F.lit(None).cast("string").alias(c) for c in inherited]
    layer = checkpointed(with_own(
        roots.select(*place, F.lit(0).alias("depth"), F.array(F.col("ord").cast("long")).alias("path"), *nothing)))
    layers = [layer]
    while not layer.isEmpty():
        steps = layer.withColumnRenamed("node", "parent").join(edges, [*keys, "parent"]).select(
            *keys, F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"),
            F.concat("path", F.array(F.col("ord").cast("long"))).alias("path"), *inherited,
        )
        best = first_by(steps, place, ["path"])
        seen = reduce(DataFrame.unionByName, [v.select(*place, "path") for v in layers])
        as_good = reduce(Column.__and__, [F.col(f"s.{c}") == F.col(f"n.{c}") for c in place], F.col("s.path") <= F.col("n.path"))
        better = best.alias("n").join(seen.alias("s"), as_good, "left_anti")
        layer = checkpointed(with_own(better))
        layers.append(layer)
    return first_by(reduce(DataFrame.unionByName, layers), place, ["path"])


def inherit(
    edges: DataFrame, roots: DataFrame, attrs: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ()
) -> DataFrame:
    """Effective attributes of every node of the trees."""
    return walk_tree(edges, roots, attrs, columns, keys)


def with_fallback(main: DataFrame, alternative: DataFrame, key: str) -> DataFrame:
    """Main rows, and alternative rows of the keys that have no main row."""
    return main.unionByName(alternative.join(main.select(key).distinct(), key, "left_anti"))


def resolve_in_scope(
    requests: DataFrame, scopes: DataFrame, resources: DataFrame, keys: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Resources by name, from the request's scope outwards, and the request ids that no scope answers.

    ``requests`` is (request_id, scope, name), ``scopes`` (scope, parent), ``resources`` (scope, name,
    target), all with the document ``keys``; request ids are those of a document. In each scope the name itself is tried first, then the name with its leading slash taken
    off or put on. Requests that miss move on to the parent scope, however many there are, so every round
    has fewer rows; a request that comes back to a scope it has tried is a miss.
    """
    toggled = F.when(F.col("name").startswith("/"), F.substr("name", F.lit(2))).otherwise(F.concat(F.lit("/"), "name"))
    asked = [*keys, "request_id"]
    parents = scopes.select(*keys, "scope", "parent").filter("parent IS NOT NULL")
    opened = requests.withColumns({"depth": F.lit(0), "_tried": F.array("scope")})
    found = []
    while True:
        tries = opened.select(*asked, "scope", "depth", F.posexplode(F.array("name", toggled)).alias("rank", "key"))
        hits = tries.join(resources.select(*keys, "scope", F.col("name").alias("key"), "target"), [*keys, "scope", "key"])
        best = checkpointed(first_by(hits.select(*asked, "depth", "rank", "target"), asked, ["rank"]))
        found.append(best)
        opened = checkpointed(
            opened.join(best, asked, "left_anti").join(parents, [*keys, "scope"])
            .filter(~F.array_contains("_tried", F.col("parent")))
            .select(
                *asked, F.col("parent").alias("scope"), "name", (F.col("depth") + 1).alias("depth"),
                F.array_append("_tried", F.col("parent")).alias("_tried"),
            )
        )
        if opened.isEmpty():
            break
    answered = reduce(DataFrame.unionByName, found)
    return answered, requests.select(*asked).distinct().join(answered, asked, "left_anti")


def merge_maps(primary: DataFrame, secondary: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Union of two keyed maps; the primary wins."""
    second = secondary.select(*keys, F.col(value).alias("_second"))
    return primary.join(second, keys, "full").select(*keys, F.coalesce(value, "_second").alias(value))


def resolve_color_spaces(
    bodies: DataFrame, key: str, body: str, objects: DataFrame, profiles: DataFrame, named: DataFrame, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Color space kind of each body, after looking up definitions, profiles and names.

    ``objects`` is (obj, text), ``profiles`` (obj, alternate, components), ``named`` (name, kind), all with the
    document ``keys``.
    A profile of another component count and a name nobody defines are reported as unsupported. Equal bodies of a
    document are looked at once.
    """
    bodies = bodies.select(*dict.fromkeys([*keys, key]), F.col(body).alias("_body"))
    rows, place = [*keys, "_body"], [*keys, "target"]
    first = written(bodies.select(*rows).distinct().select(*rows, classify_color_space(F.col("_body")).alias("s")).select(*rows, "s.*"))
    definitions = objects.select(*keys, F.col("obj").alias("target"), classify_definition(F.col("text")).alias("d"))
    indirect = first.filter("kind = 'indirect'").join(definitions, place, "left").select(
        *rows, F.coalesce("d.kind", F.lit("DeviceRGB")).alias("kind"), F.col("d.target").alias("target"))
    direct = first.filter("kind <> 'indirect'").unionByName(indirect)
    fallback = profiles.select(*keys, F.col("obj").alias("target"), icc_fallback(F.col("alternate"), F.col("components")).alias("_icc"))
    names = named.select(*keys, F.col("name").alias("target"), F.col("kind").alias("_named"))
    looked_up = direct.join(fallback, place, "left").join(names, place, "left")
    kind = F.when(F.col("kind") == "icc", F.coalesce("_icc", F.lit("unsupported"))).when(
        F.col("kind") == "named", F.coalesce("_named", F.lit("unsupported"))).otherwise(F.col("kind"))
    kinds = written(looked_up.select(*rows, kind.alias("kind")))
    return join_null_safe(bodies, kinds, rows).drop("_body")


MATRIX = ["a", "b", "c", "d", "e", "f"]


def multiply(m: list[Column], n: list[Column]) -> list[Column]:
    """Matrix m applied before n, both as (a, b, c, d, e, f)."""
    return [
        m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3],
        m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5],
    ]


def expand_uses(
    uses: DataFrame, forms: DataFrame, images: DataFrame, starts: DataFrame, page_h: float, zoom: float,
    keys: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images drawn through nested forms with their bounds, uses of unknown names, and uses cut as cycles.

    ``uses`` is (owner, name, a..f at the use), ``forms`` (name, a..f), ``images`` (name), ``starts``
    (owner), one row for each page; its owner comes back as ``start``. All have the document ``keys``. A form's matrix is put before the
    current one; a form wins over an image of the same name; bounds are not clipped. Forms nest to any
    depth; a form used inside itself is not entered again but returned with its depth.
    """
    at_use = [F.col(c).alias(f"u_{c}") for c in MATRIX]
    start, used = [*keys, "start"], [*keys, "used"]
    calls = uses.select(*keys, F.col("owner"), F.col("name").alias("used"), *at_use)
    shapes = forms.select(*keys, F.col("name").alias("used"), *[F.col(c).alias(f"m_{c}") for c in MATRIX])
    pictures = images.select(*keys, F.col("name").alias("used")).distinct()
    unit = [F.lit(v).alias(c) for c, v in zip(MATRIX, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))]
    layer = starts.select(
        *keys, F.col("owner").alias("start"), "owner", F.lit(0).alias("depth"), F.array("owner").alias("_within"), *unit)
    drawn, unknown, cycles = [], [], []
    while True:
        drawing = multiply([F.col(f"u_{c}") for c in MATRIX], [F.col(c) for c in MATRIX])
        here = layer.join(calls, [*keys, "owner"]).select(
            *start, "used", "_within", (F.col("depth") + 1).alias("depth"), *[v.alias(c) for v, c in zip(drawing, MATRIX)])
        here = checkpointed(here.join(shapes, used, "left"))
        leaf = here.filter("m_a IS NULL").select(*start, "used", "depth", *MATRIX)
        drawn.append(leaf.join(pictures, used, "left_semi"))
        unknown.append(leaf.join(pictures, used, "left_anti").select(*start, "used", "depth"))
        again = F.array_contains("_within", F.col("used"))
        entered = here.filter("m_a IS NOT NULL")
        cycles.append(entered.filter(again).select(*start, "used", "depth"))
        inner = multiply([F.col(f"m_{c}") for c in MATRIX], [F.col(c) for c in MATRIX])
        layer = entered.filter(~again).select(
            *start, F.col("used").alias("owner"), "depth", F.array_append("_within", F.col("used")).alias("_within"),
            *[v.alias(c) for v, c in zip(inner, MATRIX)])
        if layer.isEmpty():
            break
    one, zero = F.lit(1.0), F.lit(0.0)
    bounds: Rect = rect_path_bounds(zero, zero, one, one, [F.col(c) for c in MATRIX], F.lit(page_h), F.lit(zoom))
    leaves = reduce(DataFrame.unionByName, drawn).select(*start, F.col("used").alias("name"), "depth", *bounds.columns())
    return leaves, reduce(DataFrame.unionByName, unknown), reduce(DataFrame.unionByName, cycles)
