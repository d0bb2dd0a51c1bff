"""Secret scanning with multipart credential linking, in DataFrame functions only.

Three strong kinds are reported wherever they occur. Weak parts (an account
identifier, a bare or loosely named key, an endpoint) are ambiguous alone and
are reported only when complementary parts lie within one scope of text and
outside the part itself: a string never completes itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmary.llm.common import running, text_of, written

#: Kinds in the order that breaks ties, their patterns, the group that is measured, its least length, their role.
STRONG = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "secret"),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16, "identifier"),
    ("hex", r"[0-9a-f]{32,}", 0, 32, "secret"),
]
WEAK = [
    (
        "id",
        r"""(?i)(?<![A-Za-z0-9_])(access[_-]?key(?:[_-]?id)?|client[_-]?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""",
        2,
        3,
        "identifier",
    ),
    ("key", r"""(?i)(?<![A-Za-z0-9_])(pwd|pass|auth|credential|signature|private[_-]?key)["']?\x20*[:=]\x20*["']?([^\s"',;]+)""", 2, 6, "secret"),
    ("bare", r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])[A-Za-z0-9+/]{20,}={0,2}", 0, 20, "secret"),
    ("url", r"""(?i)(?<![A-Za-z0-9_])(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+""", 0, 12, "endpoint"),
    ("host", r"""(?i)(?<![A-Za-z0-9_])(host|endpoint|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._:/-]+)""", 2, 4, "endpoint"),
]
KINDS = STRONG + WEAK
#: Which roles complete a weak part.
COMPLETES = {"identifier": ["secret"], "secret": ["identifier", "endpoint"], "endpoint": ["secret"]}


def _pieces(text: Column, pattern: str, group: int, least: int) -> Column:
    """For each match its distance from the end of the one before, its length, and whether it counts.

    The text between matches comes from a split by the same pattern, so positions
    are sums of lengths: linear in the text, in code points.
    """
    lengths = lambda a: F.transform(a, F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(
        lengths(F.split(text, pattern, -1)).alias("gap"), lengths(found).alias("len"), lengths(measured).alias("size")
    )
    kept = F.transform(
        F.filter(zipped, lambda x: x["len"].isNotNull()),
        lambda x: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), (x["size"] >= least).alias("ok")),
    )
    empty = F.array().cast("array<struct<gap:int,len:int,ok:boolean>>")
    return F.when(text.rlike(pattern), kept).otherwise(empty)


BARE = [k[0] for k in KINDS].index("bare")


def _parts(docs: DataFrame, text_column: str, keep: list[Column]) -> DataFrame:
    """The columns ``keep``, a number for each row (rid) and the pieces of each kind (k0, k1, ..), stored."""
    read = docs.select(*keep, text_of(text_column).alias("t__"), F.monotonically_increasing_id().alias("rid"))
    t, kept = F.col("t__"), [c for c in read.columns if c != "t__"]
    return written(read.select(*kept, *[_pieces(t, p, g, n).alias(f"k{i}") for i, (_, p, g, n, _) in enumerate(KINDS)]), "secret-parts")


def linked_spans(table: DataFrame, scope: int) -> DataFrame:
    """(rid, start, kind_no, kind, end, strong) from a table of ``_parts``.

    Positions are code points, end exclusive. A weak part is given out only if a
    complementary part (a secret for an identifier or an endpoint, either of
    those for a secret) lies within ``scope`` code points of it and does not
    overlap it. A bare key that overlaps any other part is no part of its own.
    """
    each = F.array(*[F.struct(F.lit(i).alias("kind_no"), F.col(f"k{i}").alias("found")) for i in range(len(KINDS))])
    parts = (
        table.select("rid", F.explode(F.filter(each, lambda x: F.size(x["found"]) > 0)).alias("x"))
        .select("rid", F.col("x.kind_no").alias("kind_no"), F.posexplode("x.found").alias("i", "m"))
        .select("rid", "kind_no", "i", "m.gap", "m.len", "m.ok", F.struct("rid", "kind_no").alias("own"))
    )
    before = F.coalesce(F.sum(F.col("gap") + F.col("len")).over(running("own", F.col("i"))), F.lit(0))
    start = (before + F.col("gap")).cast("long")
    placed = parts.select("rid", "kind_no", "ok", start.alias("start"), (start + F.col("len")).alias("end")).filter("ok").drop("ok")
    by_start = Window.partitionBy("rid").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    from_end = Window.partitionBy("rid").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    named = F.col("kind_no") != BARE
    covered = (F.max(F.when(named, F.col("end"))).over(by_start) > F.col("start")) | (F.min(F.when(named, F.col("start"))).over(from_end) < F.col("end"))
    placed = placed.withColumn("covered", F.coalesce(covered, F.lit(False))).filter(named | ~F.col("covered")).drop("covered")
    role = F.element_at(F.array(*[F.lit(k[4]) for k in KINDS]), F.col("kind_no") + 1)
    # The interval join: a document's starts and ends in order. The last end that comes before a start, and
    # the first start that comes after an end, are the nearest parts of a role outside it.
    ends = F.array(*[F.struct(F.lit(e).alias("is_end"), F.col("end" if e else "start").alias("pos")) for e in (False, True)])
    points = placed.withColumn("role", role).select("*", F.explode(ends).alias("p")).select("*", "p.is_end", "p.pos")
    up = running("rid", F.col("pos"), F.col("is_end").desc(), F.col("kind_no"))
    down = running("rid", F.col("pos").desc(), F.col("is_end"), F.col("kind_no"))
    near = F.lit(False)
    for own, others in COMPLETES.items():
        other = F.col("role").isin(others)
        left = F.col("pos") - F.max(F.when(other & F.col("is_end"), F.col("pos"))).over(up) <= scope
        right = F.min(F.when(other & ~F.col("is_end"), F.col("pos"))).over(down) - F.col("pos") <= scope
        near = F.when(F.col("role") == own, F.coalesce(F.when(F.col("is_end"), right).otherwise(left), F.lit(False))).otherwise(near)
    whole = points.withColumn("near", near).groupBy("rid", "kind_no", "start", "end").agg(F.max("near").alias("near"))
    strong = F.col("kind_no") < len(STRONG)
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind_no") + 1)
    return whole.filter(strong | F.col("near")).select("rid", "start", "kind_no", name.alias("kind"), "end", strong.alias("strong"))


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = 200) -> DataFrame:
    """One row for each input row: doc_id, counts and a digest of the strong spans, all spans.

    A null or empty text has no spans, zero counts and the digest of the empty
    string. Repeated rows and null ids give a row each; ids are of any type. An
    empty table gives an empty result. Other columns of the input are ignored.
    """
    table = _parts(docs, text_column, [F.col(f"`{id_column}`").alias("doc_id")])
    found = linked_spans(table, scope)
    count = lambda i: F.sum((F.col("kind_no") == i).cast("long"))
    by_row = found.groupBy("rid").agg(
        *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(STRONG)],
        F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "kind", "strong"))).alias("s"),
    )
    line = lambda a: F.array_join(
        F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    base = F.coalesce(line(F.filter("s", lambda x: x["strong"])), F.lit(""))
    return table.select("rid", "doc_id").join(by_row, "rid", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k[0]}", F.lit(0).cast("long")).alias(f"n_{k[0]}") for k in STRONG],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.coalesce(line(F.col("s")), F.lit("")).alias("spans"),
    )


def redact_secrets(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = 200, mark: str = "[REDACTED]"
) -> DataFrame:
    """The input rows with every span in the text replaced by ``mark``; all columns stay, n_chars follows the text.

    Overlapping spans become one mark. Only rows that hold a span change; a null
    text stays null; columns of any name are allowed. Only texts that hold a part
    are shuffled to meet their marks.
    """
    table = _parts(docs, text_column, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")])
    # Merge overlapping spans: a span opens a new mark when it starts at or after all ends before it.
    up = running("rid", F.col("start"), F.col("end"))
    reach = F.max("end").over(up)
    opened = F.when(reach.isNull() | (F.col("start") >= reach), F.lit(1)).otherwise(F.lit(0))
    group = F.sum("opened").over(running("rid", F.col("start"), F.col("end")))
    marked = linked_spans(table, scope).withColumn("opened", opened)
    marked = marked.withColumn("g", F.coalesce(group, F.lit(0)) + F.col("opened"))
    merged = marked.groupBy("rid", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    by_row = merged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    field = lambda c: F.col("row")[c]
    n, t = F.size("s"), field(text_column)
    piece = lambda x, i: F.concat(
        F.lit(mark),
        F.substring(t, (x["end"] + 1).cast("int"), (F.when(i + 1 < n, F.get("s", i + 1)["start"]).otherwise(F.length(t)) - x["end"]).cast("int")),
    )
    clean = F.concat(F.substring(t, F.lit(1), F.get("s", F.lit(0))["start"].cast("int")), F.array_join(F.transform("s", piece), ""))
    some = F.lit(False)
    for i in range(len(KINDS)):
        some = some | F.exists(f"k{i}", lambda x: x["ok"])
    rest = table.filter(some).select("rid", "row").join(by_row, "rid", "left").withColumn("clean", F.when(F.col("s").isNotNull(), clean))
    changed = F.col("clean").isNotNull()
    new = {text_column: F.when(changed, F.col("clean")).otherwise(t)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("clean")).otherwise(field("n_chars")).cast(docs.schema["n_chars"].dataType)
    rest = rest.select(*[new.get(c, field(c)).alias(c) for c in docs.columns])
    return table.filter(~some).select(*[field(c).alias(c) for c in docs.columns]).unionByName(rest)
