"""Secret scans with multipart credential linking: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stash


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Kinds in their order. The first three are certain by themselves, the others only next to a complementary part.
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
_ASSIGN = "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_IDENT = "(" + "|".join(_either_case(w) for w in ("client", "account", "access", "user", "tenant", "key")) + ")[_-]?(" + "|".join(_either_case(w) for w in ("id", "name")) + r""")["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.=-]{4,}"""
#: [0-9a-f]+ and AKIA[A-Z0-9]+ of a least length: a shorter run of these has no long enough part either.
PATTERNS = {
    "assign": _ASSIGN,
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "ident": _IDENT,
    "weak": "[A-Za-z0-9+/_=-]{20,}",
    "endpoint": r"[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9.:/_-]+",
}
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "ident": "id", "weak": "secret", "endpoint": "endpoint"}
ASSIGN_LEAST = 6
#: A blank line ends a scope. No pattern of a part holds a line break.
BLANK, _BLANK_LINE = len(KINDS), r"\n[\x20\t]*\r?\n"
#: Texts are cut at every so many code points, so that a place in the middle is found without reading up to it.
PIECE = 1024
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_MARK = "array<struct<kind:int,nth:int,skip:int,size:int,keep:boolean>>"


def _marks(text: Column, kind: int) -> Column:
    """All matches of a kind in order: how far each lies behind the last one, its length, and whether it counts."""
    name, pattern = (KINDS[kind], PATTERNS[KINDS[kind]]) if kind < BLANK else ("blank", _BLANK_LINE)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit")]
    if name == "assign":
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))

    def keep(x):
        if name == "assign":
            return F.length(x["value"]) >= ASSIGN_LEAST
        if name == "weak":
            return x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]")
        return F.lit(True)

    one = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("skip"), F.length(x["hit"]).alias("size"), keep(x).alias("keep"))
    return F.when(text.rlike(pattern), F.transform(F.arrays_zip(*parts), one)).otherwise(F.array().cast(_MARK))


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, h, marks) of each row of docs: matches of every kind, and blank lines where parts could link.

    h is a hash of the text, row a number of the row; only lengths leave the scan.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("h"), text.alias("t"))
    rows = rows.select("row", "doc_id", "h", "t", *[_marks(F.col("t"), k).alias(n) for k, n in enumerate(KINDS)])
    blank = F.when(F.size("ident") + F.size("weak") + F.size("endpoint") > 0, _marks(F.col("t"), BLANK)).otherwise(F.array().cast(_MARK))
    return rows.select("row", "doc_id", "h", F.concat(*KINDS, blank).alias("marks"))


def _off(spans: DataFrame, target: Column, blocker: Column) -> DataFrame:
    """spans without the targets that overlap a blocker of their row.

    A sweep each way: of the blockers that start no later the one that reaches furthest, and the next that starts
    no earlier, tell. Of equal starts blockers come first.
    """
    up = Window.partitionBy("row").orderBy("start", target, "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start"), target, "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = spans.withColumn("reach", F.max(F.when(blocker, F.col("end"))).over(up)).withColumn("next", F.min(F.when(blocker, F.col("start"))).over(down))
    hit = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return swept.where(~(target & hit)).drop("reach", "next")


def place(found: DataFrame) -> DataFrame:
    """(row, start, kind, end, scope) of the marks that count, parts off the certain spans only.

    Positions are running sums, so a text of any number of matches takes one ordered pass. The scope is the number
    of blank lines before.
    """
    marks = found.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    behind = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    spans = marks.withColumn("end", F.sum(F.col("skip") + F.col("size")).over(behind).cast("int")).where("keep")
    spans = spans.select("row", (F.col("end") - F.col("size")).alias("start"), "kind", "end")
    kind = F.col("kind")
    spans = _off(spans, kind.isin(KINDS.index("ident"), KINDS.index("endpoint")), kind < 3)
    spans = _off(spans, kind == KINDS.index("weak"), (kind != KINDS.index("weak")) & (kind != BLANK))
    so_far = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return spans.withColumn("scope", F.count(F.when(kind == BLANK, 1)).over(so_far)).where(kind != BLANK)


def link(spans: DataFrame) -> DataFrame:
    """The certain spans, and the weak parts whose scope holds a part of another role, one of the two being a secret.

    The interval join of parts and scopes: both stand in one order, so a part falls into the scope that is open
    where it starts, and a scope needs to tell only which roles it holds. No pairs arise.
    """
    roles = F.array(*[F.lit(ROLES[k]) for k in KINDS])
    spans = spans.withColumn("role", F.element_at(roles, F.col("kind") + 1))
    within = Window.partitionBy("row", "scope")
    holds = lambda *names: F.max(F.col("role").isin(*names)).over(within)
    spans = spans.withColumn("secret", holds("secret")).withColumn("other", holds("id", "endpoint"))
    complete = F.when(F.col("role") == "secret", F.col("other")).otherwise(F.col("secret"))
    return spans.where((F.col("kind") < 3) | complete).select("row", "start", "kind", "end")


def _found(docs: DataFrame) -> DataFrame:
    """find_secrets, with cuts for mask: where a stretch of spans starts and the one before it ends, and the last end."""
    rows = stash(scan(docs))
    linked = link(place(rows.where(F.size("marks") > 0)))
    before = F.coalesce(F.max("end").over(Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    linked = linked.withColumn("from", before)
    span, cut = F.struct("start", "kind", "end"), F.struct(F.col("start").alias("to"), "from")
    by_row = linked.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") < 3, span))).alias("base"),
        F.sort_array(F.collect_list(span)).alias("spans"),
        F.sort_array(F.collect_list(F.when(F.col("start") >= F.col("from"), cut))).alias("cuts"),
        F.max("end").alias("last"),
    )
    none = F.array().cast(_SPAN)
    out = rows.select("row", "doc_id", "h").join(by_row, "row", "left")
    return out.select("doc_id", "h", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"), "cuts", "last")


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, h, base, spans) of each row of docs; spans hold start, kind (index in KINDS) and end in code points.

    base has the certain kinds, each leftmost and without overlaps within a kind; spans also has the weak parts
    that link to a complementary part. Null text counts as empty and has no spans. Rows that are alike get the
    same result, each its own row; a null doc_id is a value like another. Other columns are ignored, and an
    empty table gives an empty result. Only positions leave the scan.
    """
    return _found(docs).select("doc_id", "h", "base", "spans")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(docs: DataFrame, by: str = "<SECRET>") -> DataFrame:
    """docs with each stretch of secret spans in text replaced, and n_chars, if there, of the new text.

    Overlapping spans are one stretch. Rows without spans stay as they are, null and empty text too; rows that are
    alike get the same text, and a null doc_id is a value like another. Work and memory grow with a text's length.
    """
    d, h, c, e, g, p = fresh(docs, "span_doc", "span_hash", "span_cuts", "span_last", "text_hash", "text_pieces")
    spans = _found(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias(d), F.col("h").alias(h), F.col("cuts").alias(c), F.col("last").alias(e)).distinct()
    rows = docs.withColumn(g, F.xxhash64("text")).join(spans, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(g) == F.col(h)), "left")
    rows = rows.withColumn(p, F.when(F.col(c).isNotNull(), F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def part(start, end):
        """Code points start to end, from the pieces that hold them."""
        first = F.floor(start / PIECE).cast("int")
        held = F.slice(p, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1)
        return F.when(end > start, F.substring(F.array_join(held, ""), start - first * PIECE + 1, end - start)).otherwise("")

    cut = F.concat(F.array_join(F.transform(c, lambda x: F.concat(part(x["from"], x["to"]), F.lit(by))), ""), part(F.col(e), F.length("text")))
    rows = rows.withColumn("text", F.when(F.col(c).isNotNull(), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(c).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)
