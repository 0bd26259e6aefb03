"""Secret scans: strong patterns, and parts of credentials that count only together.

Strong spans are reported wherever they are. Identifiers, weak secrets and
endpoints are each too common to report alone. They are joined as intervals
within their scope, a block of lines without a blank one, in one pass over a
document's spans and breaks in order, so no pairs are formed. A weak part is
reported if its block has a complementary one, however far apart they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealmargin.llm.columns import let, text_or_empty
from dealmargin.operators.joins import settle

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_PREFIX = r"(?<![A-Za-z0-9_])(?:[A-Za-z0-9_]*_)?"  # of names such as db_user
ASSIGN = rf"(?i:password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
IDENTIFIER = (
    rf"{_PREFIX}(?i:client_?id|access_?key_?id|account(?:_?id)?|user(?:_?name)?|login)"
    rf"{_VALUE}[A-Za-z0-9._@-]{{3,}}"
)
WEAK_SECRET = (
    rf"{_PREFIX}(?i:pwd|pass(?:phrase)?|private_?key|signature|credential){_VALUE}[^\s\"']{{6,}}"
    r"|(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])"
    r"[A-Za-z0-9+/_-]{32,64}(?![A-Za-z0-9+/=_-])"
)
ENDPOINT = (
    r"(?<![A-Za-z0-9_])(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+"
)
# Possessive, as a group repeated very often would otherwise exhaust the stack.
BREAK = r"\n(?:[ \t]*+\n)++"
#: Kinds in the order that settles equal starts; the first three are strong.
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
_ROLE = {
    "assign": "secret",
    "access": "identifier",
    "hex": "secret",
    "identifier": "identifier",
    "weak_secret": "secret",
    "endpoint": "endpoint",
}
_WEAK, _BREAK = KINDS.index("identifier"), len(KINDS)
_SPAN = "array<struct<start:int,rank:int,end:int>>"
_MATCHES = "array<struct<rank:int,gap:int,size:int,fits:boolean>>"


def _measured(text: Column, pattern: str, rank: int, least_value: int = 0) -> Column:
    """Leftmost non-overlapping matches, each as the gap before it and its size in code points.

    What lies between the matches gives their places, since no function tells
    them. fits is false where the match's first group is shorter than least_value.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    values = F.regexp_extract_all(text, F.lit(pattern), 1) if least_value else matches
    measured = F.zip_with(
        F.split(text, pattern, -1),
        F.arrays_zip(matches.alias("m"), values.alias("v")),
        lambda gap, m: F.struct(
            F.lit(rank).alias("rank"),
            F.length(gap).alias("gap"),
            F.length(m["m"]).alias("size"),
            F.coalesce(F.length(m["v"]) >= least_value, F.lit(False)).alias("fits"),
        ),
    )
    matched = F.filter(measured, lambda m: m["size"].isNotNull())
    return F.when(text.rlike(pattern), matched).otherwise(F.array().cast(_MATCHES))


def _gated(text: Column, hint: str, matches: Column) -> Column:
    return F.when(F.contains(text, F.lit(hint)), matches).otherwise(F.array().cast(_MATCHES))


def _placed(matches: DataFrame) -> DataFrame:
    """Matches of rows with start and end, those that fit.

    Places are running sums over a row's matches of one kind, so the work grows
    with their number.
    """
    before = Window.partitionBy("_row", "rank").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    end = F.sum(F.col("gap") + F.col("size")).over(before).cast("int")
    return (
        matches.withColumn("end", end)
        .where("fits")
        .select("_row", "rank", (F.col("end") - F.col("size")).alias("start"), "end")
    )


def _linked(spans: DataFrame) -> DataFrame:
    """The strong spans and breaks of rows, and the weak ones whose block has a complement.

    In order of their starts, a running count of breaks numbers the blocks, and
    the strong spans' greatest end so far and next start tell which weak parts
    are of their text. Within a block windows know which roles it has.
    """
    order = Window.partitionBy("_row").orderBy("start", "rank")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    strong, weak = F.col("rank") < _WEAK, F.col("rank").between(_WEAK, _BREAK - 1)
    ended = F.max(F.when(strong, F.col("end"))).over(so_far)
    next_start = F.last(F.when(strong, F.col("start")), ignorenulls=True).over(later)
    inside = F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(
        next_start < F.col("end"), F.lit(False)
    )
    parts = spans.select(
        "*",
        F.count_if(F.col("rank") == _BREAK).over(so_far).alias("_scope"),
        (weak & inside).alias("_inside"),
        F.get(F.array(*[F.lit(_ROLE[k]) for k in KINDS]), F.col("rank")).alias("_role"),
    ).where(~F.col("_inside"))
    block = Window.partitionBy("_row", "_scope")
    near = {r: F.max(F.col("_role") == r).over(block) for r in ("identifier", "secret", "endpoint")}
    met = parts.withColumns({f"_near_{r}": present for r, present in near.items()})
    complemented = F.when(
        F.col("_role") == "secret", F.col("_near_identifier") | F.col("_near_endpoint")
    ).otherwise(F.col("_near_secret"))
    return met.where(strong | (weak & complemented))


def secret_spans(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: its id, text_hash, strong and weak spans as (start, rank, end).

    rank is the kind's place in KINDS; positions are code points, ends are
    exclusive, spans are in order of start and rank. A weak identifier counts
    with a secret in its scope, a weak secret with an identifier or endpoint, an
    endpoint with a secret; strong spans take part. A weak part that is a strong
    span's own text counts as that span and is not reported again.

    NULL texts are empty and have no spans. Rows that repeat an id are told
    apart by text_hash (xxhash64); identical rows give identical results.
    Other columns are left aside; no rows give no rows.
    """
    body = text_or_empty(F.col(text_column))
    weak = F.concat(
        _measured(body, IDENTIFIER, 3),
        _measured(body, WEAK_SECRET, 4),
        _gated(body, "://", _measured(body, ENDPOINT, 5)),
    )
    kept = settle(
        docs.select(
            F.col(id_column).alias("_id"),
            F.xxhash64(F.col(text_column)).alias("text_hash"),
            F.monotonically_increasing_id().alias("_row"),
            F.concat(
                _measured(body, ASSIGN, 0, ASSIGN_VALUE),
                _gated(body, "AKIA", _measured(body, ACCESS, 1)),
                _measured(body, HEX, 2),
            ).alias("_strong"),
            weak.alias("_weak"),
            _measured(body, BREAK, _BREAK).alias("_breaks"),
        ).withColumn("_breaks", F.when(F.size("_weak") > 0, F.col("_breaks")).otherwise(F.array()))
    ).rows
    # By row alone, so that the windows by row and kind or block need no shuffle of their own.
    matches = (
        kept.select("_row", F.posexplode(F.concat("_strong", "_weak", "_breaks")).alias("_at", "_m"))
        .select("_row", "_at", "_m.*")
        .repartition("_row")
    )
    span = F.struct("start", "rank", "end")
    of_row = _linked(_placed(matches)).groupBy("_row").agg(
        *[
            F.sort_array(F.collect_list(F.when(kind, span))).alias(name)
            for name, kind in (("strong", F.col("rank") < _WEAK), ("weak", F.col("rank") >= _WEAK))
        ]
    )
    none = F.array().cast(_SPAN)
    return kept.join(of_row, "_row", "left").select(
        F.col("_id").alias(id_column),
        "text_hash",
        F.coalesce("strong", none).alias("strong"),
        F.coalesce("weak", none).alias("weak"),
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in order of start and kind."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return let(
        kinds,
        lambda names: F.array_join(
            F.transform(
                F.sort_array(spans),
                lambda s: F.concat_ws(
                    ":",
                    F.get(names, s["rank"]),
                    s["start"].cast("string"),
                    s["end"].cast("string"),
                ),
            ),
            ",",
        ),
    )
