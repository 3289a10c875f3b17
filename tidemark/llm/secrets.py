"""Secret scans: spans by pattern, and who else in the corpus owns the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import meet, row_key, stage

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"
OWNED = r"([A-Za-z0-9+/_=-]{20,})"

#: kind, its place among spans of one start, pattern, the group that is the value, least length of the value.
#: Runs of 24 or more hex digits are the long ones among all runs, as a run has no end before its last digit.
KINDS = (("assign", 0, ASSIGN, 2, 6), ("access", 1, ACCESS, 1, 20), ("hex", 2, HEX, 1, 24))
TOKEN = ("owned", 3, OWNED, 1, 20)
SPAN = "array<struct<start:int,no:int,end:int,kind:string,hash:long>>"
MATCH = "array<struct<no:int,pos:int,gap:int,width:int,good:boolean,hash:long>>"


def _matches(text: Column, kind: str, no: int, pattern: str, group: int, least: int) -> Column:
    """All leftmost matches that do not overlap, in order: the width of each and of the gap before it, from split."""
    of_group = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), of_group(0).alias("m"), of_group(group).alias("v"))
    both = F.filter(zipped, lambda x: x["m"].isNotNull())  # one more text lies behind the last match

    def one(x: Column, i: Column) -> Column:
        good = F.char_length(x["v"]) >= least
        if kind == TOKEN[0]:
            good = good & _live_looking(x["v"])
        return F.struct(F.lit(no).alias("no"), i.alias("pos"), F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("width"), good.alias("good"), F.xxhash64(x["v"]).alias("hash"))

    return F.when(text.rlike(pattern), F.transform(both, one)).otherwise(F.array()).cast(MATCH)


def _live_looking(text: Column) -> Column:
    """Long tokens of letters and digits both, in mixed use."""
    return text.rlike("[0-9]") & text.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(text, ""))) >= 10)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    example_owners: int = 3,
    example_documents: int = 1000,
) -> DataFrame:
    """Per document row: id, counts by kind, `base` and `spans` (arrays of spans), `n_live`, `n_example`.

    Every value's hash is counted over the corpus by distinct documents (repositories: distinct
    ids; rows without an id by their text) and owners. A value of `example_owners` or more owners,
    or in `example_documents` or more documents whoever holds them, is an `example`; any other is
    `live`, so one that two owners share is too. Beside the base kinds, tokens of 20 characters or
    more that have letters, digits and ten different characters, overlap no base span, are held by
    exactly one owner and are no example are added as kind `owned`; base spans stay whatever their
    verdict. A row a match carries no text: a document's places are running sums over its matches,
    overlaps a running maximum, so that work grows with the matches (times the logarithm, for
    the sort). Counts are combined before they move; a value in a third of all rows is
    broadcast, not shuffled.

    Positions are code points, ends exclusive. Null text: no spans. A null owner is an owner of
    its own. Repeated rows of an id are one document with equal results. Rows that agree in id and
    text, but not in owner, count for each owner. An empty table gives an empty table.
    """
    k1, k2 = row_key(docs, id_col, text_col)
    text = F.coalesce("_text", F.lit(""))
    slim = docs.select(docs[id_col].alias("_id"), k1, k2, docs[owner_col].alias("_owner"), docs[text_col].cast("string").alias("_text"))
    found = slim.select("_id", "_k1", "_k2", "_owner", F.concat(*[_matches(text, *kind) for kind in (*KINDS, TOKEN)]).alias("_m"))
    found = stage(found, "secret-matches").filter(F.size("_m") > 0)

    of_doc = Window.partitionBy("_k1", "_k2")
    matches = found.select("_k1", "_k2", F.explode("_m").alias("_m")).select("_k1", "_k2", "_m.*").distinct()
    end = F.sum(F.col("gap") + F.col("width")).over(Window.partitionBy("_k1", "_k2", "no").orderBy("pos")).cast("int")
    placed = matches.withColumn("end", end).withColumn("start", F.col("end") - F.col("width")).filter("good")
    is_base = F.col("no") < TOKEN[1]
    before = F.max(F.when(is_base, F.col("end"))).over(of_doc.orderBy("start"))
    after = F.min(F.when(is_base, F.col("start"))).over(of_doc.orderBy(F.desc("start")))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in (*KINDS, TOKEN)]), F.col("no") + 1)
    span = F.struct("start", "no", "end", kind.alias("kind"), F.col("hash"))
    spans = placed.withColumn("_free", free).filter(is_base | F.col("_free")).select("_k1", "_k2", span.alias("_span"), F.col("hash").alias("_hash"))
    spans = stage(spans, "secret-spans")

    holders = found.select("_k1", "_k2", "_owner", F.struct("_id", F.when(F.col("_id").isNull(), F.col("_k1"))).alias("_doc")).distinct()
    values = spans.select("_k1", "_k2", "_hash").distinct().join(holders, ["_k1", "_k2"]).select("_hash", "_owner", "_doc").distinct()
    owners = (
        values.groupBy("_hash", "_owner")
        .agg(F.count("*").alias("_docs"))
        .groupBy("_hash")
        .agg(F.count("*").alias("_owners"), F.sum("_docs").alias("_repositories"))
    )
    judged = meet(spans, stage(owners, "secret-owners"), ["_hash"], "_repositories")
    judged = judged.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("_span", "_owners", "_repositories")).alias("_judged"))
    seen = slim.select("_id", "_k1", "_k2").join(judged, ["_k1", "_k2"], "left")
    in_base = lambda x: x["_span"]["no"] < TOKEN[1]
    is_example = lambda x: (x["_owners"] >= example_owners) | (x["_repositories"] >= example_documents)
    kept = lambda cond: F.coalesce(F.sort_array(F.transform(F.filter("_judged", cond), lambda x: x["_span"])), F.array().cast(SPAN))
    seen = seen.withColumn("base", kept(in_base)).withColumn("spans", kept(lambda x: in_base(x) | ((x["_owners"] == 1) & ~is_example(x))))
    count = lambda cond: F.coalesce(F.size(F.filter("_judged", cond)), F.lit(0)).cast("long")
    of_kind = lambda no: F.size(F.filter("base", lambda x: x["no"] == no)).cast("long")
    kinds = [of_kind(no).alias(f"n_{name}") for name, no, *_ in KINDS]
    return seen.select(
        F.col("_id").alias(id_col),
        *kinds,
        "base",
        "spans",
        count(lambda x: in_base(x) & ~is_example(x)).alias("n_live"),
        count(lambda x: in_base(x) & is_example(x)).alias("n_example"),
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col,
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
    )
