"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Each kind's matches and the text between them give spans. The hash of every candidate value is counted over
distinct repositories and owners: a value seen under several owners is a widely copied example, one that stays
with its owner looks live. Long mixed tokens that stay with one owner are added as spans of kind `owned`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, join_by_key, materialize, with_row

#: Kind -> (pattern, group of the value, least characters of that group), in the order of the kinds.
#: For access and hex the least length is in the pattern, as a run that is long enough matches from the same place.
KINDS = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
    "owned": ("[A-Za-z0-9_-]{20,}", 0, 20),
}
#: A token of kind owned has a digit and a letter: each is looked for by itself, so that long tokens take linear time.
MIXED = ["[0-9]", "[A-Za-z]"]


def _matches(kind: str) -> Column:
    """array<struct<gap, size, value>>: characters since the last match, of the match, and the value."""
    pattern, group, _ = KINDS[kind]
    text, pat = F.col("text"), F.lit(pattern)
    whole = F.regexp_extract_all(text, pat, F.lit(0))
    zipped = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), F.length).alias("gap"),
        F.transform(whole, F.length).alias("size"),
        F.regexp_extract_all(text, pat, F.lit(group)).alias("value"))
    return F.when(text.rlike(pattern), zipped).otherwise(F.expr("cast(array() as array<struct<gap:int,size:int,value:string>>)"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 1, max_repos: int = 3) -> DataFrame:
    """One row per input row: id, and the arrays base and extra of struct(start, kind_no, kind, stop, n_repos, n_owners, live).

    A value is live-looking if it is in at most max_owners owners and max_repos repositories. Positions are code
    points, the end exclusive. Null texts are empty; null owners are one owner, null repositories one repository.
    Rows that repeat are scanned each for itself, and count once per repository. Very long texts are scanned whole. No rows
    give no rows. Other columns are ignored.
    """
    used = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{repo_col}`").cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")).alias("owner"))
    rows = materialize(with_row(used).select(ROW, "id", "repo", "owner", *(_matches(k).alias(k) for k in KINDS)), "matches")
    before = Window.partitionBy(ROW).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def spans(no: int, kind: str) -> DataFrame:
        one = rows.where(F.size(kind) > 0).select(ROW, "repo", "owner", F.posexplode(kind).alias("pos", "m"))
        one = one.withColumn("stop", F.sum(F.col("m.gap") + F.col("m.size")).over(before))
        one = one.where(F.length("m.value") >= KINDS[kind][2])
        if kind == "owned":
            one = one.where(F.col("m.value").rlike(MIXED[0]) & F.col("m.value").rlike(MIXED[1]))
        return one.select(ROW, "repo", "owner", F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), (F.col("stop") - F.col("m.size")).alias("start"), "stop", F.sha2(F.col("m.value").cast("binary"), 256).alias("hash"))

    found = materialize(reduce(DataFrame.unionByName, (spans(i, k) for i, k in enumerate(KINDS))), "candidates")
    by_owner = found.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    seen = by_owner.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))
    judged = join_by_key(found, seen, ["hash"]).withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    span = F.struct("start", "kind_no", "kind", "stop", "n_repos", "n_owners", "live")
    by_row = judged.where((F.col("kind") != "owned") | F.col("live")).groupBy(ROW).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).alias("kind_no"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("n_repos"), F.lit(0).cast("long").alias("n_owners"), F.lit(False).alias("live"))), 1, 0)
    out = rows.select(ROW, "id").join(by_row, ROW, "left").withColumn("spans", F.coalesce("spans", none))
    base = F.filter("spans", lambda s: s["kind"] != "owned")
    # an added span within a base span says nothing new
    extra = F.filter("spans", lambda s: (s["kind"] == "owned") & ~F.exists(F.col("base"), lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"])))
    return out.withColumn("base", base).withColumn("extra", extra).select("id", "base", "extra")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_digest(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_example (base spans by verdict). See secret_spans()."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return secret_spans(docs, id_col, **how).select(
        F.col("id").alias(id_col), *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "extra"))).alias("spans"),
        F.size(F.filter("base", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("base", lambda s: ~s["live"])).cast("long").alias("n_example"))
