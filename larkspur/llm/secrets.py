"""Secret scans with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The base kinds in their order, with the group that holds the secret and the least length of it.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What may be a credential without saying so: long runs with capitals and digits.
GENERIC = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}"
LIVE = "live"

SPANS = "array<struct<start:long,ord:int,end:long,kind:string>>"


def _matches(text: Column, order: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches as (ord, i, gap, len, hash, ok): the lengths of the text since the match before and of the match."""
    hits, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("g"), hits.alias("m"), values.alias("v")), lambda z: z["m"].isNotNull())
    found = F.transform(
        zipped,
        lambda z, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("len"), F.xxhash64(z["v"]).alias("hash"), (F.length(z["v"]) >= least).alias("ok")),
    )
    kind = "array<struct<ord:int,i:int,gap:int,len:int,hash:long,ok:boolean>>"
    return F.when(F.regexp_like(text, F.lit(pattern)), found.cast(kind)).otherwise(F.array().cast(kind))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@dataclass(frozen=True)
class Params:
    max_repos: int = 3  # a generic candidate in more repositories is none of a single project
    max_owners: int = 1  # and of more owners no one's own
    wide_owners: int = 3  # a base value of so many owners is an example
    wide_repos: int = 20  # or of so many repositories


def scan(docs: DataFrame, repo: Column | str = "text", owner: Column | str = "source", p: Params = Params()) -> DataFrame:
    """One row per row of docs: doc_id, base and spans (start, ord, end, kind), n_example, n_owned.

    Hashes of the values of all base spans and generic candidates are counted over the corpus by distinct repository and
    owner (first by value, owner and repository, so copies collapse before the counts meet). A generic candidate that
    ``max_repos`` repositories of ``max_owners`` owners at most have, and that overlaps no base span, becomes a span of
    kind ``live``; a base span that ``wide_owners`` owners or ``wide_repos`` repositories have is an example, else it is
    owner-specific. Base spans all stay. Repositories count within their owner and are told apart by a 64-bit hash.

    A table of documents names no repository: unless given, a distinct text is one (so exact copies of a document are not
    wide use), and its source is the owner. Null text is empty. Null repositories or owners count together as one.
    Repeated rows each get their result, as do null doc_ids. All steps are linear in the spans, also of one text.
    """
    text = F.coalesce("text", F.lit(""))
    named = lambda c: F.xxhash64(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))
    kinds = [*KINDS, (LIVE, GENERIC, 0, 24)]
    finds = F.concat(*[_matches(text, i, pattern, g, n) for i, (_, pattern, g, n) in enumerate(kinds)])
    table = written(docs.select("doc_id", named(repo).alias("repo"), named(owner).alias("owner"), F.monotonically_increasing_id().alias("row"), finds.alias("finds")), "secrets")
    in_kind, in_row = Window.partitionBy("row", "ord").orderBy("i"), Window.partitionBy("row").orderBy("start", "ord")
    base = F.col("ord") < len(KINDS)
    placed = (
        table.where(F.size("finds") > 0).select("row", "repo", "owner", F.inline("finds")).repartition("row")
        .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(in_kind)).withColumn("start", F.col("end") - F.col("len")).where("ok")
        .withColumn("before", F.max(F.when(base, F.col("end"))).over(in_row.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("after", F.min(F.when(base, F.col("start"))).over(in_row.rowsBetween(0, Window.unboundedFollowing)))
        .where(base | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))))
        .select("row", "repo", "owner", "start", "ord", "end", "hash")
    )
    placed = written(placed, "secret-spans")
    counts = (
        placed.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner").agg(F.count("one").alias("repos"))
        .groupBy("hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))
    )
    known = placed.join(written(counts, "secret-owners"), "hash")
    own = base | ((F.col("repos") <= p.max_repos) & (F.col("owners") <= p.max_owners))
    example = (F.col("owners") >= p.wide_owners) | (F.col("repos") >= p.wide_repos)
    span = F.struct("start", "ord", "end", F.element_at(F.array(*[F.lit(k) for k, *_ in kinds]), F.col("ord") + 1).alias("kind"))
    by_row = known.where(own).groupBy("row").agg(
        F.array_sort(F.collect_list(span)).alias("spans"),
        F.count(F.when(base & example, 1)).alias("n_example"),
        F.count(F.when(base & ~example, 1)).alias("n_owned"),
    )
    spans = F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    return table.select("row", "doc_id").join(by_row, "row", "left").select(
        "doc_id", F.filter(spans, lambda s: s["ord"] < len(KINDS)).alias("base"), spans, F.coalesce("n_example", F.lit(0)).alias("n_example"), F.coalesce("n_owned", F.lit(0)).alias("n_owned")
    )


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k, *_ in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_example", "n_owned",
        F.size(F.filter("spans", lambda s: s["kind"] == LIVE)).cast("long").alias("n_live"),
    )


def _either(word: str) -> str:
    """The word with its letters in either case, for an engine whose own flag folds other letters into these."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _sql() -> str:
    names = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = [(rf"""({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("AKIA[A-Z0-9]{16,}", 0, 20), ("[0-9a-f]{24,}", 0, 24), ("[A-Za-z0-9+/_-]{24,}", 0, 24)]
    kinds = [*(k for k, *_ in KINDS), LIVE]
    found = " UNION ALL ".join(
        f"SELECT row, {i} AS ord, '{kinds[i]}' AS kind, {least} AS least, unnest(range(len(regexp_extract_all(t, '{p}')))) AS i, unnest(regexp_extract_all(t, '{p}')) AS m,"
        f" unnest(regexp_extract_all(t, '{p}', {g})) AS v, unnest(string_split_regex(t, '{p}')) AS g FROM d"
        for i, (p, g, least) in enumerate(patterns)
    )
    rule = Params()
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents),
f AS ({found}),
p AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY row, ord ORDER BY i) AS stop FROM f WHERE m IS NOT NULL),
a AS (SELECT row, ord, kind, v, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p
      WHERE length(v) >= least AND (ord < 3 OR (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')))),
s AS (SELECT * FROM a WHERE ord < 3 OR NOT EXISTS (SELECT 1 FROM a b WHERE b.row = a.row AND b.ord < 3 AND b.start < a.stop AND a.start < b.stop)),
c AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, t)) AS repos FROM s JOIN d USING (row) GROUP BY v),
k AS (SELECT s.*, owners >= {rule.wide_owners} OR repos >= {rule.wide_repos} AS example FROM s JOIN c USING (v)
      WHERE ord < 3 OR (repos <= {rule.max_repos} AND owners <= {rule.max_owners})),
r AS (SELECT row, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
             count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             count(*) FILTER (ord = 3) AS n_live, count(*) FILTER (ord < 3 AND example) AS n_example, count(*) FILTER (ord < 3 AND NOT example) AS n_owned
      FROM k GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example, coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN r USING (row)
"""


OP2_SQL = _sql()
