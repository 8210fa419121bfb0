"""Secrets in texts, told from copied examples by who owns them.

Three base patterns give spans that always count. A wider pattern gives further
candidates, which count only if their value is owner-specific: over the whole
corpus, its digest occurs with one owner, and in so few repositories that it was not
copied from one to the next. The same frequencies sort base values into widely
copied examples (many owners, or many repositories) and those that look live. Everything is DataFrame
functions; the only rows that are shuffled are digests, owners and spans.

Spans are code points, end exclusive. Defined results: a null text is empty;
a null owner or repository is the empty name; a row without spans has zero
counts, an empty span list and the digest of the empty string; repeated rows
are reported once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, stored

# Kinds in order, their patterns, the measured group, its least length.
BASE_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are matched whole, so shorter ones may be left out at once
)
#: The added kind; a candidate also holds a letter and a digit and touches no base span.
ADDED = ("owned", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
#: From so many owners or repositories on, a value is a widely copied example.
WIDELY, WIDELY_KEPT = 3, 6
#: A value is owner-specific with one owner and up to so many repositories.
OWN_REPOSITORIES = 3


def spans_of(text: Column, number: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, number, kind, end, digest>> of the pattern's matches.

    Between n matches stand n + 1 gaps, so lengths alone give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.zip_with(F.split(text, pattern, -1), whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("own")))
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        F.slice(lengths, 1, F.size(whole)),
        begun,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["own"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts")
        ),
        lambda acc: acc["starts"],
    )
    rows = F.transform(
        F.arrays_zip(starts.alias("start"), whole.alias("whole"), value.alias("value")),
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(number).alias("number"),
            F.lit(kind).alias("kind"),
            (x["start"] + F.length(x["whole"])).alias("end"),
            x["value"].alias("value"),
        ),
    )
    long_enough = F.filter(rows, lambda x: F.length(x["value"]) >= least)
    digested = F.transform(
        long_enough, lambda x: F.struct(x["start"], x["number"], x["kind"], x["end"], F.unhex(F.sha2(x["value"], 256)).alias("digest"), x["value"])
    )
    kind_type = "array<struct<start:int,number:int,kind:string,end:int,digest:binary,value:string>>"
    return F.when(text.rlike(pattern), digested).otherwise(F.array()).cast(kind_type)


def printed(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def candidate_spans(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """(row, id, owner, repository, base, further): all spans of each row, written down once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = [spans_of(F.col("text"), n, *kind) for n, kind in enumerate(BASE_KINDS)]
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"), text.alias("text")
    )
    rows = rows.withColumn("base", F.concat(*base)).withColumn("further", spans_of(F.col("text"), len(base), *ADDED))
    mixed = F.filter(
        "further",
        lambda x: x["value"].rlike("[0-9]")
        & x["value"].rlike("[A-Za-z]")
        & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])),
    )
    bare = "array<struct<start:int,number:int,kind:string,end:int,digest:binary>>"

    def without_value(spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"], x["number"], x["kind"], x["end"], x["digest"])).cast(bare)

    return rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "owner", "repository", without_value(F.col("base")).alias("base"), without_value(mixed).alias("further")
    )


def owner_specific() -> Column:
    return (F.col("owners") == 1) & (F.col("repositories") <= OWN_REPOSITORIES)


def widely_copied() -> Column:
    return (F.col("owners") >= WIDELY) | (F.col("repositories") >= WIDELY_KEPT)


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories): distinct ones over all rows.

    Each step first adds up within tasks, so a value that a third of the rows
    hold costs one row per task, owner and repository.
    """
    values = found.select("owner", "repository", F.explode(F.concat("base", "further")).alias("span"))
    places = values.select("owner", "repository", F.col("span.digest").alias("digest")).distinct()
    by_owner = places.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def find_secrets(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """One row for each row of ``docs``: counts, spans and how its values are owned.

    most_owners and most_repositories are those of its most copied base value.
    """
    found = stored(candidate_spans(docs, id_col, text_col, owner, repository), "secret-spans")
    spans = found.select("row", F.explode(F.concat("base", "further")).alias("span")).select("row", "span", F.col("span.digest").alias("digest"))
    is_base = F.col("span.number") < len(BASE_KINDS)
    owned = spans.join(ownership(found).hint("merge"), "digest")
    judged = owned.groupBy("row").agg(
        F.collect_list(F.when(~is_base & owner_specific(), F.col("span"))).alias("added"),
        F.count_if(is_base & owner_specific()).alias("n_live"),
        F.count_if(is_base & widely_copied()).alias("n_copied"),
        F.max(F.when(is_base, F.col("owners"))).alias("most_owners"),
        F.max(F.when(is_base, F.col("repositories"))).alias("most_repositories"),
    )
    joined = found.join(judged, "row", "left")

    def number_of(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [number_of(kind) for kind, *_ in BASE_KINDS]
    none = F.lit(0).cast("long")
    return joined.select(
        F.col("id").alias(id_col),
        *count,
        F.sha2(printed(F.col("base")), 256).alias("base_sha256"),
        printed(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"),
        F.coalesce("n_copied", none).alias("n_copied"),
        F.coalesce("most_owners", none).alias("most_owners"),
        F.coalesce("most_repositories", none).alias("most_repositories"),
    )


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Owners are sources; a repository is what a source holds in one language."""
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return find_secrets(documents(spark, folder), "doc_id", "text", F.col("source"), repository)


def _sql_spans(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
    SELECT row_no, x.s AS s, {number} AS number, '{kind}' AS kind, x.s + length(x.w) AS e, x.v AS v FROM (
      SELECT row_no, unnest(list_transform(range(1, len(w) + 1), lambda i: {{
        's': list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(w[1:i-1], lambda y: length(y))), 0),
        'w': w[i], 'v': v[i]}})) AS x
      FROM (SELECT row_no, string_split_regex(text, {quoted}) AS g, regexp_extract_all(text, {quoted}) AS w,
                   regexp_extract_all(text, {quoted}, {group}) AS v FROM d)
      WHERE len(w) > 0)
    WHERE length(x.v) >= {least}"""


_BASE = " UNION ALL ".join(_sql_spans(n, *k) for n, k in enumerate(BASE_KINDS))
_LIST = "string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, number)"
OP7_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
         coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents
), base AS ({_BASE}), further AS (
  SELECT * FROM ({_sql_spans(len(BASE_KINDS), *ADDED)}) f
  WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row_no = f.row_no AND b.s < f.e AND b.e > f.s)
), spans AS (SELECT * FROM base UNION ALL SELECT * FROM further),
freq AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM spans JOIN d USING (row_no) GROUP BY v),
judged AS (SELECT * FROM spans JOIN freq USING (v)),
per_row AS (
  SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         {_LIST} FILTER (number < {len(BASE_KINDS)}) AS base_list,
         {_LIST} FILTER (number < {len(BASE_KINDS)} OR (owners = 1 AND repositories <= {OWN_REPOSITORIES})) AS all_list,
         count(*) FILTER (number < {len(BASE_KINDS)} AND owners = 1 AND repositories <= {OWN_REPOSITORIES}) AS n_live,
         count(*) FILTER (number < {len(BASE_KINDS)} AND (owners >= {WIDELY} OR repositories >= {WIDELY_KEPT})) AS n_copied,
         max(owners) FILTER (number < {len(BASE_KINDS)}) AS most_owners, max(repositories) FILTER (number < {len(BASE_KINDS)}) AS most_repositories
  FROM judged GROUP BY row_no
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_list, '')) AS base_sha256, coalesce(all_list, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
       coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN per_row USING (row_no)
"""
