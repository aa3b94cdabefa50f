"""Secret scans: candidate credentials and how widely each is owned in the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import Staged, keeping, no_nul, query, table

# The kinds in report order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{32,}"
ASSIGN_LEAST = 6

#: A value seen with so many owners or more is a copied example; fewer make it look live.
COPIED_OWNERS = 3
NO_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"


def _placed(text: Column, pattern: str, rank: int, values: Column | None = None) -> Column:
    """Matches of one kind as structs with code point positions.

    A text cut at the matches gives the gaps; running sums of gap and match
    lengths are the positions.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if values is None else values
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(NO_SPANS).alias("found"))
    start = start.withField("found", F.array().cast(NO_SPANS))

    def step(state: Column, row: Column) -> Column:
        at = state["at"] + F.length(row["gap"])
        end = at + F.length(row["hit"])
        span = F.struct(
            at.alias("start"), F.lit(rank).alias("rank"), end.alias("stop"), F.lit(KINDS[rank]).alias("kind"),
            row["value"].alias("value"))
        return F.struct(
            F.coalesce(end, at).alias("at"),
            F.when(row["hit"].isNull(), state["found"]).otherwise(F.concat(state["found"], F.array(span))).alias("found"))

    found = F.aggregate(rows, start, step, lambda s: s["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(NO_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, ordered by start, then kind."""
    given = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.filter(_placed(text, ASSIGN, 0, given), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    return F.array_sort(F.concat(assign, _placed(text, ACCESS, 1), _placed(text, HEX, 2)))


def bare_tokens(text: Column, taken: Column) -> Column:
    """Long runs of mixed letters and digits outside the base spans."""

    def wanted(span: Column) -> Column:
        v = span["value"]
        mixed = v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
        return mixed & ~F.exists(taken, lambda t: (t["start"] < span["stop"]) & (span["start"] < t["stop"]))

    return F.filter(_placed(text, TOKEN, 3), wanted)


def spans_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source",
                 repository: Column | None = None, copied_owners: int = COPIED_OWNERS,
                 copied_repos: int | None = None) -> DataFrame:
    """Secrets of every text, each with the number of repositories and owners that hold its value.

    Returns one row per input row: doc_id, base (spans of the three base
    kinds), spans (base and added spans with value hash, n_repos, n_owners,
    live).  A value held by fewer than ``copied_owners`` owners looks live,
    others are copied examples; with ``copied_repos``, so is a value in that
    many repositories, however few their owners.  The method adds bare tokens (kind ``token``)
    that no base span covers, if they look live.

    A repository defaults to owner and language.  NULL text is empty; a NULL
    owner or repository counts as one unnamed holder; repeated rows give
    repeated results; no input gives no rows.  Only the named columns are read.
    """
    held = F.coalesce(F.col(owner).cast("string"), F.lit(""))
    if repository is None:
        lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
        repository = F.concat_ws("/", held, lang)
    rows = keeping(docs, {"doc_id": F.col(doc_id), "text": no_nul(F.col(text)), "owner": held,
                          "repo": F.coalesce(repository.cast("string"), F.lit(""))})
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(
        s["start"], s["rank"], s["stop"], s["kind"], F.sha2(s["value"], 256).alias("hash")))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("bare", bare_tokens(F.col("text"), F.col("base")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo",
                       hashed(F.col("base")).alias("base"), hashed(F.col("bare")).alias("bare"))
    staged = Staged(docs.sparkSession, "secrets")
    found = staged.put("found", rows)

    # Distinct holders in three steps, each reduced before its shuffle, so that one very common value is no hot group.
    each = found.select("owner", "repo", F.explode(F.concat("base", "bare")).alias("s")).select("owner", "repo", "s.hash")
    owners = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("hash", "owner").agg(
        F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    spread = owners.groupBy("hash").agg(
        F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_seen"))

    spans = found.filter(F.size("base") + F.size("bare") > 0).select("row", F.explode(F.concat("base", "bare")).alias("s"))
    few = (F.col("n_owners") < copied_owners) & (F.lit(True) if copied_repos is None else F.col("n_repos") < copied_repos)
    judged = spans.select("row", "s.*").join(spread, "hash").withColumn("live", few)
    judged = judged.filter((F.col("rank") < 3) | F.col("live"))
    shown = F.struct("start", "rank", "stop", "kind", "hash", "n_repos", "n_owners", "n_seen", "live")
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(shown)).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return found.join(per_row, "row", "left").select("doc_id", "base", F.coalesce("spans", none).alias("spans"))


def secret_counts(found: DataFrame) -> DataFrame:
    """The report row of each text: counts of base kinds, digest, all spans, live and copied values."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_owners"])), F.lit(0)).cast("long").alias("max_owners"))


def mask_spans(text: Column, spans: Column) -> Column:
    """``text`` with the spans replaced by ``<kind>``; overlapping spans become one, under the first one's kind."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        new = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["stop"]).alias("at"),
            F.when(new, F.concat(state["parts"], F.array(gap, F.concat(F.lit("<"), s["kind"], F.lit(">")))))
            .otherwise(state["parts"]).alias("parts"))

    rest = lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, first, step, rest))


def redact_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **scan) -> DataFrame:
    """``docs`` with all base secrets and the added live tokens masked in ``text``; rows and other columns stay.

    Base secrets are masked whether live or copied.  Added tokens are masked by
    value where the corpus-wide count says live.  NULL texts stay NULL.
    """
    live = scan_secrets(docs, doc_id, text, **scan).select(
        F.col("doc_id").alias("_id"), F.explode(F.filter("spans", lambda s: s["kind"] == "token")).alias("s"))
    live = live.groupBy("_id").agg(F.collect_set("s.hash").alias("_live"))
    t = F.col(text)
    joined = docs.join(live, F.col(doc_id).eqNullSafe(F.col("_id")), "left").withColumn("_base", base_spans(no_nul(t)))
    bare = F.filter(bare_tokens(no_nul(t), F.col("_base")), lambda s: F.array_contains("_live", F.sha2(s["value"], 256)))
    spans = F.when(F.col("_live").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", bare)))
    return joined.withColumn("_spans", spans).withColumn(
        text, F.when(t.isNull(), t).otherwise(mask_spans(t, F.col("_spans")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _sql_kind(pattern: str, rank: int, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""list_transform(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1), lambda i: {{
        'start': coalesce(list_sum(list_transform((string_split_regex(t, '{p}'))[1:i], lambda g: length(g))), 0)
               + coalesce(list_sum(list_transform((regexp_extract_all(t, '{p}', 0))[1:i-1], lambda g: length(g))), 0),
        'rank': {rank}, 'size': length((regexp_extract_all(t, '{p}', 0))[i]), 'kind': '{KINDS[rank]}',
        'value': (regexp_extract_all(t, '{p}', {group}))[i]}})"""


_SHOW = "array_to_string(list_transform({}, lambda s: s.kind || ':' || s.start::BIGINT || ':' || (s.start + s.size)::BIGINT), ',')"
SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner,
                  coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
b AS (SELECT *, list_sort(list_concat(list_concat(
        list_filter({_sql_kind(ASSIGN, 0, 2)}, lambda s: length(s.value) >= {ASSIGN_LEAST}),
        {_sql_kind(ACCESS, 1)}), {_sql_kind(HEX, 2)})) AS base, {_sql_kind(TOKEN, 3)} AS tokens FROM d),
c AS (SELECT * EXCLUDE (t, tokens), list_filter(tokens, lambda s: regexp_matches(s.value, '[0-9]')
        AND regexp_matches(s.value, '[a-z]') AND regexp_matches(s.value, '[A-Z]')
        AND len(list_filter(base, lambda o: o.start < s.start + s.size AND s.start < o.start + o.size)) = 0) AS bare FROM b),
e AS (SELECT row, owner, repo, unnest(list_concat(base, bare)) AS s FROM c),
w AS (SELECT s.value AS value, count(DISTINCT owner) AS n_owners FROM e GROUP BY 1),
j AS (SELECT e.row, e.s, w.n_owners, w.n_owners < {COPIED_OWNERS} AS live FROM e JOIN w ON e.s.value = w.value
      WHERE e.s.rank < 3 OR w.n_owners < {COPIED_OWNERS}),
p AS (SELECT row, list_sort(list(s)) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied,
             max(n_owners) AS max_owners FROM j GROUP BY row)
SELECT doc_id, len(list_filter(base, lambda s: s.rank = 0))::BIGINT AS n_assign,
       len(list_filter(base, lambda s: s.rank = 1))::BIGINT AS n_access,
       len(list_filter(base, lambda s: s.rank = 2))::BIGINT AS n_hex,
       sha256({_SHOW.format('base')}) AS base_sha256, coalesce({_SHOW.format('spans')}, '') AS spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied,
       coalesce(max_owners, 0)::BIGINT AS max_owners
FROM c LEFT JOIN p USING (row)"""


@query("op1_secret_scan", SECRETS_SQL)
def op1_secret_scan(spark, sf_dir):
    return secret_counts(scan_secrets(table(spark, sf_dir, "documents")))
