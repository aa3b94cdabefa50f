"""Line dedup: lines that many documents share stay in one of them; documents get keep bitmaps, not texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import Staged, keeping, no_nul, query, table

# Fixed values of the line key: what is stripped and what is lower-cased.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Keys of fewer code points never count as repeated; a key has to be in so many documents.
LEAST_CHARS, LEAST_DOCUMENTS = 20, 3


def line_key(line: Column) -> Column:
    """``line`` without white space at its ends and with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(STRIPPED))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(value: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def dropped_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                 least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """The keep bitmaps of the documents that lose lines, compressed to runs.

    Returns id, version (digest of the text), starts and stops (first and last
    place of each run of dropped lines, from 0).  A key of ``least_chars`` code
    points or more in ``least_documents`` documents or more stays in the
    largest id that holds it, with all its lines there.

    Places of long lines are range-partitioned by key digest and document, so
    that a key of a third of all lines is dealt over many tasks; in each, the
    sorted places stream by and the first of every document is counted.  Counts
    are summed per task before they meet.  Only places of repeated keys return
    to their documents, and no text is moved.
    """
    staged = Staged(docs.sparkSession, "lines")
    rows = keeping(docs, {"id": F.col(doc_id), "text": no_nul(F.col(text))})
    each = rows.select("id", _digest(F.col("text")).alias("version"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    each = each.select("id", "version", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    places = staged.put("places", each.select(_digest(F.col("key")).alias("key"), "id", "version", "pos"))

    order = [F.col("key"), F.col("id").desc()]
    ranged = places.repartitionByRange(*order).sortWithinPartitions(*order, "version", "pos")
    own = Window.partitionBy("key", "id").orderBy("version", "pos")
    firsts = ranged.withColumn("first", (F.row_number().over(own) == 1).cast("long"))
    shared = firsts.groupBy("key").agg(F.sum("first").alias("documents"), F.max("id").alias("last"))
    # Stored, so that the join below deals both sides anew and Spark can split the places of a common key.
    shared = staged.put("shared", shared.filter(F.col("documents") >= least_documents).select("key", "last"))
    lost = places.join(shared, "key").filter(~F.col("id").eqNullSafe(F.col("last")))
    lost = lost.groupBy("id", "version").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    lost = staged.put("lost", lost)
    at = lambda i: F.get("lost", i)
    return lost.select(
        "id", "version",
        F.filter("lost", lambda p, i: (i == 0) | (at(i - 1) != p - 1)).alias("starts"),
        F.filter("lost", lambda p, i: (i == F.size("lost") - 1) | (at(i + 1) != p + 1)).alias("stops"))


def _after(i: Column) -> Column:
    """Place after dropped run i - 1."""
    return F.when(i == 0, F.lit(0)).otherwise(F.get("stops", i - 1) + 1)


def _runs(n_lines: Column) -> Column:
    """Bitmap as text: lengths of kept (+) and dropped (-) runs in turn."""
    pairs = F.flatten(F.transform("starts", lambda s, i: F.array(
        F.concat((s - _after(i)).cast("string"), F.lit("+")),
        F.concat((F.get("stops", i) - s + 1).cast("string"), F.lit("-")))))
    rest = F.concat((n_lines - _after(F.size("starts"))).cast("string"), F.lit("+"))
    return F.array_join(F.filter(F.concat(pairs, F.array(rest)), lambda x: x != "0+"), "")


def _kept(lines: Column) -> Column:
    bounds = F.transform(F.sequence(F.lit(0), F.size("starts")), lambda i: F.struct(
        _after(i).alias("begin"), F.coalesce(F.get("starts", i), F.size(lines)).alias("end")))
    return F.flatten(F.transform(bounds, lambda b: F.slice(lines, b["begin"] + 1, b["end"] - b["begin"])))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row per input row: row (all its columns), id, text, n_lines, n_dropped, bitmap and kept (its text without the lost lines).

    NULL and empty texts are one empty line; a document of which no line is
    kept is the empty text.  Rows of one id are one document: it counts once,
    and the largest id keeps its lines in all its rows.  NULL ids are one
    document before all others.  Repeated rows get equal results; empty input
    gives no rows.  Columns of the input are packed, so their names can't clash.
    """
    runs = dropped_runs(docs, doc_id, text, least_chars, least_documents)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("own"),
                         no_nul(F.col(text)).alias("text"))
    joined = packed.withColumn("digest", _digest(F.col("text"))).join(
        runs, F.col("own").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("version")), "left")
    lines, whole = lines_of(F.col("text")), F.col("starts").isNull()
    n = F.size(lines)
    n_dropped = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a + 1), F.lit(0), lambda x, y: x + y)
    return joined.select(
        "row", F.col("own").alias("id"), "text", n.cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(whole, F.concat(n.cast("string"), F.lit("+"))).otherwise(_runs(n)).alias("bitmap"),
        F.when(whole, F.col("text")).otherwise(F.array_join(_kept(lines), "\n")).alias("kept"))


def line_report(found: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, digest of the kept text, bitmap."""
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), "bitmap")


LINES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT key, doc_id FROM k WHERE length(key) >= {LEAST_CHARS})
      GROUP BY key HAVING count(*) >= {LEAST_DOCUMENTS}),
m AS (SELECT row, pos, line, s.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS lost FROM k LEFT JOIN s ON k.key = s.key),
c AS (SELECT *, CASE WHEN lag(lost) OVER w IS DISTINCT FROM lost THEN 1 ELSE 0 END AS turn FROM m
      WINDOW w AS (PARTITION BY row ORDER BY pos)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY row ORDER BY pos) AS run FROM c),
b AS (SELECT row, string_agg(piece, '' ORDER BY run) AS bitmap FROM (
      SELECT row, run, count(*)::VARCHAR || CASE WHEN any_value(lost) THEN '-' ELSE '+' END AS piece FROM r GROUP BY row, run) GROUP BY row),
t AS (SELECT row, count(*) FILTER (lost) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost) AS kept
      FROM m GROUP BY row)
SELECT doc_id, len(lines)::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256, bitmap
FROM d JOIN t USING (row) JOIN b USING (row)"""


@query("op11_line_dedup", LINES_SQL)
def op11_line_dedup(spark, sf_dir):
    return line_report(dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))
