"""Registered queries over utterances, provider documents, files and admission rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import SPACE_CLASS
from palimpsest.operators import utterances as U
from palimpsest.operators import validation as V
from palimpsest.plans.registry import Registry
from palimpsest.sources import provider_json as P
from palimpsest.sources import references, store
from palimpsest.sources.tables import table

registry = Registry()
query = registry.query

# A recording holds at most 1,000 turns of a conversation, so its rows are bounded.
TURNS = 1000
UNITS_SQL = f"""units AS (
  SELECT doc_id, pos, text, conv_id,
         CAST(coalesce(sum(length(text) * 10) OVER (PARTITION BY doc_id ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
         CAST(sum(length(text) * 10) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS end_ms
  FROM (SELECT conv_id * 1000000 + turn // {TURNS} AS doc_id, conv_id, text,
               row_number() OVER (PARTITION BY conv_id, turn // {TURNS} ORDER BY turn) - 1 AS pos
        FROM conversations))"""
FAULTY_SQL = """faulty AS (
  SELECT doc_id, pos, CASE WHEN conv_id % 19 = 6 THEN '' ELSE text END AS text,
         CASE WHEN conv_id % 13 = 5 AND pos = 0 THEN -1
              WHEN pos % 11 = 3 THEN start_ms
              WHEN pos % 7 = 2 THEN start_ms - 50
              WHEN conv_id % 17 = 4 THEN end_ms ELSE start_ms END AS start_ms,
         CASE WHEN conv_id % 13 = 5 AND pos = 0 THEN end_ms
              WHEN pos % 11 = 3 THEN start_ms
              WHEN pos % 7 = 2 THEN end_ms
              WHEN conv_id % 17 = 4 THEN start_ms ELSE end_ms END AS end_ms
  FROM units)"""


def units(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1_000_000 + F.floor(F.col("turn") / TURNS)).alias("doc_id"),
        "conv_id", "turn", "text",
    )
    order = Window.partitionBy("doc_id").orderBy("turn")
    size = F.length("text") * 10
    return rows.select(
        "doc_id",
        "conv_id",
        (F.row_number().over(order) - 1).cast("long").alias("pos"),
        "text",
        (F.sum(size).over(order) - size).alias("start_ms"),
        F.sum(size).over(order).alias("end_ms"),
    )


def faulty(spark: SparkSession, folder: str) -> DataFrame:
    negative = (F.col("conv_id") % 13 == 5) & (F.col("pos") == 0)
    zero, early = F.col("pos") % 11 == 3, F.col("pos") % 7 == 2
    swap = F.col("conv_id") % 17 == 4
    start, end = F.col("start_ms"), F.col("end_ms")
    return units(spark, folder).select(
        "doc_id",
        "pos",
        F.when(F.col("conv_id") % 19 == 6, "").otherwise(F.col("text")).alias("text"),
        F.when(negative, -1)
        .when(zero, start)
        .when(early, start - 50)
        .when(swap, end)
        .otherwise(start)
        .alias("start_ms"),
        F.when(negative, end)
        .when(zero, start)
        .when(early, end)
        .when(swap, start)
        .otherwise(end)
        .alias("end_ms"),
    )


def _documents(spark: SparkSession, folder: str, shape: str) -> DataFrame:
    """Provider documents built from whole recordings, some of them broken on purpose."""
    rows = units(spark, folder)
    kind = F.col("conv_id") % 7
    begin = {"sentence": "begin_time"}.get(shape, "start_time")
    start = F.col("start_ms").cast("string")
    unit = F.concat(
        F.lit('{"text":'), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2),
        F.lit(f',"{begin}":'),
        F.when((kind == 1) & (F.col("pos") == 0), F.concat(F.lit('"'), start, F.lit('"'))).otherwise(start),
        F.lit(',"end_time":'),
        F.when((kind == 4) & (F.col("pos") == 1), start).otherwise(F.col("end_ms").cast("string")),
        F.when((F.lit(shape) == "utterance") & (F.col("pos") % 2 == 0), ',"confidence":0.5').otherwise(""),
        F.lit("}"),
    )
    docs = rows.groupBy("doc_id", "conv_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", unit.alias("u")))), lambda x: x["u"]),
            ",",
        ).alias("list")
    )
    wrap = {
        "sentence": ('{"transcripts":[{"text":"all","sentences":[', "]}]}"),
        "utterance": ('{"result":{"text":"all","utterances":[', "]}}"),
        "alignment": ('{"utterances":[', "]}"),
    }[shape]
    items = F.when(F.col("conv_id") % 7 == 2, "").otherwise(F.col("list"))
    tail = F.when(F.col("conv_id") % 7 == 3, "").otherwise(wrap[1])
    return docs.select("doc_id", F.concat(F.lit(wrap[0]), items, tail).alias("body"))


def _parsed_oracle(shape: str) -> str:
    empty = "FALSE" if shape == "alignment" else "kind = 2"
    bad = "kind = 1" if shape == "alignment" else "kind = 1 OR (kind = 4 AND last_pos >= 1)"
    confidence = (
        ", CASE WHEN pos % 2 = 0 THEN 0.5 END AS confidence" if shape == "utterance" else ""
    )
    end = "CASE WHEN kind = 4 AND pos = 1 THEN start_ms ELSE end_ms END"
    blank = ", NULL" if confidence else ""
    return f"""WITH {UNITS_SQL},
kinds AS (SELECT doc_id, conv_id % 7 AS kind, max(pos) AS last_pos FROM units GROUP BY ALL),
reasons AS (SELECT *, CASE WHEN kind = 3 THEN 'malformed_json' WHEN {empty} THEN 'missing_units'
                   WHEN {bad} THEN 'bad_unit' END AS reason FROM kinds)
SELECT u.doc_id, r.reason, u.pos, u.text, u.start_ms, {end} AS end_ms{confidence}
FROM units u JOIN reasons r ON r.doc_id = u.doc_id
WHERE r.reason IS NULL AND kind <> 2
UNION ALL SELECT doc_id, reason, NULL, NULL, NULL, NULL{blank} FROM reasons
WHERE reason IS NOT NULL"""


@query("transcripts_sentence_json", _parsed_oracle("sentence"))
def transcripts_sentence_json(spark: SparkSession, folder: str) -> DataFrame:
    return P.unit_rows(P.sentence_documents(_documents(spark, folder, "sentence")))


@query("transcripts_utterance_json", _parsed_oracle("utterance"))
def transcripts_utterance_json(spark: SparkSession, folder: str) -> DataFrame:
    return P.unit_rows(P.utterance_documents(_documents(spark, folder, "utterance")))


@query("utterances_json", _parsed_oracle("alignment"))
def utterances_json(spark: SparkSession, folder: str) -> DataFrame:
    return P.unit_rows(P.alignment_documents(_documents(spark, folder, "alignment")))


_SRT_TIME = (
    "lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || "
    "lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || "
    "lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || "
    "lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"
)


@query(
    "srt_render",
    f"""WITH {UNITS_SQL}, {FAULTY_SQL}
SELECT doc_id, CASE WHEN bad THEN 'bad_time' ELSE 'rendered' END AS outcome,
       CAST(0 AS BIGINT) AS part, CASE WHEN NOT bad THEN body END AS text
FROM (SELECT doc_id, bool_or(start_ms < 0 OR end_ms < 0 OR start_ms > end_ms) AS bad,
  string_agg((pos + 1) || chr(10) || {_SRT_TIME.format('start_ms')} || ' --> ' ||
             {_SRT_TIME.format('end_ms')} || chr(10) || text, chr(10) || chr(10) ORDER BY pos)
    || chr(10) AS body FROM faulty GROUP BY doc_id)""",
)
def srt_render(spark: SparkSession, folder: str) -> DataFrame:
    rows = faulty(spark, folder)
    return U.render_srt(rows.select("doc_id").distinct(), rows)


@query(
    "timed_unit_audit",
    f"""WITH {UNITS_SQL}, {FAULTY_SQL}
SELECT * FROM (SELECT doc_id, pos, concat_ws(',', CASE WHEN text = '' THEN 'empty_text' END,
  CASE WHEN start_ms < 0 OR end_ms <= start_ms THEN 'bad_interval' END,
  CASE WHEN start_ms < lag(end_ms) OVER (PARTITION BY doc_id ORDER BY pos)
    THEN 'out_of_order' END) AS codes FROM faulty) WHERE codes <> ''""",
)
def timed_unit_audit(spark: SparkSession, folder: str) -> DataFrame:
    return U.timed_unit_audit(faulty(spark, folder))


@query(
    "utterance_diagnostics",
    f"""WITH {UNITS_SQL}, {FAULTY_SQL},
paired AS (SELECT *, lead(start_ms) OVER w AS ns, lead(end_ms) OVER w AS ne FROM faulty
           WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
inputs AS (SELECT doc_id, string_agg(text, '' ORDER BY pos) AS audio FROM units GROUP BY doc_id)
SELECT p.doc_id, CASE WHEN string_agg(text, '' ORDER BY pos) = max(audio) THEN 'identical'
         ELSE 'differs' END AS relation,
  length(max(audio)) AS input_length,
  CAST(sum(length(text)) AS BIGINT) - length(max(audio)) AS length_delta,
  count(*) AS utterance_count, CAST(sum(length(text)) AS BIGINT) AS output_length,
  count(*) FILTER (text = '') AS empty_text_count,
  count(*) FILTER (start_ms < 0 OR end_ms < 0) AS negative_time_count,
  count(*) FILTER (end_ms < start_ms) AS reversed_interval_count,
  count(*) FILTER (end_ms = start_ms) AS zero_duration_count,
  count(*) FILTER (ns IS NOT NULL AND greatest(start_ms, ns) < least(end_ms, ne))
    AS overlap_count
FROM paired p JOIN inputs i ON i.doc_id = p.doc_id GROUP BY p.doc_id""",
)
def utterance_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    words = units(spark, folder).groupBy("doc_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda u: u["text"]
            ),
            "",
        ).alias("audio_text")
    )
    return U.diagnostics(faulty(spark, folder), words)


@query(
    "adjacent_overlap",
    f"""WITH {UNITS_SQL}, {FAULTY_SQL}
SELECT doc_id, pos, greatest(start_ms, ns) AS overlap_start, least(end_ms, ne) AS overlap_end
FROM (SELECT *, lead(start_ms) OVER w AS ns, lead(end_ms) OVER w AS ne FROM faulty
      WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
WHERE ns IS NOT NULL AND greatest(start_ms, ns) < least(end_ms, ne)""",
)
def adjacent_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return U.adjacent_overlaps(faulty(spark, folder))


@query(
    "keywords_normalize",
    f"""WITH words AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS w,
         generate_subscripts(string_split(text, ' '), 1) AS n FROM documents),
kept AS (SELECT doc_id, regexp_replace(w, '\\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\\z', '', 'g') AS k,
                min(n) AS n FROM words GROUP BY ALL),
lists AS (SELECT doc_id, bool_or(k = '') AS blank, count(*) AS c,
                 string_agg(k, '|' ORDER BY n) AS ks FROM kept GROUP BY doc_id)
SELECT doc_id, CASE WHEN blank THEN 'blank' WHEN c > 100 THEN 'too_many' ELSE 'ok' END AS outcome,
       ks AS keywords FROM lists""",
)
def keywords_normalize(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return V.normalize_keywords(words, "words").select(
        "doc_id", "outcome", F.array_join("keywords", "|").alias("keywords")
    )


@query(
    "media_admission",
    """SELECT o_orderkey AS media_id, d AS duration_ms, b AS bytes,
  CASE WHEN b >= 512000000 THEN 'too_large' WHEN d >= 18000000 THEN 'too_long'
       ELSE 'admitted' END AS reason
FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS d,
             o_orderkey * 100000 AS b FROM orders)""",
)
def media_admission(spark: SparkSession, folder: str) -> DataFrame:
    media = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("media_id"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("duration_ms"),
        (F.col("o_orderkey") * 100_000).alias("bytes"),
    )
    return V.media_admission(media)


@query(
    "strict_json",
    "SELECT event_id, event_id % 7 > 3 AS strict FROM events",
)
def strict_json(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_id") % 7
    text = (
        F.when(kind == 0, F.concat(F.lit('{"a":'), "props", F.lit(',"a":1}')))
        .when(kind == 1, F.concat(F.lit('{"a":'), "props", F.lit(',"b":NaN}')))
        .when(kind == 2, F.concat(F.lit('{"a":'), "props"))
        .when(kind == 3, F.concat(F.lit('{"a":'), "props", F.lit(',"b":Infinity}')))
        .otherwise(F.col("props"))
    )
    rows = table(spark, folder, "events").select("event_id", text.alias("body"))
    return rows.select("event_id", V.is_strict_json(F.col("body")).alias("strict"))


@query(
    "diagnostic_cap",
    """SELECT doc_id, CASE WHEN strlen(r) <= 65536 THEN r END AS raw_response,
  CASE WHEN strlen(r) > 65536 THEN r END AS overflow,
  'sha256:' || sha256(r) AS raw_sha256, CAST(strlen(r) AS BIGINT) AS raw_byte_length,
  strlen(r) > 65536 AS raw_truncated
FROM (SELECT doc_id, text || text || text || text AS r FROM documents)""",
)
def diagnostic_cap(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "documents").select("doc_id", F.repeat("text", F.lit(4)).alias("raw"))
    return V.diagnostic_cap(raw, "raw")


_FILES = """files AS (
  SELECT page_id, page_id || '.' || CASE page_id % 6 WHEN 0 THEN 'TXT' WHEN 1 THEN 'pdf'
    WHEN 2 THEN 'png' WHEN 3 THEN 'docx' WHEN 4 THEN 'exe' ELSE 'md' END AS name,
    encode(CASE WHEN page_id % 36 = 5 THEN ''
      WHEN page_id % 36 = 6 THEN chr(65279)
      WHEN page_id % 12 = 0 THEN chr(65279) || html
      WHEN page_id % 30 = 1 THEN '%PDF-1.7' || html || '/Encrypt %%EOF'
      WHEN page_id % 30 = 7 THEN html || '%%EOF'
      WHEN page_id % 6 = 1 THEN '%PDF-1.7' || html || '%%EOF' ELSE html END) AS content
  FROM pages)"""
_PDF_OK = (
    "(regexp_matches(substr(hex(content), 1, 2048), '^(..)*255044462D') AND "
    "regexp_matches(right(hex(content), 4096), '^(..)*2525454F46') AND NOT "
    "regexp_matches(right(hex(content), 4096), '^(..)*2F456E6372797074'))"
)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    n, html = F.col("page_id"), F.col("html")
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in ("TXT", "pdf", "png", "docx", "exe", "md")]),
        (n % 6 + 1).cast("int"),
    )
    body = (
        F.when(n % 36 == 5, "")
        .when(n % 36 == 6, "\ufeff")
        .when(n % 12 == 0, F.concat(F.lit("\ufeff"), html))
        .when(n % 30 == 1, F.concat(F.lit("%PDF-1.7"), html, F.lit("/Encrypt %%EOF")))
        .when(n % 30 == 7, F.concat(html, F.lit("%%EOF")))
        .when(n % 6 == 1, F.concat(F.lit("%PDF-1.7"), html, F.lit("%%EOF")))
        .otherwise(html)
    )
    return table(spark, folder, "pages").select(
        "page_id",
        F.concat(n.cast("string"), F.lit("."), suffix).alias("name"),
        F.encode(body, "UTF-8").alias("content"),
    )


@query(
    "reference_ingest",
    f"""WITH {_FILES}
SELECT page_id, name, kind, reason, 'sha256:' || sha256(content) AS content_hash,
  octet_length(content) AS byte_length,
  CASE WHEN kind = 'text' AND reason = 'available' THEN body END AS text
FROM (SELECT *, CASE WHEN octet_length(content) = 0 THEN 'empty_source'
  WHEN kind = 'unsupported' THEN 'unsupported_format'
  WHEN kind = 'text' AND body = '' THEN 'empty_text'
  WHEN kind = 'pdf_object' AND NOT {_PDF_OK} THEN 'damaged_pdf'
  WHEN kind = 'office' THEN 'needs_conversion' ELSE 'available' END AS reason
FROM (SELECT *, ltrim(decode(content), chr(65279)) AS body,
  CASE page_id % 6 WHEN 0 THEN 'text' WHEN 5 THEN 'text' WHEN 1 THEN 'pdf_object'
    WHEN 2 THEN 'image_object' WHEN 3 THEN 'office' ELSE 'unsupported' END AS kind FROM files))""",
)
def reference_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return references.ingest(_files(spark, folder))


@query(
    "pdf_sniff",
    f"WITH {_FILES} SELECT page_id, {_PDF_OK} AS usable_pdf FROM files",
)
def pdf_sniff(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).select(
        "page_id", references.is_usable_pdf(F.col("content")).alias("usable_pdf")
    )


@query(
    "content_addressed_write",
    """SELECT h AS content_hash, n AS byte_length, min(doc_id) AS first_owner, count(*) AS copies,
  substr(h, 8, 2) AS prefix
FROM (SELECT doc_id, 'sha256:' || sha256(text) AS h, CAST(strlen(text) AS BIGINT) AS n
      FROM documents)
WHERE h NOT IN (SELECT 'sha256:' || sha256(text) FROM documents WHERE doc_id % 3 = 0)
GROUP BY h, n""",
)
def content_addressed_write(spark: SparkSession, folder: str) -> DataFrame:
    from palimpsest.functions.hashing import content_hash

    docs = table(spark, folder, "documents").select("doc_id", "text")
    stored = docs.where(F.col("doc_id") % 3 == 0).select(
        content_hash(F.col("text")).alias("content_hash")
    )
    return store.new_objects(docs, stored, "text", "doc_id")


@query(
    "event_cursor",
    "SELECT event_id, user_id AS run_id, event_type AS stage FROM events WHERE event_id > 500",
)
def event_cursor(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("stage")
    )
    return store.after_cursor(events, "event_id", 500)


@query(
    "source_registry",
    """SELECT run_id, locator, min(page_id) AS registered,
  'src_' || min(page_id) AS source_id, count(*) AS requests
FROM (SELECT page_id, page_id % 50 AS run_id,
  CASE WHEN page_id % 5 = 0 THEN '/media/c/f' ELSE '/media/a/f' END || page_id % 7 || '.wav'
    AS locator FROM pages) GROUP BY run_id, locator""",
)
def source_registry(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("page_id")
    folder_name = (
        F.when(n % 5 == 0, "/media/c/")
        .when(n % 3 == 0, "/media/a/./")
        .when(n % 3 == 1, "/media//a/")
        .otherwise("/media/b/../a/")
    )
    rows = table(spark, folder, "pages").select(
        (n % 50).alias("run_id"),
        F.concat(folder_name, F.lit("f"), (n % 7).cast("string"), F.lit(".wav")).alias("path"),
        n.alias("registered"),
        F.concat(F.lit("src_"), n.cast("string")).alias("source_id"),
    )
    return store.register_sources(rows)


QUERIES, ORACLES = registry.queries, registry.oracles
