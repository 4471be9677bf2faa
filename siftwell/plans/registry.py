"""All registered queries of the format library, with their SQL counterparts.

Each query composes the column functions with ordinary DataFrame operations over
whole tables; its SQL counterpart derives the same rows from the tables without
any of the formats, or from their fixed values.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions import cron, geojson, logfmt, mime, sql
from siftwell.functions.strict_json import strict_json
from siftwell.plans import cron_cases
from siftwell.sources import geojson as geojson_files
from siftwell.sources import file_types, geojson_split, jsonl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(counterpart: str | None = None):
    """Register a function as a query under its own name, with its SQL counterpart."""

    def add(f):
        QUERIES[f.__name__] = f
        if counterpart:
            ORACLE_SQL[f.__name__] = counterpart
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, *keys) -> DataFrame:
    """A table dealt by ``keys`` to four tasks a core.

    Spark cuts files by their bytes, so a table of some megabytes is one task or two, however long each of its rows takes.
    """
    rows = table(spark, sf_dir, name)
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()), *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors can see: under ``spark.checkpoint.dir``, else, where all run in one process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="siftwell-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def choose(number, options: list, otherwise=None):
    """The option whose place is ``number``."""
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    cases = reduce(lambda c, i: c.when(number == i, of(options[i])), range(1, len(options)), F.when(number == 0, of(options[0])))
    return cases if otherwise is None else cases.otherwise(otherwise)


def sql_cases(number: str, options: list) -> str:
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {quoted(x)}" for i, x in enumerate(options)) + " END"


# ---- logfmt


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit(" type="), F.col("event_type"), F.lit(' value="'), F.col("value").cast("string"), F.lit('" user='), F.col("user_id").cast("string"), F.lit(" live"))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query("""
    SELECT event_id, p.pos AS pos, p.k AS key, p.v AS value FROM (
      SELECT event_id, unnest([
        {'pos': 0, 'k': 'id', 'v': event_id::VARCHAR}, {'pos': 1, 'k': 'type', 'v': event_type},
        {'pos': 2, 'k': 'user', 'v': user_id::VARCHAR}, {'pos': 3, 'k': 'live', 'v': ''}]) AS p FROM events)
""")
def logfmt_pairs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit(" type="), F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" live"))
    lines = table(spark, sf_dir, "events").select("event_id", logfmt.logfmt_parse(line).alias("p"))
    return lines.select("event_id", F.posexplode("p.pairs").alias("pos", "pair")).select("event_id", "pos", "pair.key", "pair.value")


@query("SELECT event_type AS type, count(*) AS n, sum(user_id)::BIGINT AS users, max(value) AS top FROM events GROUP BY 1")
def logfmt_map_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = event_lines(spark, sf_dir).select(logfmt.logfmt_map("line").alias("m")).select("m.fields")
    typed = fields.select(F.col("fields")["type"].alias("type"), F.col("fields")["user"].try_cast("bigint").alias("user"), F.col("fields")["value"].try_cast("double").alias("value"))
    return typed.groupBy("type").agg(F.count("*").alias("n"), F.sum("user").alias("users"), F.max("value").alias("top"))


@query("SELECT doc_id, text AS value FROM documents")
def logfmt_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")], F.col("text"))
    line = F.concat(F.lit('m="'), escaped, F.lit('"'))
    return table(spark, sf_dir, "documents").select("doc_id", logfmt.logfmt_map(line)["fields"]["m"].alias("value"))


@query("SELECT o_orderkey, o_orderstatus AS k FROM orders")
def logfmt_dup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('k="'), F.col("o_orderpriority"), F.lit('" k='), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", logfmt.logfmt_map(line)["fields"]["k"].alias("k"))


_LOG_LINES = ["a=1", "a=b=c", 'é="open', 'm="x\\']
_LOG_AT = [None, 3, 8, 5]
_LOG_SAYS = [None, "expected key", "unterminated quoted string", "unterminated escape sequence"]


@query(f"SELECT event_id, event_id % 4 = 0 AS ok, {sql_cases('event_id % 4', _LOG_AT)}::INT AS position, {sql_cases('event_id % 4', _LOG_SAYS)} AS message FROM events")
def logfmt_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = choose(F.col("event_id") % 4, _LOG_LINES)
    return table(spark, sf_dir, "events").select("event_id", logfmt.logfmt_parse(line).alias("p")).select("event_id", "p.ok", "p.error.position", "p.error.message")


@query(f"SELECT event_id, 'logfmt parse error at position ' || {sql_cases('event_id % 4', _LOG_AT)} || ': ' || {sql_cases('event_id % 4', _LOG_SAYS)} AS said FROM events")
def logfmt_error_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select("event_id", logfmt.logfmt_parse(choose(F.col("event_id") % 4, _LOG_LINES)).alias("p"))
    return parsed.select("event_id", logfmt.logfmt_error_text(F.col("p.error")).alias("said"))


@query()
def logfmt_wild_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "documents").select("doc_id", logfmt.logfmt_parse("text").alias("p"))
    return parsed.select("doc_id", "p.ok", F.size("p.pairs").alias("n_pairs"), F.col("p.error.position").alias("position"), logfmt.logfmt_error_text(F.col("p.error")).alias("error"))


# ---- file types

#: (hex head, type) of every signature and of some conflicts between them.
HEADS = [
    ("FFD8FFE0", "Jpeg"), ("89504E470D0A1A0A", "Png"), ("474946383961", "Gif"), ("52494646000000005745425056503820", "WebP"), ("255044462D", "Pdf"), ("0061736D01000000", "Wasm"),
    ("7F454C4602", "Elf"), ("4D5A9000", "PeExe"), ("1F8B08", "Gzip"), ("504B030414", "Zip"), ("53514C69746520666F726D6174203300", "Sqlite"), ("664C6143", "Flac"), ("4F67675300", "Ogg"),
    ("49443303", "Mp3"), ("FFFB90", "Mp3"), ("FFF3", "Mp3"), ("1A45DFA3004282847765626D", "WebM"), ("1A45DFA3", "Mkv"), ("1A45DFA34282886D6174726F736B61", "Mkv"), ("1A45DFA34282847878787842828477656 26D".replace(" ", ""), "WebM"),
    ("00000018667479706D703432", "Mp4"), ("0000001866747970", "Mp4"), ("000000186674797068656963", "Heic"), ("00000018667479706D696631", "Heif"), ("000000186674797061766966", "Avif"), ("000000186674797071742020", "QuickTime"),
    ("000000186674797033677035", "ThreeGp"), ("000001006674797068656963", "Heic"), ("52494646000000005741564566", "Wav"), ("5249464600000000415649204C", "Avi"), ("52494646000000004D4D4D4D", None),
    ("424D36", "Bmp"), ("0000010001", "Ico"), ("49492A0008", "Tiff"), ("4D4D002A", "Tiff"), ("68656C6C6F", None), ("", None),
    ("424D" + "00" * 255 + "7573746172", "Tar"), ("4D5A" + "00" * 255 + "7573746172", "PeExe"),
]
_KIND_SQL = f"(SELECT event_id, {sql_cases(f'event_id % {len(HEADS)}', [k for _, k in HEADS])} AS kind FROM events)"
_TYPES_SQL = "(VALUES " + ", ".join(f"('{k}', '{m}', '{e}')" for k, m, e, _ in mime.TYPES) + ") AS t(kind, mime, extension)"


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.unhex(choose(F.col("event_id") % len(HEADS), [h for h, _ in HEADS])).alias("content"))


@query(f"SELECT event_id, e.kind AS kind, t.mime AS mime FROM {_KIND_SQL} e LEFT JOIN {_TYPES_SQL} ON e.kind = t.kind")
def mime_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("event_id", mime.mime_detect("content").alias("kind")).withColumn("mime", mime.mime_string("kind"))


@query(f"SELECT t.mime AS mime, count(*) AS n FROM {_KIND_SQL} e LEFT JOIN {_TYPES_SQL} ON e.kind = t.kind GROUP BY 1")
def mime_magic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mime_magic(spark, sf_dir).groupBy("mime").agg(F.count("*").alias("n"))


#: Every accepted extension, in both letter cases, and some that are none.
EXTENSIONS = [(x, t[0]) for t in mime.TYPES for x in t[3].split()] + [(t[3].split()[0].upper(), t[0]) for t in mime.TYPES] + [("txt", None), ("", None), ("mKv", None)]
_EXT_SQL = f"(SELECT p_partkey, {sql_cases(f'p_partkey % {len(EXTENSIONS)}', [k for _, k in EXTENSIONS])} AS kind FROM part)"


@query(f"SELECT p_partkey, p.kind AS kind, t.mime AS mime, t.extension AS extension FROM {_EXT_SQL} p LEFT JOIN {_TYPES_SQL} ON p.kind = t.kind")
def mime_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("file."), choose(F.col("p_partkey") % len(EXTENSIONS), [x for x, _ in EXTENSIONS]))
    kinds = table(spark, sf_dir, "part").select("p_partkey", mime.mime_by_extension(F.substring_index(name, ".", -1)).alias("kind"))
    return kinds.select("p_partkey", "kind", mime.mime_string("kind").alias("mime"), mime.mime_extension("kind").alias("extension"))


@query(f"SELECT t.mime AS mime, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM (SELECT html, {sql_cases(f'page_id % {len(HEADS)}', [k for _, k in HEADS])} AS kind FROM pages) p LEFT JOIN {_TYPES_SQL} ON p.kind = t.kind GROUP BY 1")
def mime_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of pages whose bytes stand behind a head of some type, or of none."""
    head = F.unhex(choose(F.col("page_id") % len(HEADS), [h for h, _ in HEADS]))
    pages = table(spark, sf_dir, "pages").select("html", F.concat(head, F.encode("html", "UTF-8")).alias("content"))
    return pages.groupBy(mime.mime_string(mime.mime_detect("content")).alias("mime")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


@query(f"SELECT t.kind AS kind, t.mime AS mime, t.extension AS extension, true AS round_trip, count(p.kind) AS parts FROM {_TYPES_SQL} LEFT JOIN {_EXT_SQL} p ON p.kind = t.kind GROUP BY 1, 2, 3")
def mime_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension of all types, with the number of parts whose file name is of each."""
    name = F.concat(F.lit("file."), choose(F.col("p_partkey") % len(EXTENSIONS), [x for x, _ in EXTENSIONS]))
    parts = table(spark, sf_dir, "part").groupBy(mime.mime_by_extension(F.substring_index(name, ".", -1)).alias("kind")).agg(F.count("*").alias("parts"))
    joined = mime.mime_types(spark).join(parts, "kind", "left")
    return joined.select("kind", "mime", "extension", (mime.mime_by_extension("extension") == F.col("kind")).alias("round_trip"), F.coalesce("parts", F.lit(0)).alias("parts"))


@query("SELECT 'Gzip' AS kind, 'application/gzip' AS mime UNION ALL SELECT NULL, NULL")
def mime_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of files by their bytes alone: the same lines written compressed and plain."""
    path, lines = scratch(spark, "files"), table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"))
    lines.write.option("compression", "gzip").text(f"{path}/packed")
    lines.write.text(f"{path}/plain")
    return file_types.detect_files(spark, path, "part-*").select("kind", "mime").distinct()


#: Edits of an event's object, {"k": n}, and what the reader says of them: SQL of the line, of the place (its byte, from 1) and the reason.
#: A fault behind the number is found where the number ends, so its place moves with the number's length.
LINE_EDITS = [
    ("props", "NULL::INT", None),
    ("substr(props, 1, 1)", "1", "EOF while parsing an object"),
    ("substr(props, 1, 3)", "3", "EOF while parsing a string"),
    ("substr(props, 1, 5)", "5", "EOF while parsing a value"),
    ("'[' || props", "length(props) + 1", "EOF while parsing a list"),
    ("props || ']'", "length(props) + 1", "trailing characters"),
    ("'?' || props", "1", "expected value"),
    ("'{k' || substr(props, 3)", "2", "key must be a string"),
    ("substr(props, 1, 4) || ' ' || substr(props, 6)", "7", "expected `:`"),
    ("substr(props, 1, length(props) - 1) || ']'", "length(props)", "expected `,` or `}`"),
    ("'[' || props || ' 1]'", "length(props) + 3", "expected `,` or `]`"),
    ("substr(props, 1, length(props) - 1) || ',}'", "length(props) + 1", "trailing comma"),
    ("'[tru, ' || props || ']'", "5", "expected ident"),
    ("'[01, ' || props || ']'", "3", "invalid number"),
    ("'[-1e400, ' || props || ']'", "7", "number out of range"),
    ("'[\"\\\\q\", ' || props || ']'", "4", "invalid escape"),
    ("'[\"\\\\udc00\", ' || props || ']'", "8", "lone leading surrogate in hex escape"),
    ("'[\"\\\\ud800\", ' || props || ']'", "9", "unexpected end of hex escape"),
    ("repeat('[', 127) || props || repeat(']', 127)", "128", "recursion limit exceeded"),
    ("repeat('[', 126) || props || repeat(']', 126)", "NULL", None),
]


def edited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, k, line): every event's object, changed by its number."""
    # in Spark's SQL a backslash in a text is written twice, and numbers have one kind of cast
    edits = [F.expr(line) for line, _, _ in LINE_EDITS]
    k = F.regexp_extract("props", r"(-?\d+)", 1).cast("bigint")
    return spread(spark, sf_dir, "events", "event_id").select("event_id", k.alias("k"), choose(F.col("event_id") % len(LINE_EDITS), edits).alias("line"))


_PLACE_SQL = f"CASE event_id % {len(LINE_EDITS)} " + " ".join(f"WHEN {i} THEN {at}" for i, (_, at, _) in enumerate(LINE_EDITS)) + " END"
_REASON_SQL = sql_cases(f"event_id % {len(LINE_EDITS)}", [r for _, _, r in LINE_EDITS])


# ---- SQL text alone


def sql_session(spark: SparkSession) -> SparkSession:
    sql.register(spark)
    return spark


@query("""
    SELECT event_id, p.pos AS pos, p.k AS key, p.v AS value FROM (
      SELECT event_id, unnest([{'pos': 0, 'k': 'id', 'v': event_id::VARCHAR}, {'pos': 1, 'k': 'type', 'v': event_type}, {'pos': 2, 'k': 'live', 'v': ''}]) AS p FROM events)
""")
def sql_logfmt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_session(spark).sql(f"""
        SELECT event_id, p.* FROM (SELECT event_id, 'id=' || event_id || ' type="' || event_type || '" live' AS line FROM parquet.`{sf_dir}/events.parquet`), LATERAL logfmt_pairs(line) p""")


@query("SELECT event_type AS type, count(*) AS n, count(*) FILTER (event_id % 4 <> 0) AS good, sum(user_id) FILTER (event_id % 4 <> 0)::BIGINT AS users FROM events GROUP BY 1")
def sql_logfmt_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of equal keys; every fourth line is malformed."""
    return sql_session(spark).sql(f"""
        SELECT event_type AS type, count(*) AS n, count(logfmt_value(line, 'user')) AS good, sum(CAST(logfmt_value(line, 'user') AS BIGINT)) AS users
        FROM (SELECT event_id, event_type, 'user=0 user=' || user_id || CASE WHEN event_id % 4 = 0 THEN '=' ELSE '' END AS line FROM parquet.`{sf_dir}/events.parquet`) GROUP BY event_type""")


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS type, CASE WHEN event_id % 5 <> 0 THEN '\"' || user_id || '\"' END AS \"user\" FROM events")
def sql_logfmt_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function whose columns follow from its argument."""
    return sql_session(spark).sql(f"""
        SELECT event_id, c.* FROM (SELECT event_id, 'type=' || event_type || r' user="\\"' || user_id || CASE WHEN event_id % 5 = 0 THEN '' ELSE r'\\""' END AS line FROM parquet.`{sf_dir}/events.parquet`), LATERAL logfmt_columns(line, 'type, user') c""")


@query(f"SELECT e.kind AS kind, count(*) AS n FROM {_KIND_SQL} e GROUP BY 1")
def sql_mime_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads(sql_session(spark), sf_dir).createOrReplaceTempView("siftwell_heads")
    return spark.sql("SELECT mime_of_bytes(content) AS kind, count(*) AS n FROM siftwell_heads GROUP BY 1")


@query(f"SELECT p_partkey, p.kind AS kind FROM {_EXT_SQL} p")
def sql_mime_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = sql_cases(f"p_partkey % {len(EXTENSIONS)}", [x for x, _ in EXTENSIONS])
    return sql_session(spark).sql(f"SELECT p_partkey, mime_of_extension({cases}) AS kind FROM parquet.`{sf_dir}/part.parquet`")


@query(f"SELECT CASE WHEN {_REASON_SQL} IS NULL THEN 'none' ELSE {_REASON_SQL} END AS reason, count(*) AS n, sum({_PLACE_SQL})::BIGINT AS places FROM events GROUP BY 1")
def sql_json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited_lines(sql_session(spark), sf_dir).createOrReplaceTempView("siftwell_lines")
    return spark.sql("SELECT coalesce(f.reason, 'none') AS reason, count(*) AS n, sum(f.column) AS places FROM (SELECT json_fault(line) AS f FROM siftwell_lines) GROUP BY 1")


# ---- cron

def event_id():
    return F.col("event_id")


def events_with(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", *[c.alias(n) for n, c in columns.items()])


def words_of(*parts):
    return F.concat_ws(" ", *[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


@query("""
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 60)::VARCHAR END AS seconds, (event_id % 60)::VARCHAR AS minutes, (event_id % 24)::VARCHAR AS hours,
      '*' AS dom, '1-6/2' AS month, (event_id % 7)::VARCHAR AS dow FROM events
""")
def cron_parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(event_id() % 2 == 0, F.concat((event_id() % 60).cast("string"), F.lit(" "))).otherwise(""), words_of(F.lpad((event_id() % 60).cast("string"), 3, "0"), event_id() % 24, "*", "1-6/2", event_id() % 7))
    return events_with(spark, sf_dir, p=cron.cron_fields(text)).select("event_id", "p.*")


@query(f"SELECT event_id, {cron_cases.described_sql(1, spark=False)} AS said FROM events")
def cron_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    schedules = table(spark, sf_dir, "events").select("event_id", F.expr(cron_cases.described_sql(0, spark=True)).alias("schedule"))
    return schedules.select("event_id", cron.cron_describe("schedule").alias("said"))


@query("""
    SELECT event_id, CASE WHEN t > date_trunc('minute', ts) THEN t ELSE t + INTERVAL 1 DAY END AS next FROM (
      SELECT event_id, ts, date_trunc('day', ts) + to_minutes((event_id % 24) * 60 + event_id % 60) AS t FROM events)
""")
def cron_next_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_with(spark, sf_dir, next=cron.cron_next_after(words_of(event_id() % 60, event_id() % 24, "*", "*", "*"), "ts")).drop("ts")


def _days_sql(fires: str, at: str) -> str:
    return f"""
    SELECT event_id, min(t) AS next FROM (
      SELECT event_id, ts, date_trunc('day', ts) + to_days(i::INT) + {at} AS t, (date_trunc('day', ts) + to_days(i::INT))::DATE AS d
      FROM events, range(0, 40) AS r(i)) WHERE t > date_trunc('minute', ts) AND ({fires}) GROUP BY 1"""


@query(_days_sql("dayofweek(d) = (event_id % 8) % 7", "INTERVAL 6 HOUR"))
def cron_next_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_with(spark, sf_dir, next=cron.cron_next_after(words_of("0", "6", "*", "*", event_id() % 8), "ts")).drop("ts")


@query(_days_sql("day(d) = event_id % 28 + 1 OR dayofweek(d) = 5", "INTERVAL 30 MINUTE"))
def cron_next_monthly_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_with(spark, sf_dir, next=cron.cron_next_after(words_of("30", "0", event_id() % 28 + 1, "*", "5"), "ts")).drop("ts")


@query("""
    SELECT event_id, min(t) AS next FROM (
      SELECT event_id, date_trunc('minute', ts) + to_minutes(i::INT) AS t FROM events, range(1, 1500) AS r(i))
    WHERE minute(t) % 20 = 0 AND hour(t) % 2 = 1 AND hour(t) >= 3 GROUP BY 1
""")
def cron_next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_with(spark, sf_dir, next=cron.cron_next_after(F.lit("*/20 3-5/2 * * *"), "ts")).drop("ts")


def faulty_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", cron.cron_parse(F.expr(cron_cases.faulty_sql())).alias("p"))


@query("SELECT event_id, NOT bad AS ok, " + ", ".join(f"CASE WHEN bad THEN {c} END{t} AS {c}" for c, t in (("position", "::INT"), ("field", ""), ("expected", ""), ("found", ""))) + f" FROM {cron_cases.FAULT_ROWS}")
def cron_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faulty_schedules(spark, sf_dir).select("event_id", "p.ok", "p.error.position", "p.error.field", "p.error.expected", "p.error.found")


@query("""
    SELECT e.event_type AS type, count(*) AS schedules, sum(len(range(0, 60, (event_id % 14 + 1)::INT)) * 12)::BIGINT AS fires FROM events e GROUP BY 1
""")
def cron_fire_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires a day of each event's schedule, by event type."""
    fields = cron.cron_fields(F.concat(F.lit("*/"), (event_id() % 14 + 1).cast("string"), F.lit(" 12-20/1 * * *")))
    fires = F.size(cron.cron_expand(fields["minutes"], 0, 59)) * F.size(cron.cron_expand(fields["hours"], 0, 23))
    return table(spark, sf_dir, "events").select("event_type", fires.cast("long").alias("fires")).groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("schedules"), F.sum("fires").alias("fires"))


@query("SELECT event_id, event_id % 3 = 0 AS six, event_id % 2 = 0 AS equal FROM events")
def cron_six_and_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a schedule has seconds, and whether two spellings are the same schedule."""
    seconds = F.when(event_id() % 3 == 0, "07 ").otherwise("")
    one = F.concat(seconds, words_of(F.lpad((event_id() % 60).cast("string"), 3, "0"), event_id() % 24, "*", "1-6/02", event_id() % 7))
    two = F.concat(seconds, words_of(event_id() % 60, (event_id() + event_id() % 2) % 24, "*", "1-6/2", event_id() % 7))
    rows = events_with(spark, sf_dir, one=cron.cron_fields(one), two=cron.cron_fields(two))
    return rows.select("event_id", cron.is_six_field(F.col("one")).alias("six"), F.col("one").eqNullSafe(F.col("two")).alias("equal"))


@query("""
    SELECT event_id, CASE WHEN t > date_trunc('minute', ts) THEN t ELSE t + INTERVAL 1 DAY END + to_seconds(event_id % 60) AS next FROM (
      SELECT event_id, ts, date_trunc('day', ts) + to_minutes((event_id % 24) * 60 + event_id % 59) AS t FROM events)
""")
def cron_next_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_with(spark, sf_dir, next=cron.cron_next_after(words_of(event_id() % 60, event_id() % 59, event_id() % 24, "*", "*", "*"), "ts")).drop("ts")


@query(f"SELECT event_id, CASE WHEN bad THEN 'cron parse error in ' || field || ' field at position ' || position || ': expected ' || expected || ', found ' || coalesce(shown, 'end of input') END AS said FROM {cron_cases.FAULT_ROWS}")
def cron_error_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faulty_schedules(spark, sf_dir).select("event_id", cron.cron_error_text(F.col("p.error")).alias("said"))


@query("SELECT event_id, CASE WHEN event_id % 9 NOT IN (5, 6) THEN 'cron parse error in minutes field at position 0: expected 5 or 6 whitespace-separated fields, found end of input' END AS said FROM events")
def cron_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules of no field to eight."""
    text = F.array_join(F.slice(F.lit(list("12345678")), F.lit(1), (event_id() % 9).cast("int")), " ")
    return table(spark, sf_dir, "events").select("event_id", cron.cron_parse(text).alias("p")).select("event_id", cron.cron_error_text(F.col("p.error")).alias("said"))


# ---- JSON Lines


@query("SELECT event_type AS type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def jsonl_parse_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = jsonl.parse_line("props")["value"]
    rows = spread(spark, sf_dir, "events", "event_id").select("event_type", F.try_variant_get(value, "$.k", "bigint").alias("k"))
    return rows.groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("""
    SELECT event_id, CASE WHEN event_id % 10 < 2 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 10 < 2 THEN 'Json' END AS kind
    FROM events WHERE event_id % 10 <> 2
""")
def jsonl_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(event_id() % 10 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(event_id() % 10 == 1, F.concat("props", F.lit(" junk"))).when(event_id() % 10 == 2, F.lit(" \t　")).otherwise(F.col("props"))
    rows = spread(spark, sf_dir, "events", "event_id").select("event_id", jsonl.parse_line(line).alias("p")).where(F.col("p").isNotNull())
    return rows.select("event_id", F.try_variant_get("p.value", "$.k", "bigint").alias("k"), F.col("p.error.kind").alias("kind"))


@query("SELECT p_partkey::BIGINT AS place, p_partkey AS part, CASE WHEN p_partkey % 7 = 0 THEN 'Json' END AS kind FROM part WHERE p_partkey % 5 <> 0 AND p_partkey > 0")
def jsonl_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in files by range of their keys (1, 2, ...), every fifth line blank, every seventh broken: line numbers must run as the keys of the file do."""
    path, key = scratch(spark, "lines"), F.col("p_partkey")
    text = F.when(key % 5 == 0, "").when(key % 7 == 0, F.concat(F.lit('{"part":'), key.cast("string"))).otherwise(F.concat(F.lit('{"part":'), key.cast("string"), F.lit("}")))
    parts = table(spark, sf_dir, "part").where(key > 0).select(key, text.alias("value")).repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey")
    parts.select("value").write.option("lineSep", "\n").text(path)
    rows = jsonl.read_jsonl(spark, path).withColumn("part", F.try_variant_get("value", "$.part", "bigint"))
    before = rows.groupBy("path").agg(F.min(F.col("part") - F.col("line")).alias("before"))
    placed = rows.join(before, "path").withColumn("place", F.col("line") + F.col("before"))
    return placed.select("place", F.coalesce("part", "place").alias("part"), F.col("error.kind").alias("kind"))


@query(f"SELECT event_id, {_PLACE_SQL}::INT AS place, 'JSON error: ' || {_REASON_SQL} || ' at line 1 column ' || ({_PLACE_SQL}) AS said FROM events")
def jsonl_error_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason and place of the first fault of a line."""
    rows = edited_lines(spark, sf_dir).select("event_id", jsonl.parse_line("line")["error"].alias("e"))
    return rows.select("event_id", F.col("e.column").alias("place"), F.col("e.message").alias("said"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + event_id % 3 AS k, event_id % 2 AS inner_k, event_id % 3 + 1 AS n FROM events")
def json_last_key_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with a key up to three times, the value of the last counting, at the top and inside; the session's settings are as they come."""
    k = F.regexp_extract("props", r"(-?\d+)", 1).cast("bigint")
    more = F.array_join(F.transform(F.sequence(F.lit(0), event_id() % 3), lambda i: F.concat(F.lit('"k": '), (k + i).cast("string"))), ", ")
    inner = F.concat(F.lit('"in": [{"\\u006b": 7, "k": '), (event_id() % 2).cast("string"), F.lit("}]"))
    n = F.concat(F.lit('"n": '), (event_id() % 3 + 1).cast("string"))
    rows = spread(spark, sf_dir, "events", "event_id").select("event_id", jsonl.parse_line(F.concat(F.lit("{"), inner, F.lit(", "), more, F.lit(", "), n, F.lit("}")))["value"].alias("v"))
    return rows.select("event_id", *[F.variant_get("v", path, "bigint").alias(name) for path, name in (("$.k", "k"), ("$.in[0].k", "inner_k"), ("$.n", "n"))])


@query("SELECT count(*) AS written, count(*) AS found FROM conversations")
def jsonl_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "conversations")
    written = jsonl.write_jsonl(table(spark, sf_dir, "conversations"), path, value=F.struct("role", "text"))
    return jsonl.read_jsonl(spark, path).agg(F.lit(written).cast("long").alias("written"), F.count("value").alias("found"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "orders")
    jsonl.write_jsonl(spread(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    value = F.col("value")
    return jsonl.read_jsonl(spark, path).select(
        F.variant_get(value, "$.o_orderkey", "bigint").alias("o_orderkey"), F.variant_get(value, "$.o_custkey", "bigint").alias("o_custkey"),
        F.variant_get(value, "$.o_orderstatus", "string").alias("o_orderstatus"), F.variant_get(value, "$.o_totalprice", "double").alias("o_totalprice"),
    )


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks survive one line of JSON each."""
    line = jsonl.to_line(F.struct("conv_id", "turn", "role", "text"))
    value = strict_json(line)
    return table(spark, sf_dir, "conversations").select(*[F.variant_get(value, f"$.{n}", t).alias(n) for n, t in (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))])


# ---- GeoJSON


def lon(key: str):
    return F.col(key) % 360 - 180 + F.lit(0.5)


def lat(key: str):
    return F.col(key) % 180 - 90 + F.lit(0.25)


def pair(x, y):
    return F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))


_LON, _LAT = "(c_custkey % 360 - 180 + 0.5)::DOUBLE", "(c_custkey % 180 - 90 + 0.25)::DOUBLE"


@query(f"SELECT c_custkey, true AS ok, {_LON} AS longitude, {_LAT} AS latitude, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS altitude FROM customer")
def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    altitude = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(","), F.col("c_acctbal").cast("string"))).otherwise("")
    text = F.concat(F.lit('{"type":"Point","coordinates":['), lon("c_custkey").cast("string"), F.lit(","), lat("c_custkey").cast("string"), altitude, F.lit("]}"))
    rows = spread(spark, sf_dir, "customer", "c_custkey").select("c_custkey", geojson.geo_parse(text).alias("g"))
    return rows.select("c_custkey", "g.ok", geojson.point_position(F.col("g.value")).alias("p")).select("c_custkey", "ok", "p.*")


@query("""
    SELECT s_suppkey, NOT (s_suppkey % 3 = 0 OR s_suppkey % 5 = 0) AS ok, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 THEN 'InvalidRing' END AS kind,
      CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 THEN '.coordinates[0]' END AS path,
      CASE WHEN s_suppkey % 5 = 0 THEN 'ring must have at least 4 positions, got 3' WHEN s_suppkey % 3 = 0 THEN 'polygon ring is not closed (first position != last position)' END AS message
    FROM supplier
""")
def geo_validate_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, x = F.col("s_suppkey"), F.col("s_suppkey") % 90
    last = F.when(key % 3 == 0, pair(x, x + 5)).otherwise(pair(x, x))
    ring = F.when(key % 5 == 0, F.concat_ws(",", pair(x, x), pair(x + 1, x), pair(x, x))).otherwise(F.concat_ws(",", pair(x, x), pair(x + 1, x), pair(x + 1, x + 1), last))
    text = F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}"))
    return spread(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", geojson.geo_parse(text).alias("g")).select("s_suppkey", "g.ok", "g.error.kind", "g.error.path", "g.error.message")


#: Customers' keys in one document: a document stays small however many customers a nation has.
SPAN = 500


def nation_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FeatureCollections of each nation's customers, one for each ``SPAN`` keys."""
    key = F.col("c_custkey").cast("string")
    feature = F.concat(F.lit('{"type":"Feature","id":'), key, F.lit(',"geometry":{"type":"Point","coordinates":'), pair(lon("c_custkey"), lat("c_custkey")), F.lit('},"properties":{"name":"'), F.col("c_name"), F.lit('"},"seg":"'), F.col("c_mktsegment"), F.lit('"}'))
    rows = spread(spark, sf_dir, "customer", "c_nationkey", F.floor(F.col("c_custkey") / SPAN)).select("c_nationkey", F.floor(F.col("c_custkey") / SPAN).alias("span"), feature.alias("f"))
    grouped = rows.groupBy("c_nationkey", "span").agg(F.collect_list("f").alias("fs"))
    return grouped.select("c_nationkey", "span", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("fs", ","), F.lit("]}")).alias("doc"))


@query(f"SELECT c_nationkey, c_custkey, c_name AS name, c_mktsegment AS segment, {_LON} AS longitude, {_LAT} AS latitude FROM customer")
def geo_features_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geojson.geo_features(nation_collections(spark, sf_dir), "doc")
    at = geojson.point_position(F.col("geometry"))
    return rows.select("c_nationkey", F.variant_get("id", "$", "bigint").alias("c_custkey"), F.variant_get("properties", "$.name", "string").alias("name"), F.variant_get(F.col("foreign")["seg"], "$", "string").alias("segment"), at["longitude"].alias("longitude"), at["latitude"].alias("latitude"))


@query("SELECT c_custkey, 2 AS n_numbers, c_custkey::DOUBLE AS west, c_acctbal AS south, '{\"extra\":{\"k\":' || c_custkey || '}}' AS foreign_members FROM customer")
def geo_bbox_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit('{"type":"Feature","geometry":null,"properties":null,"bbox":['), key, F.lit(',"skip",'), F.col("c_acctbal").cast("string"), F.lit('],"extra":{"k":'), key, F.lit("}}"))
    rows = geojson.geo_features(spread(spark, sf_dir, "customer", "c_custkey").select("c_custkey", text.alias("doc")), "doc")
    return rows.select("c_custkey", F.size("bbox").alias("n_numbers"), F.get("bbox", F.lit(0)).alias("west"), F.get("bbox", F.lit(1)).alias("south"), F.to_json("foreign").alias("foreign_members"))


#: How deep collections may stand in each other: a point takes two levels of JSON, a collection two more.
DEEPEST = 62


@query(f"""
    SELECT s_suppkey, s_suppkey % 70 <= {DEEPEST} AS ok, CASE WHEN s_suppkey % 70 > {DEEPEST} THEN 'Json' WHEN s_suppkey % 4 = 0 THEN 'MalformedCoordinates' END AS kind,
      CASE WHEN s_suppkey % 70 > {DEEPEST} THEN '' WHEN s_suppkey % 4 = 0 THEN repeat('.geometries[1]', (s_suppkey % 70)::INT) || '.coordinates' END AS path
    FROM supplier
""".replace(f"s_suppkey % 70 <= {DEEPEST} AS ok", f"s_suppkey % 70 <= {DEEPEST} AND s_suppkey % 4 <> 0 AS ok"))
def geo_deep_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections in collections up to 69 deep, some with a faulty point at the bottom."""
    depth = (F.col("s_suppkey") % 70).cast("int")
    point = F.concat(F.lit('{"type":"Point","coordinates":['), F.when(F.col("s_suppkey") % 4 == 0, "1").otherwise("1,2"), F.lit("]}"))
    text = F.concat(F.repeat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[0,0]},'), depth), point, F.repeat(F.lit("]}"), depth))
    rows = spread(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", geojson.geo_parse(text).alias("g"))
    return rows.select("s_suppkey", "g.ok", "g.error.kind", "g.error.path")


@query(f"SELECT c_nationkey, (c_custkey // {SPAN})::BIGINT AS span, true AS same, count(*) AS n_features FROM customer GROUP BY 1, 2")
def geo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents parsed, written as text, read and parsed again: the values must be equal, not the texts alone."""
    path = scratch(spark, "geojson")
    first = nation_collections(spark, sf_dir).select("c_nationkey", "span", geojson.geo_parse("doc")["value"].alias("v"))
    first.select("c_nationkey", "span", geojson.canonical_key(F.col("v"))["hash"].alias("before"), geojson.geo_to_json(F.col("v")).alias("text")).write.parquet(path)
    again = spark.read.parquet(path).select("c_nationkey", "span", "before", geojson.geo_parse("text")["value"].alias("w"))
    return again.select("c_nationkey", "span", (geojson.canonical_key(F.col("w"))["hash"] == F.col("before")).alias("same"), F.size(F.variant_get("w", "$.features", "array<variant>")).cast("long").alias("n_features"))


@query("""
    SELECT c_nationkey, c_custkey % 7 AS shape, count(*) AS n, count(*) AS spellings FROM customer GROUP BY 1, 2
""".replace("count(*) AS spellings", "least(count(*), 3) AS spellings"))
def geo_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents grouped by value: three spellings of one feature, which differ in key order, blanks and the writing of numbers, are one."""
    x = (F.col("c_custkey") % 7 + 1).cast("string")
    nation = F.col("c_nationkey").cast("string")
    spelled = choose(
        F.row_number().over(W.partitionBy("c_nationkey", F.col("c_custkey") % 7).orderBy("c_custkey")) % 3,
        [
            F.concat(F.lit('{"type":"Feature","properties":{"a":1,"n":'), nation, F.lit('},"geometry":{"type":"Point","coordinates":['), x, F.lit("000000,0.5]}}")),
            F.concat(F.lit('{"geometry": {"coordinates": ['), x, F.lit('e6, 5e-1], "type": "Point"}, "properties": {"n": '), nation, F.lit('.0, "a": 1}, "type": "Feature"}')),
            F.concat(F.lit('{"type":"Point","properties":{"n":'), nation, F.lit(',"a":1.00},"type":"Feature","geometry":{"type":"Point","coordinates":['), x, F.lit('.0E+6,0.50]}}')),
        ],
    )
    rows = spread(spark, sf_dir, "customer", "c_nationkey", F.col("c_custkey") % 7).select("c_nationkey", (F.col("c_custkey") % 7).alias("shape"), spelled.alias("doc")).select("c_nationkey", "shape", "doc", geojson.canonical_key(geojson.geo_parse("doc")["value"])["hash"].alias("same"))
    return rows.groupBy("same").agg(F.min("c_nationkey").alias("c_nationkey"), F.min("shape").alias("shape"), F.count("*").alias("n"), F.countDistinct("doc").alias("spellings")).drop("same")


#: Powers of ten that numbers of the query below are scaled by, and how these are written.
_POWERS = [-7, -5, -4, -1, 0, 3, 7, 15, 16, 21]


def _scaled_sql(power: int) -> str:
    """Text of (k % 9 + 1) * 10 ** power and of (k % 9 + 1).25 * 10 ** power, two numbers without rounding."""
    d = "(c_custkey % 9 + 1)"
    if power > 15:
        return f"{d} || 'e{power},' || {d} || '.25e{power}'"
    if power >= 0:
        return f"{d} || '{'0' * power}.0,' || {d} || " + (f"'{'25' if not power else '2.5' if power == 1 else '25' + '0' * (power - 2) + '.0'}'" if power > 1 else "'.25'")
    if power > -6:
        return f"'0.{'0' * (-power - 1)}' || {d} || ',0.{'0' * (-power - 1)}' || {d} || '25'"
    return f"{d} || 'e{power},' || {d} || '.25e{power}'"


_SCALED_SQL = f"CASE c_custkey % {len(_POWERS)} " + " ".join(f"WHEN {i} THEN {_scaled_sql(p)}" for i, p in enumerate(_POWERS)) + " END"


@query(f"SELECT c_custkey, repeat('{{\"type\":\"GeometryCollection\",\"geometries\":[', (c_custkey % 4)::INT) || '{{\"type\":\"Point\",\"coordinates\":[' || {_SCALED_SQL} || ']}}' || repeat(']}}', (c_custkey % 4)::INT) AS canonical FROM customer")
def geo_number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large and small coordinates in collections of every depth from none to three: one text at each depth."""
    d, depth = (F.col("c_custkey") % 9 + 1).cast("string"), (F.col("c_custkey") % 4).cast("int")
    power = choose(F.col("c_custkey") % len(_POWERS), [str(p) for p in _POWERS])
    point = F.concat(F.lit('{"type":"Point","coordinates":['), d, F.lit("e"), power, F.lit(","), d, F.lit(".25e"), power, F.lit("]}"))
    text = F.concat(F.repeat(F.lit('{"type":"GeometryCollection","geometries":['), depth), point, F.repeat(F.lit("]}"), depth))
    rows = spread(spark, sf_dir, "customer", "c_custkey").select("c_custkey", geojson.geo_parse(text).alias("g"))
    return rows.select("c_custkey", geojson.geo_to_json(F.col("g.value")).alias("canonical"))


def _geometry(kind: str, x: str) -> str:
    """Canonical text of a valid geometry of ``kind`` whose coordinates hold the number ``x``, written as a float."""
    at, ring = f"[{x},1.0]", f"[[{x},0.0],[0.5,0.0],[0.5,0.5],[{x},0.0]]"
    inner = {"Point": at, "MultiPoint": f"[{at},[2.0,3.0,4.5]]", "LineString": f"[[0.0,0.0],{at}]", "MultiLineString": f"[[[0.0,0.0],{at}],[{at},[1.0,1.0]]]", "Polygon": f"[{ring}]", "MultiPolygon": f"[[{ring}],[{ring}]]"}
    if kind == "GeometryCollection":
        return '{"type":"GeometryCollection","geometries":[' + ",".join(_geometry(k, x) for k in inner) + "]}"
    return f'{{"type":"{kind}","coordinates":{inner[kind]}}}'


GEOMETRIES = ["Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection"]
_GEO_SQL = " ".join(f"WHEN {i} THEN replace('{_geometry(k, '@')}', '@', (c_custkey % 360 - 180 + 0.5)::DOUBLE::VARCHAR)" for i, k in enumerate(GEOMETRIES))


@query(f"SELECT c_custkey, true AS ok, CASE c_custkey % 7 {_GEO_SQL} END AS canonical FROM customer")
def geo_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid geometries of all seven types, with members that the canonical text drops."""
    text = F.replace(choose(F.col("c_custkey") % 7, [_geometry(k, "@").replace(',"', ', "extra": [1], "', 1) for k in GEOMETRIES]), F.lit("@"), lon("c_custkey").cast("string"))
    rows = spread(spark, sf_dir, "customer", "c_custkey").select("c_custkey", geojson.geo_parse(text).alias("g"))
    return rows.select("c_custkey", "g.ok", geojson.geo_to_json(F.col("g.value")).alias("canonical"))


@query("SELECT n_nationkey::INT AS n_nationkey, n_nationkey % 5 <> 0 AS ok, CASE WHEN n_nationkey % 5 = 0 THEN 'Json' END AS kind, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS name FROM nation")
def geo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a file, every fifth cut short."""
    path, key = scratch(spark, "geofiles"), F.col("n_nationkey")
    text = F.concat(F.lit('{"type":"Feature",\n "geometry":null,"properties":{"name":"'), F.col("n_name"), F.when(key % 5 == 0, '"').otherwise('"}}'))
    table(spark, sf_dir, "nation").select(key, text.alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    read = geojson_files.read_geojson(spark, path, "part-*")
    return read.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), "ok", F.col("error.kind").alias("kind"), F.try_variant_get("value", "$.properties.name", "string").alias("name"))


@query(f"SELECT c_nationkey::INT AS c_nationkey, c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey, c_custkey // {SPAN} ORDER BY c_custkey) - 1 AS pos, c_custkey % 7 <> 0 AS ok, CASE WHEN c_custkey % 7 = 0 THEN 'features[' || (pos) || '].geometry.coordinates' END AS path, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 7 <> 0 THEN {_LON} END AS longitude FROM customer")
def geo_feature_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of up to ``SPAN`` features, read in ranges of 4,000 bytes; every seventh feature lacks half of its position, and names hold brackets and quotes."""
    path, key = scratch(spark, "georanges"), F.col("c_custkey").cast("string")
    at = F.when(F.col("c_custkey") % 7 == 0, "[1]").otherwise(pair(lon("c_custkey"), lat("c_custkey")))
    feature = F.concat(F.lit('{"type":"Feature","id":'), key, F.lit(',"geometry":{"type":"Point","coordinates":'), at, F.lit('},\n"properties":{"[":"}\\"]{\\\\","name":"'), F.col("c_name"), F.lit('"}}'))
    rows = spread(spark, sf_dir, "customer", "c_nationkey", F.floor(F.col("c_custkey") / SPAN)).select("c_nationkey", "c_custkey", F.floor(F.col("c_custkey") / SPAN).alias("span"), feature.alias("f"))
    grouped = rows.groupBy("c_nationkey", "span").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "f")))["f"].alias("fs"))
    text = F.concat(F.lit('{"type":"FeatureCollection","bbox":[1,2],"features":['), F.array_join("fs", ", "), F.lit('],"more":{"features":[{}]}}'))
    grouped.select("c_nationkey", "span", text.alias("value")).write.partitionBy("c_nationkey", "span").text(path)
    read = geojson_split.read_features(spark, path, "part-*", 4000)
    value = lambda place, kind: F.try_variant_get("value", place, kind)
    known = F.coalesce(value("$.id", "bigint"), F.regexp_extract("text", r'"id":(\d+)', 1).cast("bigint"))
    return read.select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("c_nationkey"), known.alias("c_custkey"), "pos", "ok", F.col("error.path").alias("path"), value("$.properties.name", "string").alias("name"), value("$.geometry.coordinates[0]", "double").alias("longitude"))


#: (document, kind, path, message)
GEO_FAULTS = [
    ('{"type":"Point","coordinates":[1,2]}', None, None, None),
    ("not json", "Json", "", "expected ident at line 1 column 2"),
    ('{"type":"Point","coordinates":[1e400,0]}', "Json", "", "number out of range at line 1 column 36"),
    ('{"a":1}', "InvalidType", ".type", "missing or non-string 'type' field"),
    ('{"type":"Blob"}', "InvalidType", ".type", "unknown geometry type 'Blob'"),
    ('{"type":"FeatureCollection"}', "InvalidType", ".features", "FeatureCollection missing 'features' array"),
    ('{"type":"FeatureCollection","features":[{"type":"Point"}]}', "InvalidType", "features[0].type", "expected 'Feature', got Some(String(\"Point\"))"),
    ('{"type":"Point"}', "MalformedCoordinates", ".coordinates", "missing 'coordinates' field"),
    ('{"type":"Point","coordinates":[1]}', "MalformedCoordinates", ".coordinates", "position must have 2 or 3 elements, got 1"),
    ('{"type":"LineString","coordinates":[[1,2],[3,"x"]]}', "MalformedCoordinates", ".coordinates[1]", "coordinate must be a number"),
    ('{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2,3,4]}}', "MalformedCoordinates", ".geometry.coordinates", "position must have 2 or 3 elements, got 4"),
    ('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"MultiPoint","coordinates":7}]}', "MalformedCoordinates", ".geometries[1].coordinates", "expected array of positions"),
    ('{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[9,9]]]]}', "InvalidRing", ".coordinates[0][0]", "polygon ring is not closed (first position != last position)"),
]


@query("SELECT event_id, " + ", ".join(f"{sql_cases(f'event_id % {len(GEO_FAULTS)}', [f[i] for f in GEO_FAULTS])} AS {n}" for i, n in ((1, "kind"), (2, "path"), (3, "message"))) + f", event_id % {len(GEO_FAULTS)} = 0 AS ok FROM events")
def geo_error_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = choose(event_id() % len(GEO_FAULTS), [f[0] for f in GEO_FAULTS])
    return spread(spark, sf_dir, "events", "event_id").select("event_id", geojson.geo_parse(doc).alias("g")).select("event_id", "g.error.kind", "g.error.path", "g.error.message", "g.ok")


def _geo_text(fault: tuple) -> str | None:
    prefix = {"InvalidType": "invalid type: ", "MalformedCoordinates": "malformed coordinates: ", "InvalidRing": "invalid ring: ", "Json": "JSON error: "}
    return fault[1] and f"geojson error at {fault[2]}: {prefix[fault[1]]}{fault[3]}"


@query(f"SELECT event_id, {sql_cases(f'event_id % {len(GEO_FAULTS)}', [_geo_text(f) for f in GEO_FAULTS])} AS said FROM events")
def geo_error_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = choose(event_id() % len(GEO_FAULTS), [f[0] for f in GEO_FAULTS])
    return spread(spark, sf_dir, "events", "event_id").select("event_id", geojson.geo_error_text(geojson.geo_parse(doc)["error"]).alias("said"))
