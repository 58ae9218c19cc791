"""The registered queries over the driver's tables, each with its SQL where SQL can say it.

The tables hold no library structures, so conversations stand in for them: a conversation is a
library, a row a segment at its turn's place.  The whole text is the sequence; user rows are known segments, assistant rows barcodes (letter B) or, at every fourth
place, ligation sites (letter L), system rows UMIs (letter U).  Model k of three "predicts" the
library k places further on, in a circle; a run fails if its library opens with a system row.

DuckDB's edit distance counts bytes.  The SQL therefore first puts a control character, which the texts don't
hold, in the place of each of their accented letters: one byte for one character, and so the distance of
whole texts in characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.distance import as_similarity
from ..functions.segments import SEGMENT, integer_at, object_at, string_at
from ..functions.text import newline_count, path_stem, safe_filename, similarity, strip
from ..functions.urls import EXTENSIONS, guess_extension
from ..operators import aggregate, score, select
from ..operators.measure import distances
from ..operators.number import number_rows
from ..sources import acquire, readers, seams, sinks
from ..sources.web import plan_requests, read_web
from ..store import Store, saved
from . import benchmark

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(x: Column | str, name: str | None = None) -> Column:
    """A double to six places, so that the order of a sum doesn't show."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6).alias(name or x)


# ---- the stand-in


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """protocol_id, library, segments, n_roles, place (1..n), n."""
    c = table(spark, sf_dir, "conversations")
    sequence = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("role") == "user", "known").when(F.col("role") == "assistant", "barcode").otherwise("umi")
    char = F.when(F.col("role") == "user", "").when(F.col("role") == "system", "U").when(F.col("turn").bitwiseAND(F.lit(3).cast("long")) == 1, "B").otherwise("L")
    segment = F.struct("turn", F.struct(F.concat("role", F.col("turn").cast("string")).alias("name"), kind.alias("type"), char.alias("char"), sequence.alias("sequence"), F.lit(None).cast("long").alias("length"), F.lit(False).alias("empty")).alias("s"))
    whole = c.groupBy(F.col("conv_id").alias("protocol_id")).agg(F.transform(F.array_sort(F.collect_list(segment)), lambda x: x["s"]).alias("segments"))
    return whole.select("protocol_id", F.array_join(F.transform("segments", lambda s: s["sequence"]), "").alias("library"), "segments")


def stand_in(spark: SparkSession, sf_dir: str, measured: bool = False, only: tuple[str, ...] | None = None, library: bool = True) -> DataFrame:
    """The scored runs of three models over all libraries; with ``measured`` their edit distances are measured first,
    those of libraries and of the fields ``only`` that a query reads."""
    libs = libraries(spark, sf_dir)
    models = spark.createDataFrame([("m-near", 1), ("m-mid", 2), ("m-far", 3)], "model_name string, k int")
    places = number_rows(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("protocol_id")).distinct(), "place", "protocol_id")
    places = places.crossJoin(places.agg(F.count(F.lit(1)).alias("n")))
    wanted = score.pair(models, places).withColumn("to", F.when(F.col("place") + F.col("k") > F.col("n"), F.col("place") + F.col("k") - F.col("n")).otherwise(F.col("place") + F.col("k")))
    other = places.select(F.col("protocol_id").alias("other_id"), F.col("place").alias("to"))
    pairs = wanted.join(other, "to").select("model_name", "k", "protocol_id", "other_id")
    roles = lambda s: F.array_join(F.array_sort(F.transform(s, lambda x: x["type"])), ",")
    truth = libs.select("protocol_id", F.col("library").alias("gt_library"), F.col("segments").alias("gt_segments"), roles("segments").alias("gt_placeholders"))
    guess = libs.select(F.col("protocol_id").alias("other_id"), F.col("library").alias("pred_library"), F.col("segments").alias("pred_segments"), roles("segments").alias("pred_placeholders"))
    runs = pairs.join(truth, "protocol_id").join(guess, "other_id")
    return score.score_runs((runs if measured else score.spread(runs)).withColumn("error", F.when(F.col("gt_segments")[0]["type"] == "umi", "no answer")).withColumn("duration_seconds", (F.col("k") + F.size("gt_segments")).cast("double")), Store(spark) if measured else None, only, library)


#: What the summaries by region read of region rows.
SUMMARY_FIELDS = ("segment_index", "region", "region_exact", "sequence_exact", "sequence_similarity", "length_exact", "char_exact")


def region_fields(spark: SparkSession, sf_dir: str, keys: tuple[str, ...], *fields: str) -> DataFrame:
    """Region rows with these fields of theirs alone, measured if the similarity is one of them."""
    only = ("segment_index", *fields)
    return score.region_rows(stand_in(spark, sf_dir, "sequence_similarity" in fields, only, library=False), *keys)


#: One byte for each character: the accented letters of the test texts become control characters.
ACCENTS = "ÉÈÊÇÄÖÜÑÓÍéèêçäöüñóíß"
BYTES = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 27)])


def one_byte(x: str) -> str:
    return f"translate({x}, '{ACCENTS}', {BYTES})"


#: The same in DuckDB: runs with their scores, aligned with their region rows.
STAND_IN = """
WITH seg AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role || turn AS name,
    ONE_BYTE AS seq,
    CASE role WHEN 'user' THEN 'known' WHEN 'assistant' THEN 'barcode' ELSE 'umi' END AS type,
    CASE WHEN role = 'user' THEN '' WHEN role = 'system' THEN 'U' WHEN (turn & 3) = 1 THEN 'B' ELSE 'L' END AS chr,
    CASE WHEN role = 'user' THEN 'known' WHEN role = 'system' THEN 'umi' WHEN (turn & 3) = 1 THEN 'barcode' ELSE 'ligation' END AS region
  FROM conversations),
lib AS (SELECT conv_id, string_agg(seq, '' ORDER BY turn) AS library, count(*) AS n_seg, string_agg(type, ',' ORDER BY type) AS roles,
    row_number() OVER (ORDER BY conv_id) AS place, count(*) OVER () AS n FROM seg GROUP BY conv_id),
model(model_name, k) AS (VALUES ('m-near', 1), ('m-mid', 2), ('m-far', 3)),
run AS (
  SELECT model_name, k, g.conv_id AS protocol_id, p.conv_id AS other_id, g.library AS gl, g.n_seg AS gn, g.roles AS groles,
    CASE WHEN f.type = 'umi' THEN 'no answer' END AS error, p.library AS pl0, p.n_seg AS pn0, p.roles AS proles, (k + g.n_seg)::DOUBLE AS duration_seconds
  FROM model CROSS JOIN lib g JOIN lib p ON p.place = CASE WHEN g.place + k > g.n THEN g.place + k - g.n ELSE g.place + k END
    JOIN seg f ON f.conv_id = g.conv_id AND f.idx = 0),
region_row AS (
  SELECT model_name, protocol_id, g.idx AS segment_index, g.name AS segment_name, g.region AS gt_region, coalesce(p.region, 'missing') AS pred_region,
    g.region = coalesce(p.region, 'missing') AS region_exact, length(g.seq) AS gt_length, coalesce(length(p.seq), 0) AS pred_length,
    length(g.seq) = coalesce(length(p.seq), 0) AS length_exact, g.seq = coalesce(p.seq, '') AS sequence_exact,
    CASE WHEN g.seq = coalesce(p.seq, '') THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(g.seq, coalesce(p.seq, ''))::DOUBLE / greatest(length(g.seq), length(coalesce(p.seq, '')))::DOUBLE END AS sequence_similarity,
    CASE WHEN g.region <> 'known' THEN g.chr = coalesce(p.chr, '') END AS char_exact, p.seq IS NOT NULL AS pred_present
  FROM run JOIN seg g ON g.conv_id = protocol_id LEFT JOIN seg p ON p.conv_id = other_id AND p.idx = g.idx WHERE error IS NULL),
acc AS (
  SELECT model_name, protocol_id, count(*) FILTER (WHERE region_exact) AS region_hits, count(*) FILTER (WHERE sequence_exact) AS sequence_hits,
    count(*) FILTER (WHERE length_exact) AS length_hits, count(*) AS n FROM region_row GROUP BY ALL),
scored AS (
  SELECT run.*, coalesce(pl0, '') AS pl, error IS NULL AS ok,
    CASE WHEN error IS NOT NULL THEN 0.0::DOUBLE WHEN gl = pl0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(gl, pl0)::DOUBLE / greatest(length(gl), length(pl0))::DOUBLE END AS library_similarity,
    error IS NULL AND gl = pl0 AS library_exact, CASE WHEN error IS NULL THEN pn0 ELSE 0 END AS pn, CASE WHEN error IS NULL THEN length(pl0) ELSE 0 END AS pred_library_length,
    error IS NULL AND gn = pn0 AS segment_count_match, error IS NULL AND groles = proles AS placeholder_key_exact,
    CASE WHEN error IS NULL THEN region_hits::DOUBLE / acc.n ELSE 0.0::DOUBLE END AS ra, CASE WHEN error IS NULL THEN sequence_hits::DOUBLE / acc.n ELSE 0.0::DOUBLE END AS sa,
    CASE WHEN error IS NULL THEN length_hits::DOUBLE / acc.n ELSE 0.0::DOUBLE END AS la
  FROM run LEFT JOIN acc USING (model_name, protocol_id))
""".replace("ONE_BYTE", one_byte("coalesce(text, '')"))

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- scalar functions and the cross join


@query("""
SELECT n_name, r_name, levenshtein(n_name, r_name)::BIGINT AS distance,
  round(CASE WHEN n_name = r_name THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(n_name, r_name)::DOUBLE / greatest(length(n_name), length(r_name))::DOUBLE END, 6) AS similarity
FROM nation CROSS JOIN region""")
def q01_pair_similarity(spark, d):
    pairs = score.pair(table(spark, d, "region"), table(spark, d, "nation"))
    return pairs.select("n_name", "r_name", F.levenshtein("n_name", "r_name").cast("long").alias("distance"), six(similarity(F.col("n_name"), F.col("r_name")), "similarity"))


@query(f"""
WITH e AS (SELECT role, {one_byte("coalesce(text, '')")} AS one, {one_byte("coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS next FROM conversations)
SELECT role, count(*)::BIGINT AS n, round(avg(CASE WHEN one = next THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(one, next)::DOUBLE / greatest(length(one), length(next))::DOUBLE END), 6) AS avg_similarity FROM e GROUP BY role""")
def q02_similarity_by_source(spark, d):
    """The whole text of each turn against the next one's, by who speaks."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, d, "conversations").select("role", F.struct(F.coalesce("text", F.lit("")).alias("left"), F.coalesce(after, F.lit("")).alias("right")).alias("pair"))
    pairs = distances(turns, F.array("pair"), "distance", Store(spark))
    alike = as_similarity(F.col("distance")[0], F.col("pair.left"), F.col("pair.right"))
    return pairs.groupBy("role").agg(F.count(F.lit(1)).alias("n"), six(aggregate.mean(alike), "avg_similarity"))


@query("""
WITH f AS (SELECT source, length(coalesce(text, '')) AS chars, arg_min(coalesce(text, ''), doc_id) AS first FROM documents GROUP BY ALL)
SELECT d.source, count(*)::BIGINT AS n, round(avg(CASE WHEN coalesce(text, '') = first THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS exact_rate
FROM documents d JOIN f ON f.source IS NOT DISTINCT FROM d.source AND f.chars = length(coalesce(text, '')) GROUP BY d.source""")
def q03_exact_rate(spark, d):
    """Whole documents against the first one of their source and length."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    first = docs.groupBy(F.col("source").alias("of"), F.length("text").alias("chars")).agg(F.min_by("text", "doc_id").alias("first"))
    pairs = docs.join(first, docs["source"].eqNullSafe(F.col("of")) & (F.length("text") == F.col("chars")))
    return pairs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), six(aggregate.rate(F.col("text") == F.col("first")), "exact_rate"))


# ---- runs, alignment and summaries


@query(STAND_IN + """
SELECT model_name, count(*)::BIGINT AS runs, count(*) FILTER (WHERE ok)::BIGINT AS successes, count(*) FILTER (WHERE NOT ok)::BIGINT AS failures,
  round(coalesce(avg(library_similarity) FILTER (WHERE ok), 0.0::DOUBLE), 6) AS avg_library_similarity FROM scored GROUP BY model_name""")
def q04_entry_model_summary(spark, d):
    return aggregate.by_model(stand_in(spark, d, measured=True, only=())).select("model_name", "runs", "successes", "failures", six("avg_library_similarity"))


@query(STAND_IN + "SELECT model_name, protocol_id, segment_index::BIGINT AS segment_index, gt_length::BIGINT AS gt_length, pred_length::BIGINT AS pred_length, pred_present FROM region_row")
def q05_positional_align(spark, d):
    return region_fields(spark, d, ("model_name", "protocol_id"), "gt_length", "pred_length", "pred_present").select("model_name", "protocol_id", "segment_index", "gt_length", "pred_length", "pred_present")


@query(STAND_IN + """SELECT model_name, protocol_id, segment_index::BIGINT AS segment_index, segment_name, gt_region, pred_region, region_exact, length_exact, sequence_exact, char_exact,
  round(sequence_similarity, 6) AS sequence_similarity FROM region_row""")
def q06_region_rows(spark, d):
    rows = region_fields(spark, d, ("model_name", "protocol_id"), "segment_name", "gt_region", "pred_region", "region_exact", "length_exact", "sequence_exact", "char_exact", "sequence_similarity")
    return rows.select("model_name", "protocol_id", "segment_index", "segment_name", "gt_region", "pred_region", "region_exact", "length_exact", "sequence_exact", "char_exact", six("sequence_similarity"))


@query(STAND_IN + "SELECT model_name, protocol_id, gn::BIGINT AS gt_segment_count, pn::BIGINT AS pred_segment_count, greatest(pn - gn, 0)::BIGINT AS surplus FROM scored")
def q07_surplus_segments(spark, d):
    return stand_in(spark, d).select("model_name", "protocol_id", "gt_segment_count", "pred_segment_count", F.greatest(F.col("pred_segment_count") - F.col("gt_segment_count"), F.lit(0).cast("long")).alias("surplus"))


@query(STAND_IN + "SELECT model_name, protocol_id, round(ra, 6) AS ordered_region_accuracy, round(sa, 6) AS ordered_sequence_accuracy, round(la, 6) AS ordered_length_accuracy FROM scored")
def q08_run_accuracies(spark, d):
    return stand_in(spark, d).select("model_name", "protocol_id", six("ordered_region_accuracy"), six("ordered_sequence_accuracy"), six("ordered_length_accuracy"))


@query(STAND_IN + "SELECT model_name, protocol_id, segment_count_match FROM scored")
def q09_segment_count_match(spark, d):
    return stand_in(spark, d).select("model_name", "protocol_id", "segment_count_match")


@query(STAND_IN + "SELECT model_name, gt_region, char_exact, count(*)::BIGINT AS n FROM region_row GROUP BY ALL")
def q10_char_exact_tristate(spark, d):
    return region_fields(spark, d, ("model_name",), "gt_region", "char_exact").groupBy("model_name", "gt_region", "char_exact").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, event_type = 'view' OR user_id % 3 = 0 AS placeholder_key_exact FROM events""")
def q11_map_equality(spark, d):
    """Placeholder maps of a description and a reply, whose keys come in another order."""
    user = F.col("user_id").cast("string")
    other = F.when(F.col("user_id") % 3 == 0, user).otherwise(F.concat(F.lit("not "), user))
    truth = F.concat(F.lit('{"B": {"kind": "'), "event_type", F.lit('", "user": "'), user, F.lit('"}, "U": ["umi"]}'))
    reply = F.concat(F.lit('{"result": {"placeholder_key": {"U": ["umi"], "B": {"user": "'), F.when(F.col("event_type") == "view", user).otherwise(other), F.lit('", "kind": "'), "event_type", F.lit('"}}}}'))
    none = F.array().cast(f"array<{SEGMENT}>")
    runs = table(spark, d, "events").select("event_id", F.to_json(F.parse_json(truth)).alias("gt_placeholders"), reply.alias("response"), F.lit("").alias("gt_library"), none.alias("gt_segments"))
    return score.score_runs(readers.predictions(runs)).select("event_id", "placeholder_key_exact")


@query(STAND_IN + "SELECT model_name, count(*)::BIGINT AS runs, count(*) FILTER (WHERE ok)::BIGINT AS successes, count(*) FILTER (WHERE NOT ok)::BIGINT AS failures FROM scored GROUP BY model_name")
def q12_model_success_failure(spark, d):
    return aggregate.by_model(stand_in(spark, d)).select("model_name", "runs", "successes", "failures")


@query(STAND_IN + """SELECT model_name, round(coalesce(avg(CASE WHEN library_exact THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE ok), 0), 6) AS library_exact_rate,
  round(coalesce(avg(ra) FILTER (WHERE ok), 0), 6) AS avg_ordered_region_accuracy, round(coalesce(avg(sa) FILTER (WHERE ok), 0), 6) AS avg_ordered_sequence_accuracy, round(avg(duration_seconds), 6) AS avg_duration_seconds
FROM scored GROUP BY model_name""")
def q13_mean_over_success_only(spark, d):
    return aggregate.by_model(stand_in(spark, d)).select("model_name", six("library_exact_rate"), six("avg_ordered_region_accuracy"), six("avg_ordered_sequence_accuracy"), six("avg_duration_seconds"))


@query("SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS avg_duration FROM events GROUP BY event_type")
def q14_duration_all_rows(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), six(aggregate.mean(F.col("value")), "avg_duration"))


REGION_SUMMARY = """SELECT model_name, gt_region AS region, count(*)::BIGINT AS "count", round(avg(region_exact::INT), 6) AS region_exact_rate, round(avg(sequence_exact::INT), 6) AS sequence_exact_rate,
  round(avg(sequence_similarity), 6) AS avg_sequence_similarity, round(avg(length_exact::INT), 6) AS length_exact_rate, round(coalesce(avg(char_exact::INT), 0.0::DOUBLE), 6) AS char_exact_rate FROM region_row GROUP BY ALL"""


@query(STAND_IN + REGION_SUMMARY)
def q15_region_summary(spark, d):
    rows = region_fields(spark, d, ("model_name",), *SUMMARY_FIELDS[1:])
    summary = aggregate.by_model_and_region(rows)
    return summary.select("model_name", "region", "count", *map(six, ("region_exact_rate", "sequence_exact_rate", "avg_sequence_similarity", "length_exact_rate", "char_exact_rate")))


@query(STAND_IN + "SELECT gt_region AS region, round(coalesce(avg(char_exact::INT), 0.0::DOUBLE), 6) AS char_exact_rate FROM region_row GROUP BY ALL")
def q16_char_rate_zero_default(spark, d):
    rows = region_fields(spark, d, ("model_name",), "region", "char_exact")
    return rows.groupBy("region").agg(six(aggregate.rate(F.col("char_exact"), F.col("char_exact").isNotNull()), "char_exact_rate"))


@query("SELECT user_id, round(coalesce(avg(value) FILTER (WHERE event_type = 'purchase'), 0.0::DOUBLE), 6) AS mean_of_some FROM events GROUP BY user_id")
def q17_empty_group_mean(spark, d):
    """Many users have no purchase: their mean is 0."""
    return table(spark, d, "events").groupBy("user_id").agg(six(aggregate.mean(F.col("value"), F.col("event_type") == "purchase"), "mean_of_some"))


@query(STAND_IN + """SELECT model_name, protocol_id, error, length(gl)::BIGINT AS gt_library_length, pred_library_length::BIGINT AS pred_library_length, gn::BIGINT AS gt_segment_count, pn::BIGINT AS pred_segment_count,
  round(library_similarity, 6) AS library_similarity, library_exact, round(ra, 6) AS ordered_region_accuracy FROM scored WHERE NOT ok""")
def q18_failed_run_defaults(spark, d):
    return stand_in(spark, d).filter(score.failed()).select("model_name", "protocol_id", "error", "gt_library_length", "pred_library_length", "gt_segment_count", "pred_segment_count", six("library_similarity"), "library_exact", six("ordered_region_accuracy"))


# ---- selection, order and sets


def _wanted(spark, d):
    return select.wanted_ids(table(spark, d, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" "))).otherwise(" ").alias("id")), "id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q19_select_ids(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").cast("string").alias("id"))
    return select.keep_wanted(orders, _wanted(spark, d), "id").select("o_orderkey", "o_custkey")


@query("SELECT coalesce(string_agg(c_custkey::VARCHAR, ', ' ORDER BY c_custkey::VARCHAR), '') AS missing FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q20_unknown_ids(spark, d):
    return select.unknown_ids(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id")), _wanted(spark, d), "id")


@query("SELECT path FROM (SELECT source || '.' || doc_id || '.json' AS path FROM documents) ORDER BY path LIMIT 100")
def q21_limit_in_path_order(spark, d):
    paths = table(spark, d, "documents").select(F.concat("source", F.lit("."), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"))
    return select.first_rows(paths, 100, "path")


@query("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_name, n_nationkey) AS k, count(*) OVER () AS n FROM nation) WHERE k <= n - 3")
def q22_negative_limit(spark, d):
    return select.first_rows(table(spark, d, "nation").select("n_nationkey", "n_name"), -3, "n_name", "n_nationkey")


@query("SELECT row_number() OVER (ORDER BY r_regionkey, n_name, n_nationkey)::BIGINT AS run_number, r_name, n_name FROM region CROSS JOIN nation")
def q23_run_number(spark, d):
    return select.run_numbers(score.pair(table(spark, d, "region"), table(spark, d, "nation")), "r_regionkey", "n_name", "n_nationkey").select("run_number", "r_name", "n_name")


# ---- acquisition


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '-', 'g'), '-'), ''), 'protocol') AS file_name FROM pages")
def q24_safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", safe_filename(F.col("url")).alias("file_name"))


#: By the page's number: one of the known content types, an unknown one, or none.
TYPES = [*EXTENSIONS, "application/x-unknown", None]


@query(f"""WITH t AS (SELECT *, list_extract({[x or "" for x in TYPES]}, (page_id % {len(TYPES)} + 1)::BIGINT) AS content_type FROM pages)
SELECT page_id, coalesce(map_extract(map({list(EXTENSIONS)}, {list(EXTENSIONS.values())}), content_type)[1],
  nullif(lower(regexp_extract(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1), '[^.].*?(\\.[^.]+)$', 1)), ''), '.bin') AS extension FROM t""")
def q25_guess_extension(spark, d):
    kind = F.get(F.array(*map(F.lit, TYPES)), F.pmod("page_id", F.lit(len(TYPES))).cast("int"))
    return table(spark, d, "pages").select("page_id", guess_extension(kind, F.col("url")).alias("extension"))


@query("""WITH r AS (SELECT d.doc_id, CASE WHEN quality = 1 AND d.doc_id % 3 <> 0 THEN 'pdf/' || d.doc_id END AS pdf, CASE WHEN toxic = 0 AND d.doc_id % 5 <> 0 THEN 'text/' || d.doc_id END AS txt, CASE WHEN lang <> 'en' THEN source END AS url
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, coalesce(pdf, txt, url, '') AS source_used, CASE WHEN pdf IS NOT NULL THEN 'pdf' WHEN txt IS NOT NULL THEN 'text' WHEN url IS NOT NULL THEN 'url' END AS source_kind,
  CASE WHEN coalesce(pdf, txt, url) IS NULL THEN 'no usable input source found' END AS error FROM r""")
def q26_input_routing(spark, d):
    """Described PDFs and texts of which some aren't there: the next source serves."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    path = lambda folder, id_: F.concat(F.lit(folder), id_.cast("string"))
    inputs = rows.select("doc_id", F.when(F.col("quality") == 1, path("pdf/", F.col("doc_id"))).alias("pdf_path"), F.when(F.col("toxic") == 0, path("text/", F.col("doc_id"))).alias("text_path"), F.when(F.col("lang") != "en", F.col("source")).alias("protocol_url"))
    ids = table(spark, d, "documents").select("doc_id").distinct()
    pdfs = ids.filter("doc_id % 3 <> 0").select(path("pdf/", F.col("doc_id")).alias("path"), F.lit(b"%PDF").alias("content"))
    texts = ids.filter("doc_id % 5 <> 0").select(path("text/", F.col("doc_id")).alias("path"), F.lit("").alias("value"))
    return select.route_input(readers.with_contents(inputs, pdfs, texts), "auto", pdf_there="pdf_there", text_there="text_there").select("doc_id", "source_used", "source_kind", "error")


@query("""SELECT conv_id, string_agg('--- Page ' || (turn + 1) || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE regexp_matches(text, '[^\\s]') GROUP BY conv_id""".replace("\\\\", "\\"))
def q27_page_assemble(spark, d):
    pages = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), "text")
    return aggregate.join_pages(pages, "conv_id").select("conv_id", "text")


@query("""SELECT event_id, (props::JSON->>'k')::BIGINT AS k, '' AS k_text, event_type AS name, user_id % 2 = 0 AND event_type <> '' AS object, CASE WHEN user_id % 2 = 0 THEN '{"kind":"' || event_type || '"}' ELSE '{}' END AS nested FROM events""")
def q28_json_guards(spark, d):
    """A number, a string, and at some rows an object where others hold a list."""
    nested = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"kind": "'), "event_type", F.lit('"}'))).otherwise(F.lit("[1]"))
    whole = F.concat(F.lit('{"props": '), "props", F.lit(', "name": "'), "event_type", F.lit('", "nested": '), nested, F.lit("}"))
    events = table(spark, d, "events").select("event_id", F.try_parse_json(whole).alias("v"))
    found = F.to_json(F.expr(object_at("v", "$.nested")))
    return events.select("event_id", F.expr(integer_at("v", "$.props.k")).alias("k"), F.expr(string_at("v", "$.props.k")).alias("k_text"), F.expr(string_at("v", "$.name")).alias("name"), (found != "{}").alias("object"), found.alias("nested"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q29_skip_existing(spark, d):
    return select.skip_existing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'downloaded' WHEN quality = 1 THEN 'skipped' ELSE 'error' END AS status, count(*)::BIGINT AS n FROM labels GROUP BY ALL")
def q30_status_counts(spark, d):
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "downloaded").when(F.col("quality") == 1, "skipped").otherwise("error")
    return aggregate.status_counts(table(spark, d, "labels").select(status.alias("status")))


@query("SELECT doc_id, length(text)::BIGINT AS chars, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS newlines, trim(text, chr(10) || chr(9) || chr(13) || ' ') <> '' AS filled FROM documents")
def q31_newline_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), newline_count(F.col("text")).cast("long").alias("newlines"), (strip(F.col("text")) != "").alias("filled"))


# ---- reports and seams


@query(STAND_IN + """, by_model AS (SELECT model_name, count(*) AS runs, count(*) FILTER (WHERE ok) AS successes, coalesce(avg(library_similarity) FILTER (WHERE ok), 0) AS s, coalesce(avg(library_exact::INT) FILTER (WHERE ok), 0) AS e, coalesce(avg(ra) FILTER (WHERE ok), 0) AS r FROM scored GROUP BY 1),
by_region AS (SELECT model_name, gt_region AS region, avg(sequence_similarity) AS s, avg(sequence_exact::INT) AS e, avg(length_exact::INT) AS l, avg(region_exact::INT) AS r FROM region_row GROUP BY ALL)
SELECT section, line FROM (VALUES (1, ''), (1, 'Average by model:'), (2, ''), (2, 'Stratified by region:')) v(section, line)
UNION ALL SELECT 1, printf('  %s: similarity=%.3f exact=%.3f region=%.3f success=%d/%d', model_name, s::DOUBLE, e::DOUBLE, r::DOUBLE, successes, runs) FROM by_model
UNION ALL SELECT 2, printf('  %s | %s: seq=%.3f exact=%.3f len=%.3f type=%.3f', model_name, region, s::DOUBLE, e::DOUBLE, l::DOUBLE, r::DOUBLE) FROM by_region""")
def q32_report_lines(spark, d):
    scored = saved(stand_in(spark, d, measured=True, only=SUMMARY_FIELDS))
    return sinks.report_lines(aggregate.by_model(scored), aggregate.by_model_and_region(score.region_rows(scored, "model_name")))


@query(STAND_IN + """, rr AS (SELECT {'model_name': model_name, 'protocol_id': protocol_id, 'library_exact': library_exact, 'error': error} AS o, row_number() OVER (ORDER BY model_name, protocol_id) AS k FROM scored),
gg AS (SELECT {'model_name': model_name, 'protocol_id': protocol_id, 'gt_region': gt_region, 'pred_region': pred_region, 'sequence_exact': sequence_exact, 'char_exact': char_exact} AS o, row_number() OVER (ORDER BY model_name, protocol_id, segment_index) AS k FROM region_row)
SELECT CASE WHEN k > 1 THEN ', ' ELSE '' END || to_json(o)::VARCHAR AS value FROM rr UNION ALL SELECT CASE WHEN k > 1 THEN ', ' ELSE '' END || to_json(o)::VARCHAR FROM gg""")
def q33_json_envelope(spark, d):
    """The entries of the envelope's two lists."""
    scored = saved(stand_in(spark, d, only=("segment_index", "gt_region", "pred_region", "sequence_exact", "char_exact"), library=False).drop("library_similarity"))
    runs = sinks.json_entries(scored, ("model_name", "protocol_id", "library_exact", "error"), ("model_name", "protocol_id"))
    regions = sinks.json_entries(score.region_rows(scored, "model_name", "protocol_id"), ("model_name", "protocol_id", "gt_region", "pred_region", "sequence_exact", "char_exact"), ("model_name", "protocol_id", "segment_index"))
    return runs.select("value").unionByName(regions.select("value"))


def _echo(r: seams.Request) -> str:
    """A transport that answers with the text it is asked about, and fails on empty ones."""
    import json

    if not r.content:
        raise RuntimeError("Request failed: empty source")
    return json.dumps({"result": {"library_sequence": r.content.decode()}, "raw": r.model})


@query("SELECT conv_id, turn, CASE WHEN text <> '' THEN text ELSE '' END AS pred_library, CASE WHEN coalesce(text, '') = '' THEN 'Request failed: empty source' END AS error, CASE WHEN text <> '' THEN 'conversations' ELSE '' END AS source_used FROM conversations")
def q34_infer_seam(spark, d):
    runs = table(spark, d, "conversations").select("conv_id", "turn", F.lit("echo").alias("model"), F.lit("local").alias("api"), F.lit("text").alias("source_kind"), F.lit("conversations").alias("source_used"), F.col("text").alias("text_content"), F.lit(None).cast("string").alias("error"))
    return readers.predictions(seams.infer(runs, _echo)).select("conv_id", "turn", "pred_library", "error", "source_used")


def _lines(content: bytes) -> list[str]:
    return content.decode("utf-8", errors="replace").split("\n")


@query("SELECT page_id, unnest(range(1, len(l) + 1))::INT AS page, unnest(l) AS text FROM (SELECT page_id, string_split(coalesce(html, ''), chr(10)) AS l FROM pages)")
def q35_page_udtf(spark, d):
    seams.register_page_reader(spark, _lines)
    table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content")).createOrReplaceTempView("libgauge_pages")
    return spark.sql("SELECT page_id, p.page, p.text FROM libgauge_pages, LATERAL pages_of(content) p")


@query("SELECT source, length(string_agg(text, '' ORDER BY doc_id))::BIGINT AS chars, count(*)::BIGINT AS n FROM documents GROUP BY source UNION ALL SELECT lang, sum(length(text))::BIGINT, count(*)::BIGINT FROM documents GROUP BY lang")
def q36_union_counts(spark, d):
    docs = table(spark, d, "documents")
    count = lambda c: docs.groupBy(F.col(c).alias("source")).agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))
    return count("source").unionByName(count("lang"))


@query(STAND_IN + """, numbered AS (SELECT *, row_number() OVER (ORDER BY model_name, protocol_id) AS number, count(*) OVER () AS total FROM scored)
SELECT number::BIGINT AS run_number, printf('[%d/%d] %s | %s ...', number, total, model_name, protocol_id::VARCHAR) || CASE WHEN ok THEN printf(' similarity=%.3f region=%.3f', library_similarity, ra) ELSE ' ERROR: ' || error END AS line FROM numbered""")
def q37_progress_lines(spark, d):
    scored = stand_in(spark, d, measured=True, only=()).select("model_name", F.col("protocol_id").cast("string").alias("protocol_id"), F.col("protocol_id").alias("at"), "library_similarity", "ordered_region_accuracy", "error")
    scored = saved(scored)
    return sinks.progress_lines(select.run_numbers(scored, "model_name", "at"), scored.count())


@query("SELECT doc_id, length(text)::BIGINT AS chars, format('{:,}', length(text)) AS shown FROM documents WHERE text IS NOT NULL")
def q38_thousands(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.length("text").cast("long").alias("chars"), sinks.thousands(F.length("text")).alias("shown"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('us', ts)::BIGINT % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso, user_id::VARCHAR || '::' || event_type || '::x' AS label, event_type || '::x' AS rest FROM events")
def q39_times_and_labels(spark, d):
    """Stamps and ISO times, and labels split at their first ::."""
    events = table(spark, d, "events")
    labels = aggregate.region_labels(events.select("event_id", "ts", F.col("user_id").cast("string").alias("model_name"), F.concat("event_type", F.lit("::x")).alias("region")))
    return labels.select("event_id", sinks.stamp(F.col("ts")).alias("stamp"), sinks.isoformat(F.col("ts")).alias("iso"), "label", F.col("label_region").alias("rest"))


# ---- round 3


@query("""SELECT event_id, CASE user_id % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN user_id = 1 WHEN 4 THEN false WHEN 5 THEN event_type = 'view' ELSE true END AS placeholder_key_exact FROM events""")
def q40_map_value_equality(spark, d):
    """Placeholder maps whose numbers are written in other ways: equal by value, whatever their notation and place."""
    user, way = F.col("user_id").cast("string"), F.col("user_id") % 7
    told = F.when(way == 0, F.concat(user, F.lit(".0"))).when(way == 1, F.concat(user, F.lit("e0"))).when(way == 2, F.concat(user, F.lit("0E-1"))).when(way == 3, F.lit("true")).when(way == 4, F.concat(F.lit('"'), user, F.lit('"'))).otherwise(user)
    kind = F.when((way == 5) & (F.col("event_type") != "view"), "other").otherwise(F.col("event_type"))
    truth = F.concat(F.lit('{"n": ['), user, F.lit(', {"of": 0}], "kind": "'), "event_type", F.lit(' 1.0"}'))
    reply = F.concat(F.lit('{"result": {"placeholder_key": {"kind": "'), kind, F.lit(' 1.0", "n": ['), told, F.lit(', {"of": false}]}}}'))
    none = F.array().cast(f"array<{SEGMENT}>")
    runs = table(spark, d, "events").select("event_id", F.to_json(F.parse_json(truth)).alias("gt_placeholders"), reply.alias("response"), F.lit("").alias("gt_library"), none.alias("gt_segments"))
    return score.score_runs(readers.predictions(runs)).select("event_id", "placeholder_key_exact")


def answer_page(url: str) -> tuple[bytes, str | None, str]:
    """Stands for the web: a page says its address; addresses of one kind fail, of another move."""
    if url.endswith("3"):
        raise OSError("refused")
    return f"page {url}".encode(), "text/html" if url.endswith("5") else None, url + "/moved.PDF" if url.endswith("7") else url


@query("""SELECT url, CASE WHEN url LIKE '%3' THEN NULL ELSE 'page ' || url END AS content, CASE WHEN url LIKE '%3' THEN 'refused' END AS error,
  CASE WHEN url LIKE '%3' THEN NULL WHEN url LIKE '%7' THEN url || '/moved.PDF' ELSE url END AS final_url,
  CASE WHEN url LIKE '%3' THEN NULL WHEN url LIKE '%5' THEN '.html' WHEN url LIKE '%7' THEN '.pdf'
    ELSE coalesce(nullif(lower(regexp_extract(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1), '[^.].*?(\\.[^.]+)$', 1)), ''), '.bin') END AS extension
FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)""")
def q41_web_source(spark, d):
    """Every page's address through the data source, planned by host."""
    folder = f"{Store(spark).root}/plan"
    plan_requests(table(spark, d, "pages"), folder)
    got = read_web(spark, folder, getter="libgauge.plans.queries:answer_page")
    return got.select("url", F.decode("content", "UTF-8").alias("content"), "error", "final_url", F.when(F.col("error").isNull(), guess_extension(F.col("content_type"), F.col("final_url"))).alias("extension"))


@query(STAND_IN + """, by_model AS (SELECT model_name, count(*) AS runs, count(*) FILTER (WHERE ok) AS successes, coalesce(avg(library_similarity) FILTER (WHERE ok), 0) AS s, coalesce(avg(library_exact::INT) FILTER (WHERE ok), 0) AS e, coalesce(avg(ra) FILTER (WHERE ok), 0) AS r FROM scored GROUP BY 1),
by_region AS (SELECT model_name, gt_region AS region, avg(sequence_similarity) AS s, avg(sequence_exact::INT) AS e, avg(length_exact::INT) AS l, avg(region_exact::INT) AS r FROM region_row GROUP BY ALL),
shown AS (SELECT section, place, '' AS key, line FROM (VALUES (1, 0, ''), (1, 1, 'Average by model:'), (2, 0, ''), (2, 1, 'Stratified by region:')) v(section, place, line)
  UNION ALL SELECT 1, 2, model_name, printf('  %s: similarity=%.3f exact=%.3f region=%.3f success=%d/%d', model_name, s::DOUBLE, e::DOUBLE, r::DOUBLE, successes, runs) FROM by_model
  UNION ALL SELECT 2, 2, model_name || '::' || region, printf('  %s | %s: seq=%.3f exact=%.3f len=%.3f type=%.3f', model_name, region, s::DOUBLE, e::DOUBLE, l::DOUBLE, r::DOUBLE) FROM by_region)
SELECT row_number() OVER (ORDER BY section, place, key)::BIGINT AS number, line FROM shown""")
def q42_report_in_order(spark, d):
    """The report's lines with their places, as a reader of the ordered DataFrame meets them."""
    scored = saved(stand_in(spark, d, measured=True, only=SUMMARY_FIELDS))
    lines = sinks.report_lines(aggregate.by_model(scored), aggregate.by_model_and_region(score.region_rows(scored, "model_name")))
    return number_rows(lines.withColumn("at", F.monotonically_increasing_id()), "number", "at").select("number", "line")


# ---- readers, targets and bodies over JSON that the tables' rows make


def json_object(**fields: Column) -> Column:
    """JSON text of the fields whose values, JSON texts themselves, aren't null."""
    pairs = (F.when(v.isNotNull(), F.concat(F.lit(f'"{k}": '), v)) for k, v in fields.items())
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def json_string(x: Column) -> Column:
    text = F.to_json(F.struct(x.alias("x")))
    return F.when(x.isNotNull(), F.substring(text, F.lit(6), F.length(text) - 6))


@query("""WITH t AS (SELECT doc_id, coalesce(source, '') AS protocol_id, coalesce(text, '') AS protocol_name, CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END AS library_exact, CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id::DOUBLE / 7)::VARCHAR END AS duration FROM documents)
SELECT doc_id, concat_ws(',', protocol_id, CASE WHEN regexp_matches(protocol_name, '[",\r\n]') THEN '"' || replace(protocol_name, '"', '""') || '"' ELSE protocol_name END, '', '', '', '', '', duration, '', library_exact, '', '', '', '', '', '', '', '', '', '') AS line FROM t""")
def q43_run_csv_lines(spark, d):
    """Lines of the runs' CSV: text with commas, quotes and line ends, missing columns, nulls, booleans and doubles."""
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("protocol_id"), F.col("text").alias("protocol_name"), (F.col("doc_id") % 2 == 0).alias("library_exact"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") / 7.0).alias("duration_seconds"))
    view = sinks.csv_view(rows, ("doc_id", *sinks.RUN_COLUMNS))
    return view.select(F.col("doc_id").cast("long").alias("doc_id"), sinks.csv_line(*sinks.RUN_COLUMNS).alias("line"))


@query("""WITH t AS (SELECT conv_id, first(text ORDER BY turn) AS text, count(*) AS n, string_agg(role || turn, '|' ORDER BY turn) FILTER (WHERE turn % 2 = 0) AS names FROM conversations GROUP BY conv_id),
r AS (SELECT *, 'conv-' || conv_id || '.json' AS file_name, CASE conv_id % 4 WHEN 0 THEN 'conv-' || conv_id WHEN 1 THEN 'conv-' || conv_id ELSE 'id ' || conv_id END AS protocol_id,
  CASE conv_id % 3 WHEN 0 THEN '/root-dir/src/x-' || conv_id || '.pdf' WHEN 1 THEN '/abs/y.' || conv_id || '.pdf' END AS pdf_path FROM t WHERE conv_id % 10 <> 9)
SELECT file_name, protocol_id, CASE WHEN conv_id % 5 = 0 THEN protocol_id ELSE 'Name ' || conv_id END AS protocol_name, pdf_path, CASE WHEN conv_id % 2 = 0 THEN 'https://e.org/' || conv_id END AS protocol_url,
  CASE WHEN conv_id % 7 = 6 THEN '' ELSE text END AS library_sequence, coalesce(names, '') AS names, CASE WHEN conv_id % 2 = 0 THEN '{"U":"umi"}' ELSE '{}' END AS placeholders,
  CASE WHEN conv_id % 3 = 0 AND conv_id % 5 < 3 THEN 'texts/x-' || conv_id || '.txt' WHEN conv_id % 5 > 1 THEN 'texts/' || protocol_id || '.txt' END AS text_path FROM r""")
def q44_descriptions(spark, d):
    """Typed descriptions: default ids and names, guards against other types, list elements that are no objects, paths of
    PDFs, and texts found by the PDF's stem or the id."""
    c, n = table(spark, d, "conversations"), F.col("conv_id")
    number = n.cast("string")
    segment = json_object(name=json_string(F.concat("role", F.col("turn").cast("string"))), type=F.lit('"known"'), length=F.lit("true"))
    element = F.when(F.col("turn") % 2 == 0, segment).otherwise(F.lit("[3]"))
    whole = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", element.alias("x")))), lambda s: s["x"]), ", ").alias("segments"))
    refs = json_object(
        protocol_pdf=F.when(n % 3 == 0, json_string(F.concat(F.lit("src/x-"), number, F.lit(".pdf")))).when(n % 3 == 1, json_string(F.concat(F.lit("/abs/y."), number, F.lit(".pdf")))).otherwise(F.lit("7")),
        protocol_link=F.when(n % 2 == 0, json_string(F.concat(F.lit("https://e.org/"), number))).otherwise(F.lit("[]")),
    )
    doc = json_object(
        protocol_id=F.when(n % 4 == 0, F.lit('" "')).when(n % 4 == 1, F.lit(None).cast("string")).otherwise(json_string(F.concat(F.lit("id "), number))),
        protocol_name=F.when(n % 5 == 0, F.lit("null")).otherwise(json_string(F.concat(F.lit("Name "), number))), references=refs,
        library_sequence=F.when(n % 7 == 6, F.lit("[1]")).otherwise(json_string(F.col("text"))), segments=F.concat(F.lit("["), "segments", F.lit("]")), placeholder_key=F.when(n % 2 == 0, F.lit('{"U": "umi"}')).otherwise(F.lit('"none"')),
    )
    files = whole.select(F.concat(F.lit("conv-"), number, F.lit(".json")).alias("file_name"), F.parse_json(F.when(n % 10 == 9, F.lit("[1]")).otherwise(doc)).alias("doc"))
    ids = c.select("conv_id").distinct()
    own = F.when(n % 4 < 2, F.concat(F.lit("conv-"), number)).otherwise(F.concat(F.lit("id "), number))
    text = lambda where, name: ids.filter(where).select(F.concat(F.lit("texts/"), name, F.lit(".txt")).alias("path")).withColumn("file_name", F.substring_index("path", "/", -1))
    texts = text((n % 3 == 0) & (n % 5 < 3), F.concat(F.lit("x-"), number)).unionByName(text(n % 5 > 1, own))
    got = readers.protocols(files, texts, "/root-dir/")
    return got.select("file_name", "protocol_id", "protocol_name", "pdf_path", "protocol_url", "library_sequence", F.array_join(F.transform("segments", lambda s: s["name"]), "|").alias("names"), "placeholders", "text_path")


@query("""SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'page-' || page_id ELSE 'p ' || page_id END AS protocol_id,
  CASE WHEN page_id % 11 = 0 THEN 'invalid JSON' WHEN page_id % 5 = 1 THEN 'references.protocol_link must be a string or null' WHEN page_id % 5 = 2 THEN 'references.protocol_pdf must be a string or null' END AS issue,
  CASE WHEN page_id % 11 = 0 OR page_id % 5 IN (1, 2) THEN NULL WHEN page_id % 5 = 4 THEN url ELSE upper(url) END AS url,
  CASE WHEN page_id % 11 <> 0 AND page_id % 5 = 3 THEN 'src/' || page_id || '.pdf' END AS target_path
FROM (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 0 ELSE page_id END AS k, url FROM pages) WHERE page_id % 11 = 0 OR page_id % 13 NOT IN (1, 2)""".replace("'p ' || page_id END AS protocol_id", "CASE WHEN page_id % 11 = 0 THEN 'page-' || page_id ELSE 'p ' || page_id END END AS protocol_id"))
def q45_download_plan(spark, d):
    """Tolerant reading: invalid JSON and wrong types are issues, other documents are passed over, and an address in the
    PDF's place counts as the link."""
    n, number = F.col("page_id"), F.col("page_id").cast("string")
    refs = json_object(
        protocol_link=F.when(n % 5 == 0, json_string(F.upper("url"))).when(n % 5 == 1, F.lit("3")).when(n % 5 == 2, json_string(F.col("url"))).when(n % 5 == 3, json_string(F.upper("url"))).otherwise(F.lit("null")),
        protocol_pdf=F.when(n % 5 == 2, F.lit("{}")).when(n % 5 == 3, json_string(F.concat(F.lit("src/"), number, F.lit(".pdf")))).when(n % 5 == 4, json_string(F.col("url"))),
    )
    doc = F.when(n % 11 == 0, F.lit("{")).when(n % 13 == 1, F.lit("[]")).when(n % 13 == 2, F.lit('{"references": 3}')).otherwise(json_object(protocol_id=F.when(n % 9 == 0, F.lit("5")).otherwise(json_string(F.concat(F.lit(" p "), number, F.lit(" ")))), references=refs))
    files = table(spark, d, "pages").select(F.concat(F.lit("page-"), number, F.lit(".json")).alias("file_name"), F.try_parse_json(doc).alias("doc"))
    plan = readers.download_plan(files)
    return plan.select(F.regexp_extract("file_name", "-([0-9]+)", 1).cast("long").alias("page_id"), "protocol_id", "issue", "url", "target_path")


@query("""WITH t AS (SELECT page_id, 'p-' || page_id AS stem, page_id % 3 = 0 AS own, page_id % 2 = 0 AS html, page_id % 4 = 0 AS pdf, page_id % 6 = 0 AS own_there FROM pages),
e AS (SELECT *, CASE WHEN own THEN CASE WHEN own_there THEN '/r/src/' || page_id || '.pdf' END WHEN html THEN '/r/out/' || stem || '.html' WHEN pdf THEN '/r/out/' || stem || '.pdf' END AS existing,
  CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' WHEN 2 THEN '.pdf' ELSE '.bin' END AS extension FROM t)
SELECT page_id, extension, existing IS NOT NULL AS target_exists, CASE WHEN own THEN '/r/src/' || page_id || '.pdf' ELSE '/r/out/' || stem || extension END AS target,
  CASE WHEN own AND extension <> '.pdf' THEN 'p ' || page_id || ': target path /r/src/' || page_id || '.pdf does not match downloaded extension ' || extension END AS target_error,
  CASE WHEN existing <> CASE WHEN own THEN '/r/src/' || page_id || '.pdf' ELSE '/r/out/' || stem || extension END THEN existing END AS replaced FROM e""")
def q46_download_targets(spark, d):
    """Where downloads go: a described path or the id's name, what is there (the first of a stem by path), clashes of
    extensions, and files that a download replaces."""
    ids, n = table(spark, d, "pages").select("page_id"), F.col("page_id")
    number = n.cast("string")
    plan = ids.select("page_id", F.concat(F.lit("p "), number).alias("protocol_id"), F.when(n % 3 == 0, F.concat(F.lit("src/"), number, F.lit(".pdf"))).alias("target_path"))
    file = lambda where, *parts: ids.filter(where).select(F.concat(*parts).alias("path"))
    files = file(n % 2 == 0, F.lit("/r/out/p-"), number, F.lit(".html")).unionByName(file(n % 4 == 0, F.lit("/r/out/p-"), number, F.lit(".pdf"))).unionByName(file(n % 6 == 0, F.lit("/r/src/"), number, F.lit(".pdf")))
    kind, final = F.when(n % 5 == 0, "application/pdf").when(n % 5 == 1, "application/xhtml+xml"), F.when(n % 5 == 2, "https://e.org/a.b/c.PDF?x=y.z").otherwise("https://e.org/c")
    got = acquire.final_targets(acquire.plan_targets(plan, files, "/r", "/r/out").withColumns({"content_type": kind, "final_url": final}), "/r", "/r/out")
    return got.select("page_id", "extension", "target_exists", "target", "target_error", "replaced")


def told_body(r: seams.Request) -> str:
    """Answers with the body that the request would post."""
    return seams.multipart(*seams.request_parts(r), "xx").decode("utf-8", errors="replace")


@query("""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, chr(13) || chr(10) AS e FROM conversations)
SELECT conv_id, turn, '--xx' || e || 'Content-Disposition: form-data; name="model"' || e || e || role || e || CASE turn % 3
  WHEN 0 THEN '--xx' || e || 'Content-Disposition: form-data; name="file"; filename="' || conv_id || '.pdf"' || e || 'Content-Type: application/pdf' || e || e || text || e
  WHEN 1 THEN '--xx' || e || 'Content-Disposition: form-data; name="text"' || e || e || text || e
  ELSE '--xx' || e || 'Content-Disposition: form-data; name="url"' || e || e || 'https://e.org/' || conv_id || e END || '--xx--' || e AS body FROM t""")
def q47_request_bodies(spark, d):
    """What is posted for a PDF, a text and an address."""
    n, number = F.col("turn"), F.col("conv_id").cast("string")
    kind = F.when(n % 3 == 0, "pdf").when(n % 3 == 1, "text").otherwise("url")
    source = F.when(n % 3 == 2, F.concat(F.lit("https://e.org/"), number)).otherwise(F.concat(F.lit("/in/"), number, F.lit(".pdf")))
    rows = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), F.col("role").alias("model"), F.lit("x").alias("api"), kind.alias("kind"), source.alias("source"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    got = seams.ask(rows, told_body)
    part = lambda k: F.split("request_id", ":")[k].cast("long")
    return got.select(part(0).alias("conv_id"), part(1).alias("turn"), F.col("response").alias("body"))


@query("""SELECT (row_number() OVER (ORDER BY n_nationkey))::INT AS model_pos, CASE WHEN n_regionkey = 0 THEN 'id-' || n_nationkey WHEN n_regionkey = 1 THEN 'v/' || n_name ELSE n_name END AS name,
  CASE WHEN n_regionkey IN (0, 2) THEN 'id-' || n_nationkey ELSE 'v/' || n_name END AS model, 'https://e.org/' || n_regionkey AS api FROM nation""")
def q48_model_entries(spark, d):
    """A configuration's entries by place: names default to the model, models to the id, and spaces at the ends go."""
    n, key = table(spark, d, "nation"), F.col("n_nationkey").cast("string")
    region = F.col("n_regionkey")
    entry = json_object(
        name=F.when(region == 0, F.lit('" "')).when(region != 1, json_string(F.concat(F.lit(" "), "n_name"))), model=F.when(region == 0, F.lit('""')).when(region == 2, F.lit("3")).otherwise(json_string(F.concat(F.lit("v/"), "n_name", F.lit(" ")))),
        id=json_string(F.concat(F.lit("id-"), key)), api=json_string(F.concat(F.lit("https://e.org/"), region.cast("string"))),
    )
    listed = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("x")))), lambda s: s["x"]), ", ").alias("all"))
    return readers.model_rows(listed.select(F.concat(F.lit('{"models": ['), "all", F.lit("]}")).alias("value")))


@query("""SELECT event_id, '    {' || chr(10) || '      "event_id": ' || event_id || ',' || chr(10) || '      "kind": "' || event_type || ' \\u00e9\\"",' || chr(10) || '      "amount": ' || value || ',' || chr(10)
  || '      "even": ' || (user_id % 2 = 0) || ',' || CASE WHEN user_id % 3 = 0 THEN '' ELSE chr(10) || '      "error": null,' END || chr(10) || '      "of": {' || chr(10) || '        "user": [' || chr(10) || '          ' || user_id || chr(10) || '        ]' || chr(10) || '      }' || chr(10)
  || '    }' || CASE WHEN event_id = max(event_id) OVER () THEN '' ELSE ',' END AS entry FROM events""")
def q49_indented_entries(spark, d):
    """Entries of a list in the indented document: nested values, nulls, escapes, and fields that a row doesn't have."""
    user = F.col("user_id")
    rows = table(spark, d, "events").select("event_id", F.concat("event_type", F.lit(' é"')).alias("kind"), F.col("value").alias("amount"), (user % 2 == 0).alias("even"), F.lit(None).cast("string").alias("error"), F.struct(F.array(user).alias("user")).alias("of"), "user_id")
    entries = sinks.indented_entries(rows, ("event_id", "kind", "amount", "even", "error", "of"), ("event_id",), 2, dropped=F.when(user % 3 == 0, F.array(F.lit("error"))))
    return entries.select("event_id", F.col("value").alias("entry"))


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Invalid JSON from benchmark API' WHEN 1 THEN 'Benchmark API returned a non-object JSON response' END AS error,
  CASE WHEN turn % 5 < 3 THEN '' ELSE coalesce(role, '') END AS prediction_protocol_name, CASE turn % 5 WHEN 2 THEN '[3]' WHEN 3 THEN '{"protocol_name":"' || role || '"}' WHEN 4 THEN '{"protocol_name":"' || role || '","segments":[{"name":"s"},4]}' END AS prediction,
  CASE turn % 5 WHEN 3 THEN '{"by":' || conv_id || '}' WHEN 4 THEN '"text"' END AS raw_output, CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END AS n_segments FROM conversations""")
def q50_prediction_and_raw(spark, d):
    """Replies of every kind: the prediction and the model's raw output as they came, and what is taken from them."""
    kind = F.col("turn") % 5
    result = F.when(kind == 2, F.lit("[3]")).when(kind == 3, json_object(protocol_name=json_string(F.col("role")))).otherwise(json_object(protocol_name=json_string(F.col("role")), segments=F.lit('[{"name": "s"}, 4]')))
    raw = F.when(kind == 3, F.concat(F.lit('{"by": '), F.col("conv_id").cast("string"), F.lit("}"))).when(kind == 4, F.lit('"text"'))
    reply = F.when(kind == 0, F.lit("{")).when(kind == 1, F.lit("[{}]")).otherwise(json_object(result=result, raw=raw))
    got = readers.predictions(table(spark, d, "conversations").select("conv_id", "turn", "role", reply.alias("response")))
    return got.select("conv_id", "turn", "error", "prediction_protocol_name", "prediction", "raw_output", F.size("pred_segments").alias("n_segments"))


def answer_some(url: str) -> tuple[bytes, str | None, str]:
    """Stands for the web: some addresses fail, some are empty."""
    if url.endswith("1"):
        raise OSError("refused")
    return b"" if url.endswith("2") else url.encode(), "text/plain", url


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'skipped' WHEN url LIKE '%1' OR url LIKE '%2' THEN 'error' ELSE 'downloaded' END AS status,
  CASE WHEN page_id % 4 = 0 THEN page_id || ': no protocol_link URL' WHEN url LIKE '%1' THEN page_id || ': request failed for ' || url || ' (refused)' WHEN url LIKE '%2' THEN page_id || ': empty response from ' || url ELSE '' END AS message,
  CASE WHEN page_id % 4 <> 0 AND url NOT LIKE '%1' AND url NOT LIKE '%2' THEN url END AS content FROM pages""")
def q51_fetch_outcomes(spark, d):
    """What becomes of a download: no address, a failed request, an empty reply, content."""
    plan = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("protocol_id"), F.when(F.col("page_id") % 8 == 0, "").when(F.col("page_id") % 4 != 0, F.col("url")).alias("url"))
    return seams.fetch(plan, answer_some).select("page_id", "status", "message", F.decode("content", "UTF-8").alias("content"))


_FLAG = "CASE WHEN {0} IS NULL THEN '' WHEN {0} THEN 'True' ELSE 'False' END"


@query(STAND_IN + f"""SELECT concat_ws(',', protocol_id, model_name, segment_index, segment_name, gt_region, gt_region, pred_region, {_FLAG.format("region_exact")}, gt_length, pred_length, {_FLAG.format("length_exact")}, sequence_similarity,
  {_FLAG.format("sequence_exact")}, gt_chr, pred_chr, {_FLAG.format("char_exact")}, {_FLAG.format("pred_present")}) AS line
FROM (SELECT r.*, g.chr AS gt_chr, coalesce(p.chr, '') AS pred_chr FROM region_row r JOIN run USING (model_name, protocol_id) JOIN seg g ON g.conv_id = protocol_id AND g.idx = segment_index LEFT JOIN seg p ON p.conv_id = other_id AND p.idx = segment_index)""")
def q52_region_csv_lines(spark, d):
    """Lines of the regions' CSV, similarities to their last digit."""
    fields = [c for c in sinks.REGION_COLUMNS if c not in ("protocol_id", "model_name", "segment_index")]
    view = sinks.csv_view(region_fields(spark, d, ("protocol_id", "model_name"), *fields), sinks.REGION_COLUMNS)
    return view.select(sinks.csv_line(*sinks.REGION_COLUMNS).alias("line"))


@query("""WITH r AS (SELECT r_regionkey + 1 AS model_pos, trim(r_name) AS model_name, 'v/' || r_regionkey AS model_id, n_nationkey, lpad(n_nationkey::VARCHAR, 2, '0') || '.json' AS file_name,
  CASE WHEN n_regionkey = 0 THEN '/p/' || n_nationkey || '.pdf' END AS pdf, CASE WHEN n_regionkey < 2 THEN '/t/' || n_nationkey || '.txt' END AS txt, CASE WHEN n_regionkey < 4 THEN 'https://e.org/' || n_nationkey ELSE '' END AS url FROM region CROSS JOIN nation)
SELECT row_number() OVER (ORDER BY model_pos, file_name)::BIGINT AS run_number, model_name, model_id, 'x' AS api, 'auto' AS input_mode, file_name, coalesce(pdf, txt, nullif(url, ''), '') AS source_used,
  CASE WHEN pdf IS NOT NULL THEN 'pdf' WHEN txt IS NOT NULL THEN 'text' WHEN url <> '' THEN 'url' END AS source_kind, CASE WHEN pdf IS NULL AND txt IS NULL AND url = '' THEN 'no usable input source found' END AS error FROM r""")
def q53_planned_runs(spark, d):
    """Runs as they are planned, numbered model by model in path order."""
    region, n = F.col("n_regionkey"), F.col("n_nationkey").cast("string")
    models = table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("model_pos"), F.trim("r_name").alias("name"), F.concat(F.lit("v/"), F.col("r_regionkey").cast("string")).alias("model"), F.lit("x").alias("api"))
    chosen = table(spark, d, "nation").select(
        F.concat(F.lpad(n, 2, "0"), F.lit(".json")).alias("file_name"), F.when(region == 0, F.concat(F.lit("/p/"), n, F.lit(".pdf"))).alias("pdf_path"), F.when(region < 2, F.concat(F.lit("/t/"), n, F.lit(".txt"))).alias("text_path"),
        F.when(region < 4, F.concat(F.lit("https://e.org/"), n)).otherwise("").alias("protocol_url"),
    )
    planned = select.run_numbers(benchmark.plan_runs(models, chosen, "auto"), "model_pos", "file_name")
    return planned.select("run_number", "model_name", "model_id", "api", "input_mode", "file_name", "source_used", "source_kind", "error")


@query("SELECT page_id, page_id % 3 < 2 AS pdf, CASE page_id % 3 WHEN 0 THEN 'x.y' WHEN 1 THEN '.x' ELSE 'x' END AS stem FROM pages")
def q54_pdf_names(spark, d):
    """Names by their suffix, whatever its case; a name that begins with a dot has its last one as a suffix only."""
    n = F.col("page_id") % 3
    path = F.when(n == 0, "/in.pdf/x.y.PDF").when(n == 1, "/in/.x.pdf").otherwise("/in.pdf/x.pdfx")
    return table(spark, d, "pages").select("page_id", readers.is_pdf(path).alias("pdf"), path_stem(path).alias("stem"))


def split_lines(content: bytes) -> list[bytes]:
    if b"<title>" not in content:
        raise ValueError("no pages")
    return content.split(b"\n")


def misreader() -> Callable[[bytes], str]:
    return lambda image: image.decode().replace("a", "4")


@query("""SELECT page_id, CASE WHEN contains(html, '<title>') THEN rtrim(ltrim(replace(replace(html, 'a', '4'), chr(10), chr(10) || chr(10) || chr(10) || chr(10)), ' ' || chr(10)), ' ' || chr(10)) END AS text, CASE WHEN NOT contains(html, '<title>') THEN 'no pages' END AS error FROM pages WHERE html IS NOT NULL""")
def q55_ocr_pages(spark, d):
    """Documents read page by page over all tasks and joined in order; the recogniser takes an a for a 4."""
    docs = table(spark, d, "pages").filter("html IS NOT NULL").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return seams.ocr(docs, misreader, split_lines).select(F.col("path").cast("long").alias("page_id"), "text", "error")
