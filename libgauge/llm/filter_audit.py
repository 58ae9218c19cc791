"""Filter interaction audit: what each filter removes, in every order, from one CUBE.

Rows are reduced to failure flags, counted by part, flags and labels before anything is cubed.  The
CUBE over the flags and the part then holds, in its grouping-set rows whose selected flags are all
false, how many rows survive each subset of filters: 2 ** k numbers for a part, instead of one pass
for each of the k! orders.  A step of an order goes from the subset before it to the one with its
filter; joining those two gives what the step keeps and removes, and the steps of all orders only
look pairs up.

``flag_documents`` has the five filters, one of them ("an earlier row has this text") over the
whole table.  A text is known by its SHA-256.  Copies are counted by text, part and flags first, so
a text that a third of all rows share is a few rows when its copies meet.

Defined results: a null text is empty; a null part is the part ""; a null id has no label and is
neither a copy nor an original of others; rows that repeat an id and its text are copies of what
the least id is a copy of, all alike; a label holds if any of its rows says 1; labels without a
document count nowhere; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Workspace

#: The five filters, by the letters of their failure conditions.
LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 2
SPACE = " \t\n\v\f\r"
COUNTED = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """A: under 200 words; B: under 50 % distinct words; C: over 2 % of A-Z; D: any of #$%&*|."""
    inner = F.btrim(text, F.lit(SPACE))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.lit(100).cast("long") * F.size(F.array_distinct(words)) < F.lit(MIN_DISTINCT).cast("long") * F.size(words),
        "C": F.lit(100).cast("long") * upper > F.lit(MAX_UPPER).cast("long") * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flag_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, A to E, n, good, toxic: rows of a part with the same flags, counted."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    flags = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("mark"), *(c.alias(k) for k, c in text_flags(F.col("text")).items()))
    apart = flags.groupBy("doc_id", "mark", "part", *"ABCD").agg(F.count(F.lit(1)).alias("n"))
    # Null ids have no label: they are spread by their text, so that they don't meet in one task.
    salt = F.when(F.col("doc_id").isNull(), F.lit(1) + F.pmod(F.xxhash64("mark"), F.lit(1 << 20))).otherwise(F.lit(0))
    known = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")).filter("of IS NOT NULL AND (quality = 1 OR toxic = 1)")
    known = known.groupBy("of").agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("is_good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("is_toxic"))
    told = apart.withColumns({"key": F.coalesce("doc_id", F.lit(0).cast("long")), "salt": salt.cast("long")}).join(known.select(F.col("of").alias("key"), F.lit(0).cast("long").alias("salt"), "is_good", "is_toxic"), ["key", "salt"], "left")
    # n rows of a text in a part, of which ``first`` have its least id, and how many rows have no id.
    kinds = ["mark", "part", *"ABCD", "is_good", "is_toxic"]
    copies = told.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
    )
    least = F.min("least").over(Window.partitionBy("mark"))
    own = F.when(F.col("least") == least, F.col("first.n")).otherwise(F.lit(0)) + F.col("no_id")
    held = copies.withColumn("own", F.coalesce(own, F.lit(0).cast("long")))
    both = held.withColumn("by", F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("own").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("own")).alias("n")))))
    count = F.col("by.n")
    return both.filter(count > 0).groupBy("part", *"ABCD", F.col("by.E").alias("E")).agg(
        F.sum(count).alias("n"), F.coalesce(F.sum(count * F.col("is_good")), F.lit(0).cast("long")).alias("good"), F.coalesce(F.sum(count * F.col("is_toxic")), F.lit(0).cast("long")).alias("toxic"))


def survivors(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part (null: all parts), subset (bit i: filter i is applied), n, good, toxic: what is left of each
    part after each subset of filters, from one CUBE over flags and part.  Subsets without survivors have
    no row."""
    cubed = counted.cube(*(F.col(c) for c in letters), "part").agg(*(F.sum(x).alias(x) for x in COUNTED), F.grouping_id().alias("aggregated"))
    k = len(letters)
    # grouping_id has a bit for each column, the first one highest, that is set where it is not selected
    selected = {c: F.col("aggregated").bitwiseAND(F.lit(1 << (k - i))) == 0 for i, c in enumerate(letters)}
    passed = cubed
    for c in letters:
        passed = passed.filter(~selected[c] | ~F.col(c))
    subset = sum((F.when(selected[c], F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(letters)), F.lit(0))
    return passed.select(F.when(F.col("aggregated").bitwiseAND(F.lit(1)) == 0, F.col("part")).alias("part"), subset.alias("subset"), *COUNTED)


def orders(letters: str = LETTERS) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, number of its filter, subset applied before it) for all orders."""
    out = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order, 1):
            out.append(("".join(letters[j] for j in order), step, i, before))
            before |= 1 << i
    return out


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part (null: all parts together), filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley: len(letters)! orders and their steps for each part, zeros included."""
    k = len(letters)
    everything = (1 << k) - 1
    spark = counted.sparkSession
    passed = Workspace(spark, "audit").save(survivors(counted, letters), "survivors")
    # All subsets of each part, those without survivors too: 2 ** k rows a part.
    every = passed.filter("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(everything))).alias("subset"), *(F.lit(0).cast("long").alias(x) for x in COUNTED))
    left = passed.unionByName(every).groupBy("part", "subset").agg(*(F.sum(x).alias(x) for x in COUNTED))
    # A pair of subsets for each filter and each subset without it.
    pairs = left.select("part", F.col("subset").alias("before"), *(F.col(x).alias(f"{x}_before") for x in COUNTED), F.explode(F.array(*(F.struct(F.lit(i).alias("filter"), F.lit(1 << i).alias("bit")) for i in range(k)))).alias("f")).filter(F.col("before").bitwiseAND(F.col("f.bit")) == 0)
    after = left.select(F.col("part").alias("of"), F.col("subset").alias("after"), *(F.col(x).alias(f"{x}_after") for x in COUNTED))
    joined = pairs.join(after, F.col("part").eqNullSafe(F.col("of")) & (F.col("before").bitwiseOR(F.col("f.bit")) == F.col("after")))
    size = F.bit_count("before")
    ways = F.element_at(F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)).cast("long") for s in range(k))), size + 1)
    steps = joined.select("part", "before", F.col("f.filter").alias("filter"), F.col("n_after").alias("kept"), (F.col("n_before") - F.col("n_after")).alias("removed"), (F.col("good_before") - F.col("good_after")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"), ways.alias("ways"))
    whole = steps.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"), F.max(F.when(size == k - 1, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * F.col("ways")).alias("shapley")
    ).withColumnsRenamed({"part": "of", "filter": "whose"})
    told = steps.join(whole, F.col("part").eqNullSafe(F.col("of")) & (F.col("filter") == F.col("whose")))
    listed = F.broadcast(spark.createDataFrame(orders(letters), "filter_order string, step int, whose_step int, subset int"))  # k * k! rows, whatever the data
    return told.join(listed, (F.col("filter") == F.col("whose_step")) & (F.col("before") == F.col("subset"))).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = flag_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audit(counted).filter("part IS NOT NULL")


#: DuckDB: every document through every order, one by one.
OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT row_number() OVER () AS r, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, k AS step, filter_order[k] AS x FROM o, range(1, 6) t(k) WHERE length(filter_order) = 5),
met AS (  -- the step that removes a row, 6 for none
  SELECT r, part, good, toxic, fails, filter_order, coalesce(list_min(list_transform(list_filter(range(1, 6), lambda k: contains(fails, filter_order[k])), lambda k: k)), 6) AS gone FROM f, o WHERE length(filter_order) = 5),
c AS (
  SELECT part, filter_order, step, x, count(*) FILTER (WHERE gone > step) AS kept, count(*) FILTER (WHERE gone = step) AS removed, count(*) FILTER (WHERE gone < step AND contains(fails, x)) AS redundant,
    count(*) FILTER (WHERE fails = x) AS unique_fails, coalesce(sum(good) FILTER (WHERE gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE gone = step), 0) AS toxic_lost
  FROM met JOIN s USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM c
"""
