"""Filter interaction audit: what each filter removes in every order of applying them.

The orders are the paths of a permutation trie. It is walked depth first: the state of a path is the
DataFrame of the rows that survive its filters, persisted and derived from its parent's. States that hold
the same filters in another order hold the same rows, so each unordered set is visited once and its
successors are found in a memo: 2**n states instead of n! paths. At each state one aggregation counts,
for each part and each filter still to come, what that edge removes. The counts, a few rows a part and
state, are written to the shared folder and read back as the edges of the trie.

All of it is built-in functions; what a lost executor held is computed again from the stored verdicts.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import dropped, read, shared_folder, stored

#: Fixed values of the five filters: a text fails A with fewer words, B with a smaller share of distinct
#: words, C with a larger share of capitals, D with any of these characters, E as a copy of a smaller id's.
WORD_GAPS = r"[\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 50, 65, 5
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = r"[#$%&*|]"
#: Rows without a key are spread over so many values, for a null key may stand in a third of all rows.
SPREAD = 1 << 20


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null."""
    words = F.filter(F.split(text, WORD_GAPS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * distinct < DISTINCT_PERCENT * n,
        "C": 100 * capitals > CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, good, toxic, A, B, C, D, E) of every row; the last five say which filters it fails.

    A null text counts as empty, a null part as the empty string. E compares SHA-256 digests of whole texts.
    A row without a key is no copy of any and makes none; rows that share key and text are no copies of each
    other. A document is good or toxic if any row of ``labels`` with its key says 1.

    Rows meet the first key of their text by their own key, not by their text, so that copies of one text
    stay spread however many they are.
    """
    x, k = F.coalesce(F.col(text), F.lit("")), F.col(key)
    digest, salt = F.unhex(F.sha2(x, 256)), F.when(k.isNull(), F.pmod(F.xxhash64(x, F.monotonically_increasing_id()), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
    rows = docs.select(k.alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), digest.alias("digest"), salt.alias("salt"), *(c.alias(n) for n, c in text_filters(x).items()))
    rows = stored(rows, "verdicts")
    first = rows.where("key is not null").groupBy("digest").agg(F.min("key").alias("key"))
    first = first.select("key", "digest", F.lit(0).cast("long").alias("salt"), F.lit(True).alias("first"))
    said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), F.lit(0).cast("long").alias("salt")).agg(
        *(F.max((F.col(c) == 1).cast("int")).alias(n) for n, c in (("good", "quality"), ("toxic", "toxic")))
    )
    found = rows.join(first, ["key", "salt", "digest"], "left").join(said, ["key", "salt"], "left")
    copied = F.col("key").isNotNull() & F.col("first").isNull()
    made = found.select("part", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("good", "toxic")), "A", "B", "C", "D", copied.alias("E"))
    out = stored(made, "verdicts")
    dropped(rows)
    return out


def audit(rows: DataFrame, filters: str = "ABCDE", part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``rows``: the part, 0 or 1 whether a row is good and toxic, and a boolean for each filter, named by its
    letter, that says whether the row fails it (null: it does not). A row for each part, order of the
    filters and step, zeros included. ``shapley`` is what the step's filter removes, summed over all orders.
    Extra columns are not read; rows without parts, an empty table, give an empty result.
    """
    spark = rows.sparkSession
    letters = list(filters)
    base = rows.select(F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(good).alias("good"), F.col(toxic).alias("toxic"), *(F.coalesce(F.col(x), F.lit(False)).alias(x) for x in letters))
    folder = shared_folder(spark, "edges")
    known: set[frozenset] = set()

    def visit(state: frozenset, survivors: DataFrame) -> None:
        known.add(state)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        left = [x for x in letters if x not in state]
        lost = [F.struct(F.lit(x).alias("filter"), *(F.sum(F.when(F.col(x), v).otherwise(0)).alias(n) for n, v in (("removed", F.lit(1)), ("good_lost", F.col("good")), ("toxic_lost", F.col("toxic"))))) for x in left]
        counted = survivors.groupBy("part").agg(F.array(*lost).alias("lost"), F.count("*").alias("n"))
        counted.select("part", F.lit("".join(sorted(state))).alias("state"), "n", F.inline("lost")).write.mode("append").parquet(folder)
        for x in left:
            after = state | {x}
            if after not in known and len(after) < len(letters):
                visit(after, survivors.where(~F.col(x)))
        survivors.unpersist()

    visit(frozenset(), base)
    edges = spark.read.schema("part string, state string, n long, filter string, removed long, good_lost long, toxic_lost long").parquet(folder)
    steps = [("".join(p), i + 1, "".join(sorted(p[:i])), p[i]) for p in permutations(letters) for i in range(len(p))]
    path = spark.createDataFrame(steps, "filter_order string, step int, state string, filter string")  # n! times n rows
    whole = edges.where("state = ''").select("part", "filter", F.col("removed").alias("fails"))
    alone = edges.where(F.length("state") == len(letters) - 1).select("part", "filter", F.col("removed").alias("only"))
    times = F.element_at(F.array(*(F.lit(factorial(i) * factorial(len(letters) - 1 - i)) for i in range(len(letters)))), F.length("state") + 1)
    shapley = edges.groupBy("part", "filter").agg(F.sum(times * F.col("removed")).alias("shapley"))
    parts = whole.join(alone, ["part", "filter"], "left").join(shapley, ["part", "filter"], "left")
    at = parts.join(F.broadcast(path), "filter").join(edges, ["part", "state", "filter"], "left")
    # a part of which nothing is left has no edge
    gone = F.coalesce("removed", F.lit(0))
    return at.select(
        "part", "filter_order", "step",
        (F.coalesce("n", F.lit(0)) - gone).alias("kept"),
        gone.alias("removed"),
        (F.col("fails") - gone).alias("redundant"),
        F.coalesce("only", F.lit(0)).alias("unique_fails"),
        F.coalesce("good_lost", F.lit(0)).alias("good_lost"),
        F.coalesce("toxic_lost", F.lit(0)).alias("toxic_lost"),
        "shapley",
    )




def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, order of the five filters and step, what the step removes."""
    return audit(verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable] = {"op12_filters": op12_filters}

_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS first_id FROM d),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS fails
    FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT a || b || c || d || e AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t1(a), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t2(b),
        (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t3(c), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t4(d), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t5(e)
    WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, 1 << (ascii(filter_order[i]) - 65) AS bit,
        CAST(coalesce(list_sum([1 << (ascii(z) - 65) FOR z IN string_split(filter_order[1:i - 1], '') IF z <> '']), 0) AS INTEGER) AS earlier
    FROM o, range(1, 6) AS t(i)),
r AS (SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (WHERE fails & (earlier | bit) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (WHERE fails & earlier = 0 AND fails & bit <> 0), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE fails & earlier <> 0 AND fails & bit <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (WHERE fails = bit), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE fails & earlier = 0 AND fails & bit <> 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE fails & earlier = 0 AND fails & bit <> 0), 0) AS toxic_lost
    FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""

ORACLE_SQL: dict[str, str] = {"op12_filters": _SQL}
