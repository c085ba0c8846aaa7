"""Filter interaction audit: what each filter removes after every order of the others.

The orders of the filters form a trie of prefixes. It is walked depth first: each step filters the persisted survivors of
the step before and counts, by part, what every filter that is left removes from them. Prefixes that hold the same filters
leave the same survivors, so that an unordered prefix is met once and remembered: 2**n states and n * 2**(n-1) edges stand
for all n! orders. Counts go to a table in the shared folder; no part, document or count passes through the driver.

Survivors hold a part, the flags and the labels, never texts: these are read once, to judge each filter.

Defined results: a null text counts as empty, a null part as the empty string; repeated rows are documents of their own;
of documents with one text all but those of the smallest id repeat it, a null id neither repeats nor is repeated; a document
without a label is neither good nor toxic, one with several is what any of them says; a part that no document is left in
keeps its rows with zeros; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.shared import fresh_path, materialize

BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def too_short(text: Column) -> Column:
    return F.size(words_of(text)) < 50


def too_repetitive(text: Column) -> Column:
    words = words_of(text)
    return 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long")


def too_loud(text: Column) -> Column:
    """Share of upper-case ASCII letters among code points."""
    size = F.length(text).cast("long")
    return 100 * (size - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 5 * size


def has_symbols(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Each filter's condition of failure on a text; E is added by repeated().
FILTERS: dict[str, Callable[[Column], Column]] = {"A": too_short, "B": too_repetitive, "C": too_loud, "D": has_symbols}


def judged(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]], repeats: str | None, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, good, toxic and a flag for each filter, one row for each document. Texts are read here only, once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("content"),
        *(fails(text).alias(name) for name, fails in filters.items()),
    )
    read = materialize(read, "judged")
    if repeats:
        # one row for each text that several ids share; written, so that the join's sides can be split where a text is hot
        first = read.groupBy("content").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
        first = materialize(first, "first")
        read = read.join(first, "content", "left").withColumn(repeats, F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)) == 1
    marks = materialize(labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")), "marks")
    names = [*filters, *([repeats] if repeats else [])]
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return materialize(read.join(marks, "id", "left").select("part", flag("good"), flag("toxic"), *map(flag, names)), "flags")


def edge_counts(flags: DataFrame, names: list[str]) -> DataFrame:
    """part, edge, n, removed, good_lost, toxic_lost for each unordered prefix and each filter that is not in it.

    edge is the prefix as a bit set times the number of filters, plus the filter's place. One job for each prefix, over what
    its filters have left; at most one persisted table for each level of the trie is held at a time.
    """
    path, known = fresh_path(flags.sparkSession, "edges"), set()

    def walk(prefix: int, survivors: DataFrame) -> None:
        known.add(prefix)
        left = [i for i in range(len(names)) if not prefix >> i & 1]
        if not left:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        counts = []
        for i in left:
            gone = F.col(names[i])
            counts += [F.count_if(gone).alias(f"removed{i}"), F.count_if(gone & F.col("good")).alias(f"good{i}"), F.count_if(gone & F.col("toxic")).alias(f"toxic{i}")]
        by_part = survivors.groupBy("part").agg(F.count("*").alias("n"), *counts)
        edge = lambda i: F.struct(F.lit(prefix * len(names) + i).alias("edge"), "n", F.col(f"removed{i}").alias("removed"), F.col(f"good{i}").alias("good_lost"), F.col(f"toxic{i}").alias("toxic_lost"))
        by_part.select("part", F.inline(F.array(*map(edge, left)))).write.mode("append").parquet(path)
        for i in left:
            if prefix | 1 << i not in known:
                walk(prefix | 1 << i, survivors.where(~F.col(names[i])))
        survivors.unpersist()

    walk(0, flags)
    return flags.sparkSession.read.schema("part string, edge int, n long, removed long, good_lost long, toxic_lost long").parquet(path)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] = FILTERS, repeats: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part,
    order of the filters and step. Filters have names of one letter; repeats names that of repeated texts, None leaves it out."""
    names = [*filters, *([repeats] if repeats else [])]
    n, everything = len(names), (1 << len(names)) - 1
    counts = edge_counts(judged(docs, labels, filters, repeats, id_col, text_col, part_col), names)
    # at most n * 2**(n-1) entries for each part; a prefix that leaves a part nothing has none
    by_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("edge", F.struct("n", "removed", "good_lost", "toxic_lost").alias("c")))).alias("edges"))
    at = F.instr(F.lit("".join(names)), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    prefix = sum((F.when(F.instr("filter_order", x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(names)), F.lit(0))
    count = lambda state, what, f=F.col("f"): F.coalesce(F.try_element_at("edges", (state * n + f).cast("int")).getField(what), F.lit(0))
    share = lambda i: sum((factorial(size := s.bit_count()) * factorial(n - 1 - size) * count(F.lit(s), "removed", F.lit(i)) for s in range(everything + 1) if not s >> i & 1), F.lit(0))
    whole = by_part.withColumns({"shares": F.array(*map(share, range(n))), "only": F.array(*(count(F.lit(everything & ~(1 << i)), "removed", F.lit(i)) for i in range(n)))})
    orders = whole.withColumn("filter_order", F.explode(F.split(F.lit(",".join(map("".join, permutations(names)))), ",")))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumns({"f": at, "prefix": prefix})
    now = lambda what: count(F.col("prefix"), what)
    return steps.select(
        "part", "filter_order", "step", (now("n") - now("removed")).alias("kept"), now("removed").alias("removed"), (count(F.lit(0), "removed") - now("removed")).alias("redundant"),
        F.get("only", "f").alias("unique_fails"), now("good_lost").alias("good_lost"), now("toxic_lost").alias("toxic_lost"), F.get("shares", "f").alias("shapley"),
    )
