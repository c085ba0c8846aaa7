"""Summaries of entities: what a model is told of each kind, batches within a budget, replies, and the run over stale ones."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.config import Summary
from wayfinder.functions.text import first_of
from wayfinder.operators.incremental import component_profile, related_names, repo_profile, stale_summaries
from wayfinder.operators.lookup import summary_candidates
from wayfinder.plans.models import Provider, in_flight, retried, tolerant_json
from wayfinder.schema import Model, component_parts

# Lines of a snippet; lines and UTF-8 bytes of an excerpt; names and paths that a profile lists.
SNIPPET_LINES, EXCERPT_LINES, EXCERPT_BYTES = 200, 120, 6_000
LISTED_NAMES, LISTED_SOURCES, LISTED_DOCS, LISTED_OF_REPO = 8, 8, 6, 10
#: Tokens of a model's window; kept free as a margin; counted for a reply where no other bound is set.
WINDOW, MARGIN, REPLY = 8192, 256, 512

TASK = "Summarise the code base entities below from what is stated here only. Reply with JSON and nothing else."
ONE = 'One object: {"short_summary": one sentence, "detailed_summary": two sentences, "keywords": up to four words}.'
MANY = 'An object {"summaries": [...]} with one object for each entity: {"entity_id": as given, "short_summary": one sentence, "detailed_summary": two sentences, "keywords": up to four words}.'


def lines_of(text: Column) -> Column:
    """Lines without their ends; a last end of line begins no further one."""
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")


def snippet(text: Column, first: Column, last: Column, most: int = SNIPPET_LINES) -> Column:
    """Lines first to last (from 1; without a last, the first alone), ``most`` at most; null beyond the text's end or for none."""
    begin = F.greatest(F.coalesce(first, F.lit(1)), F.lit(1))
    n = F.least(F.greatest(F.coalesce(last, begin) - begin + 1, F.lit(0)), F.lit(most))
    return F.when((text != "") & (begin <= F.size(lines_of(text))) & (n > 0), F.array_join(F.slice(lines_of(text), begin, n), "\n"))


def first_bytes(text: Column, most: int) -> Column:
    """The longest beginning of whole characters within so many UTF-8 bytes."""
    # a character that the bound cuts counts as one that is replaced
    begun = F.length(F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string")))
    cut = F.left(text, begun)
    return F.when(F.octet_length(text) <= most, text).when(F.octet_length(cut) <= most, cut).otherwise(F.left(text, begun - 1))


def excerpt(text: Column, most_lines: int = EXCERPT_LINES, most_bytes: int = EXCERPT_BYTES) -> Column:
    """The first lines of a document, within both bounds; null for one without visible text."""
    cut = first_bytes(F.array_join(F.slice(lines_of(text), 1, most_lines), "\n"), most_bytes)
    return F.when(F.trim(F.regexp_replace(cut, r"\s+", " ")) != "", cut)


def described(*facts: tuple[str, Column]) -> Column:
    """Lines of 'name: fact'."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit(""))) for name, value in facts))


def identity(path: Column | None = None) -> tuple[tuple[str, Column], ...]:
    return (("Entity ID", F.col("id")), ("Entity", F.col("name")), ("Kind", F.col("kind")), ("Path", F.coalesce(path if path is not None else F.col("path"), F.lit("."))))


def prompt_inputs(m: Model, contents: DataFrame, exported_only: bool = True) -> DataFrame:
    """entity_id, component_id, kind, prompt, source_hash of all entities that get a summary and have a source. contents: path, content."""
    work = summary_candidates(m.entities, exported_only).drop("work_order")
    with_text = work.where("kind in ('symbol', 'doc')").join(contents.select("path", "content"), "path")
    source = F.when(F.col("kind") == "doc", excerpt(F.col("content"))).otherwise(snippet(F.col("content"), F.col("line_start"), F.col("line_end")))
    where = F.when(F.col("kind") == "symbol", F.concat(F.lit("\nLines: "), F.coalesce("line_start", F.lit(0)), F.lit("-"), F.coalesce("line_end", F.lit(0)))).otherwise("")
    texts = with_text.withColumn("source", source).where("source is not null").withColumn("prompt", F.concat(described(*identity()), where, F.lit("\nText:\n"), F.col("source")))

    owned = component_profile(m.entities, max(LISTED_SOURCES, LISTED_DOCS)).withColumnRenamed("component_id", "id")
    due = work.where("kind = 'component'")
    needs, linked = (related_names(m.entities, m.edges, rel, due, LISTED_NAMES).select(F.col("src_id").alias("id"), F.col("names").alias(name), F.col("n").alias(f"n_{name}")) for rel, name in (("depends_on", "needs"), ("documented_by", "linked")))
    components = due.join(owned, "id", "left").join(needs, "id", "left").join(linked, "id", "left")
    none = F.array().cast("array<string>")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    list_of = lambda c, n, total: F.concat(F.lit("\n"), first_of(F.coalesce(F.col(c), none), n, number(total)))
    by_link = number("n_linked") > 0
    docs = components.withColumns({"linked": F.when(by_link, F.col("linked")).otherwise(F.col("docs")), "n_linked": F.when(by_link, F.col("n_linked")).otherwise(F.col("n_doc"))})
    profile = described(
        *identity(), ("Ecosystem", component_parts(F.col("id"))[0]), ("Source files", number("n_source_unit")), ("Symbols", number("n_symbol")), ("Tests", number("n_test")), ("Benches", number("n_bench")),
        ("Direct dependencies", list_of("needs", LISTED_NAMES, "n_needs")), ("Linked documents", list_of("linked", LISTED_NAMES, "n_linked")), ("Source paths", list_of("sources", LISTED_SOURCES, "n_source_unit")), ("Document paths", list_of("docs", LISTED_DOCS, "n_doc")),
    )
    whole = repo_profile(m.entities).withColumn("kind", F.lit("repo"))  # one row
    names = [c for c in whole.columns if c.startswith("n_")]
    lines = lambda c: F.concat(F.lit("\n"), first_of(F.coalesce(F.col(c), none), LISTED_OF_REPO, F.col("n_component" if c == "components" else "n_doc")))
    repo = work.where("kind = 'repo'").join(F.broadcast(whole), "kind").withColumn("prompt", described(*identity(), *((c[2:].replace("_", " "), F.col(c)) for c in names), ("Key components", lines("components")), ("Key documents", lines("docs"))))
    keep = lambda df, hashed: df.select(F.col("id").alias("entity_id"), "component_id", "kind", "prompt", F.sha2(hashed, 256).alias("source_hash"))
    return keep(texts, F.col("source")).unionByName(keep(docs.withColumn("prompt", profile), F.col("prompt"))).unionByName(keep(repo, F.col("prompt")))


def words_and_marks(text: str) -> int:
    """Tokens of a text where no model's own count is given: a word's letters in fours, every other mark one."""
    import re

    return sum(-(-len(x) // 4) for x in re.findall(r"\w+|[^\w\s]", text))


def in_budget(rows: Iterable, size: int, symbol: Callable, tokens: Callable, fixed: int, reply: int, window: int = WINDOW - MARGIN) -> Iterator[list]:
    """Rows in order as batches: symbols one after another as long as they are ``size`` at most and their tokens, what a batch
    always has and a reply for each fit the window (one fits always), anything else alone."""
    batch, used = [], fixed
    for row in rows:
        need = tokens(row) + reply
        if batch and (not symbol(row) or not symbol(batch[-1]) or len(batch) >= size or used + need > window):
            yield batch
            batch, used = [], fixed
        batch.append(row)
        used += need
    if batch:
        yield batch


def prompt_for(batch: list[tuple]) -> str:
    """For rows (entity_id, kind, prompt, ...)."""
    if len(batch) == 1:
        return f"{TASK}\n\n{batch[0][2]}\n\n{ONE}"
    return "\n\n".join([TASK, *(f"Entity {i}:\n{row[2]}" for i, row in enumerate(batch, 1)), MANY])


def replies(provider: Provider, batch: list[tuple], max_tokens: int) -> dict[str, dict]:
    """Good summaries by entity; a batch that fails, or a part of it that is missing, is asked for one by one."""

    def ask(part: list[tuple]) -> dict | None:
        try:
            return tolerant_json(retried(lambda: provider.complete(prompt_for(part), max_tokens * len(part))))
        except Exception:  # whatever a provider breaks with costs its batch, not the run
            return None

    found: dict[str, dict] = {}
    if len(batch) > 1:
        given = (ask(batch) or {}).get("summaries")
        known = {row[0] for row in batch}
        for one in given if isinstance(given, list) else []:
            if isinstance(one, dict) and one.get("entity_id") in known and one.get("short_summary"):
                found[one["entity_id"]] = one
    for row in batch:
        if row[0] not in found and (one := ask([row])) and one.get("short_summary"):
            found[row[0]] = one
    return found


def summarise(work: DataFrame, make: Callable[[], Provider], config: Summary | None = None, tokens: Callable[[str], int] = words_and_marks) -> DataFrame:
    """Rows of summaries for work (of prompt_inputs); what got none is due again next time. Components are spread over tasks;
    within one, symbols go in batches in order of id, and ``concurrency`` batches are asked at once, whose rows keep their order."""
    c = config or Summary()
    fixed = tokens(TASK) + tokens(MANY)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        rows = (row for f in frames for row in zip(*(f[x] for x in ("entity_id", "kind", "prompt", "source_hash", "component_id")), strict=True))
        same = lambda a: a[1] == "symbol"
        batches, waiting = in_budget(rows, c.batch_size, same, lambda r: tokens(r[2]), fixed, c.max_tokens or REPLY), deque()

        def calls():
            for batch in batches:
                waiting.append(batch)
                yield partial(replies, provider, batch, c.max_tokens or REPLY)

        for found in in_flight(calls(), c.concurrency):
            batch = waiting.popleft()
            words = lambda x: [str(w) for w in x] if isinstance(x, list) else []
            out = [(i, str(r["short_summary"]), None if r.get("detailed_summary") is None else str(r["detailed_summary"]), words(r.get("keywords")), h) for i, _, _, h, _ in batch if (r := found.get(i))]
            yield pd.DataFrame(out, columns=["entity_id", "short_summary", "detailed_summary", "keywords", "source_hash"], dtype=object)

    ordered = work.repartition("component_id", F.floor(F.pmod(F.xxhash64("entity_id"), F.lit(64)))).sortWithinPartitions(F.col("kind") != "symbol", "component_id", "entity_id")
    done = ordered.mapInPandas(run, "entity_id string, short_summary string, detailed_summary string, keywords array<string>, source_hash string")
    return done.withColumn("updated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def stale_work(m: Model, contents: DataFrame, exported_only: bool = True) -> DataFrame:
    """What has no summary yet, or one of another source."""
    work = prompt_inputs(m, contents, exported_only)
    return work.join(stale_summaries(work.select("entity_id", "source_hash"), m.summaries).select("entity_id"), "entity_id", "left_semi")


def summary_counts(work: DataFrame, made: DataFrame) -> DataFrame:
    """One row: entities that were due, those that got a summary, those that failed."""
    both = work.select("entity_id").join(made.select("entity_id", F.lit(True).alias("made")), "entity_id", "left")
    return both.agg(F.count("*").alias("due"), F.count("made").alias("generated"), F.count_if(F.col("made").isNull()).alias("failed"))
