"""Column functions on text, paths and vectors; all of them built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_tokens(query: str) -> list[str]:
    """Lower-cased words, split at white space; repeated words stay."""
    return query.lower().split()


def any_token_in(text: Column, tokens: list[str]) -> Column:
    """Whether lower-cased text holds some token as a substring; never for no tokens."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(t) for t in dict.fromkeys(tokens)], F.lit(False))


def hit_ratio(text: Column, tokens: list[str]) -> Column:
    """Tokens found in the text over all tokens, each counted as often as it stands in the query."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = reduce(lambda a, b: a + b, [low.contains(t).cast("int") for t in tokens], F.lit(0))
    return hits.cast("double") / F.lit(float(len(tokens) or 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; 1 where a vector is zero; an error where lengths differ."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    apart = F.when(size > 0, 1 - dot(a, b) / size).otherwise(F.lit(1.0))
    return F.when(F.size(a) == F.size(b), apart).otherwise(F.raise_error(F.lit("vectors of different dimensions")).cast("double"))


def glob_regex(glob: str) -> str:
    """A regex for a path glob in which * and ? also cross '/', ** likewise, and {a,b} are choices."""
    out, at, depth = "", 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
            continue
        if c == "*":
            while glob[at : at + 2] == "**":
                at += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            out, at = out + "[" + glob[at + 1 : end].replace("\\", r"\\").replace("!", "^", 1) + "]", end
        else:
            out += re.escape(c)
        at += 1
    return f"^{out}$"


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    """At most ``most`` characters, the mark included."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name; empty for none, a leading dot alone does not count."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def ancestors(path: Column) -> Column:
    """All directories above a path, the root '' included, nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def one_sentence(text: Column, most_words: int = 24) -> Column:
    """The first sentence, single-spaced, at most so many words, with a final period."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    first = F.regexp_extract(flat, r"^([^.!?]*[.!?]?)", 1)
    short = F.array_join(F.slice(F.split(first, " "), 1, most_words), " ")
    return F.when(short == "", "").when(short.rlike(r"[.!?]$"), short).otherwise(F.concat(short, F.lit(".")))


def first_of(names: Column, n: int, total: Column | None = None) -> Column:
    """The first n as lines of '- name', with how many more there are (of total, where names are the first of more); '- none' for an empty list."""
    lines = F.array_join(F.transform(F.slice(names, 1, n), lambda x: F.concat(F.lit("- "), x)), "\n")
    rest = (F.size(names) if total is None else total) - n
    return F.when(F.size(names) == 0, "- none").when(rest > 0, F.concat(lines, F.lit("\n- …and "), rest.cast("string"), F.lit(" more"))).otherwise(lines)


def xml_escaped(text: Column) -> Column:
    # Characters and their references; & comes first.
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(ref))
    return text
