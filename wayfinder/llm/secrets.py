"""Secret scans through a trigram inverted index.

A Boolean trigram query is derived from each rule's parsed regex. Texts are indexed in segments (one Arrow batch each,
as search engines shard by document): the trigrams that any query names get postings of documents, postings are
intersected and united as the query says, and only candidates are verified with the regex. A rule without mandatory
trigrams (such as a bare run of hex digits) scans every document.

Defined results: a null text counts as empty and has no secrets; repeated rows each get a row; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.llm.common import LOWER_BYTES, bound_batches, chunks_of, slices_of, texts_of


@dataclass(frozen=True)
class Rule:
    """kind; regex; the group and least length that a match must have to be kept."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Kinds that the method adds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES

#: Strings in one exact set before it is turned into trigrams.
EXACT_LIMIT = 64

# A query is True (anything fits), a trigram (bytes), or ("and" | "or", frozenset of queries).


def _join(kind: str, parts) -> object:
    """and/or of queries with the neutral and absorbing cases simplified."""
    parts = set(parts)
    if kind == "and":
        parts.discard(True)
        return True if not parts else parts.pop() if len(parts) == 1 else (kind, frozenset(parts))
    return True if True in parts or not parts else parts.pop() if len(parts) == 1 else (kind, frozenset(parts))


def _of_strings(strings: set[str]) -> object:
    """Some one of the strings occurs."""
    low = [s.encode("utf-8").translate(LOWER_BYTES) for s in strings]
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in low])


def _walk(tree) -> tuple[set[str] | None, object]:
    """(the exact strings that the expression matches, or None if they are too many; a query that every match fits)."""
    exact: set[str] | None = {""}
    parts: list[object] = []

    def flush() -> None:
        nonlocal exact
        if exact:
            parts.append(_of_strings(exact))
        exact = None

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            one, query = {chr(arg)}, True
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            one, query = {chr(v) for _, v in arg}, True
        elif name == "SUBPATTERN":
            one, query = _walk(arg[3])
        elif name == "BRANCH":
            found = [_walk(x) for x in arg[1]]
            one = set().union(*(f[0] for f in found)) if all(f[0] is not None for f in found) else None
            query = _join("or", [_of_strings(f[0]) if f[0] is not None else f[1] for f in found])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, body = arg
            inner, query = _walk(body)
            one = inner | {""} if inner is not None and (least, int(most)) == (0, 1) else inner if (least, int(most)) == (1, 1) else None
            if least == 0:
                query = True
            elif one is None and inner is not None:
                query = _of_strings(inner)
        else:
            one, query = None, True
        if one is not None and exact is not None and len(one) * len(exact) <= EXACT_LIMIT:
            exact = {a + b for a in exact for b in one}
            continue
        flush()
        if one is not None:
            exact = one
        elif query is not True:
            parts.append(query)
        if one is None:
            exact = {""}
    if not parts and exact is not None:
        return exact, _of_strings(exact)
    if exact and exact != {""}:
        parts.append(_of_strings(exact))
    return None, _join("and", parts)


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query of a regex; letters are lower-cased, which only widens it. True: no mandatory trigrams."""
    return _walk(re._parser.parse(pattern))[1]


def trigrams_of(query: object) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set() if query is True else set().union(*map(trigrams_of, query[1]))


class SegmentIndex:
    """Postings of the named trigrams over one segment of documents."""

    def __init__(self, trigrams: list[bytes]):
        self.trigrams = trigrams
        self.table = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(trigrams):
            self.table[int.from_bytes(t, "big")] = k + 1

    def build(self, texts: list[bytes]) -> None:
        """Texts are joined by two zero bytes, so that no trigram spans two documents."""
        flat = np.frombuffer(b"\0\0".join(texts).translate(LOWER_BYTES), np.uint8)
        ends = np.cumsum([len(t) + 2 for t in texts])
        self.n, self.postings = len(texts), {}
        if len(flat) < 3:
            return
        code = (flat[:-2].astype(np.uint32) << 16) | (flat[1:-1].astype(np.uint32) << 8) | flat[2:]
        which = self.table[code]
        at = np.flatnonzero(which)
        pairs = np.unique(which[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
        term, doc = pairs >> 32, pairs & 0xFFFFFFFF
        cut = np.searchsorted(term, np.arange(len(self.trigrams) + 2))
        self.postings = {t: doc[cut[k + 1] : cut[k + 2]] for k, t in enumerate(self.trigrams)}

    def find(self, query: object) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(query, np.empty(0, np.int64))
        found = sorted((self.find(q) for q in query[1]), key=len)
        out = found[0]
        for more in found[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if query[0] == "and" else np.union1d(out, more)
        return out


class Scanner:
    """The rules' queries, regexes and index, made once for each task."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        # a bare run that scans everything gets its least length put into the regex: the same matches, and short runs are skipped
        bare = [q is True and re.fullmatch(r"\[[^\]]+\]\+", r.pattern) for r, q in zip(rules, self.queries, strict=True)]
        self.regexes = [re.compile(f"{r.pattern[:-1]}{{{r.least},}}" if b else r.pattern) for r, b in zip(rules, bare, strict=True)]
        self.index = SegmentIndex(sorted(set().union(*map(trigrams_of, self.queries))))

    def scan(self, texts: list[bytes]) -> dict[int, list[tuple[int, int, int, int, int]]]:
        """By text: start, rule, end, and start and end of the rule's group, in order."""
        found: dict[int, list] = {}
        for a, b in chunks_of(texts):
            self.index.build(texts[a:b])
            for k, (rule, query, regex) in enumerate(zip(self.rules, self.queries, self.regexes, strict=True)):
                for i in self.index.find(query).tolist():
                    for m in regex.finditer(texts[a + i].decode("utf-8")):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found.setdefault(a + i, []).append((m.start(), k, m.end(), *m.span(rule.group)))
        return {i: sorted(x) for i, x in found.items()}


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of (kind, start, end), by start, then in the order of rules; offsets are code points, end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in slices_of(batches):
            texts = texts_of(batch, "text")
            found = scanner.scan(texts)
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e, *_ in found.get(i, ())] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], names=["doc_id", "spans"])

    rows = bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    line = lambda kinds: F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)) if kinds else F.col("spans"), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [r.kind for r in BASE_RULES]

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, base),
        F.sha2(line(base), 256).alias("base_sha256"),
        line([]).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[redacted]") -> DataFrame:
    """The documents with every secret (of an assignment its value) replaced by mask and n_chars made anew; other columns and clean texts as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in slices_of(batches):
            texts = texts_of(batch, "text")
            cols = list(batch.columns)
            if found := scanner.scan(texts):
                known = batch.column(at).is_valid().to_pylist()
                for i, spans in found.items():
                    texts[i] = masked(texts[i].decode("utf-8"), [x[3:] for x in spans], mask).encode("utf-8")
                cols[at] = pa.array([t.decode("utf-8") if k else None for t, k in zip(texts, known, strict=True)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    cleaned = bound_batches(docs).mapInArrow(run, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """Overlapping spans are masked as one."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])
