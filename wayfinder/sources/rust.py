"""Items of Rust source files, read by a scanner that blanks comments and literals and follows braces.

Items count at module and impl level only; bodies of functions and traits are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfinder.shared import materialize

ENTITY = "id string, kind string, name string, component_id string, path string, language string, line_start int, line_end int, visibility string, exported boolean"
EDGE = "src_id string, rel string, dst_id string, provenance_path string, provenance_line int"

#: Where a comment, a literal or a lifetime begins; what ends or nests in a block comment; a character, which a lifetime isn't.
HIDDEN = re.compile(r"""//|/\*|\b[bc]?r(#*)"|(?:\b[bc])?"|(?:\bb)?'""")
NESTED = re.compile(r"/\*|\*/")
QUOTED = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
CHARACTER = re.compile(r"(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}\n]*\}|[^\n])|[^\\'\n])'")
PAIRS = {"{": "{}", "(": "()", "[": "[]"}
HEAD = re.compile(
    r"(?P<vis>\bpub\b(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s*\"\s*\")?)\s+)*"
    r"\b(?P<what>fn|struct|enum|trait|mod|impl|use|const|static|type|union|macro_rules!)\b\s*(?P<name>[A-Za-z_]\w*)?"
)
ATTRIBUTE = re.compile(r"#\s*!?\s*\[")


def hidden(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of comments (block comments nest) and literals, in order. One that isn't closed goes on to the end."""
    at = 0
    while m := HIDDEN.search(text, at):
        mark, at = m[0], m.end()
        if mark == "//":
            end = text.find("\n", at)
        elif mark == "/*":
            depth = 1
            while depth and (x := NESTED.search(text, at)):
                depth += 1 if x[0] == "/*" else -1
                at = x.end()
            end = -1 if depth else at
        elif m[1] is not None:
            end = text.find('"' + m[1], at)
            end += (len(m[1]) + 1) * (end >= 0)
        elif mark[-1] == '"':
            end = x.end() if (x := QUOTED.match(text, at)) else -1
        elif x := CHARACTER.match(text, at):
            end = x.end()
        else:  # a lifetime
            continue
        at = len(text) if end < 0 else end
        yield m.start(), at


def blanked(text: str) -> str:
    """Comments and literals as blanks; line ends stay where they are, so that places and lines hold."""
    parts, at = [], 0
    for begin, end in hidden(text):
        parts += [text[at:begin], re.sub(r"[^\n]", " ", text[begin:end])]
        at = end
    return "".join([*parts, text[at:]])


def closing(code: str, at: int, pair: str) -> int:
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k] == pair[0]) - (code[k] == pair[1])
        if depth == 0:
            return k
    return len(code) - 1


def visibility(text: str | None) -> str | None:
    flat = re.sub(r"\s", "", text or "")
    return None if not flat else "internal" if flat in ("pub(crate)", "pub(super)") else "public"


def attribute_kind(text: str) -> str | None:
    flat = re.sub(r"\s", "", text)
    for kind in ("test", "bench"):
        if flat == f"#[{kind}]" or flat.startswith(f"#[{kind}(") or f"::{kind}]" in flat or f"::{kind}(" in flat:
            return kind
    return None


def items(code: str, start: int, end: int) -> Iterator[tuple[str, str | None, str | None, int, int, list[str], str]]:
    """what, name, visibility, begin, end, attributes, head of the items in a range; those of mod and impl bodies follow their holder."""
    at, attributes = start, []
    while at < end:
        if m := ATTRIBUTE.match(code, at):
            stop = closing(code, m.end() - 1, "[]")
            attributes.append(code[at : stop + 1])
            at = stop + 1
            continue
        m = HEAD.match(code, at)
        if not m or (at > start and (code[at - 1].isalnum() or code[at - 1] == "_")):
            if code[at] in PAIRS:  # what a macro is given holds no items of the file
                at = closing(code, at, PAIRS[code[at]])
            elif not code[at].isspace():
                attributes = attributes if code[at] == "#" else []
            at += 1
            continue
        what = m["what"]
        stop = m.end()
        while stop < end and code[stop] not in "{;":
            stop = closing(code, stop, "()") + 1 if code[stop] == "(" else closing(code, stop, "[]") + 1 if code[stop] == "[" else stop + 1
        opened = stop < end and code[stop] == "{"
        if what == "use":
            stop = code.find(";", m.end(), end)
            stop = end - 1 if stop < 0 else stop
        last = closing(code, stop, "{}") if opened and what != "use" else min(stop, end - 1)
        yield what, m["name"], visibility(m["vis"]), at, last, attributes, code[m.end("what") : stop]
        if what in ("mod", "impl") and opened:
            yield from items(code, stop + 1, last)
        at, attributes = last + 1, []


def rust_facts(path: str, component: str | None, text: str) -> tuple[list[dict], list[dict]]:
    code = blanked(text)
    unit = f"source_unit::{path}"
    line = lambda at: code.count("\n", 0, at) + 1
    entity = lambda kind, id_, name, a, b, vis, out: {"id": id_, "kind": kind, "name": name, "component_id": component, "path": path, "language": "rust", "line_start": a, "line_end": b, "visibility": vis, "exported": out}
    entities = [entity("source_unit", unit, path, None, None, None, True)]
    edges = [(component, "contains", unit, None)] if component else []
    found = list(items(code, 0, len(code)))
    marked = {name: kind for what, name, *_, attributes, _ in found if what == "fn" and name for a in attributes if (kind := attribute_kind(a))}
    for what, name, vis, begin, end, _, head in found:
        if what in ("fn", "struct", "enum", "trait") and name:
            kind = marked.get(name, "symbol") if what == "fn" else "symbol"
            own = f"{kind}::{path}::{name}"
            entities.append(entity(kind, own, name, line(begin), line(end), vis, kind == "symbol" and vis == "public"))
            edges.append((unit, {"symbol": "defines", "test": "tested_by", "bench": "benchmarked_by"}[kind], own, line(begin)))
        elif what == "impl":
            pair = re.match(r"\s*(?:<[^{]*?>\s*)?([\w:]+)\s*(?:<.*?>)?\s+for\s+([\w:]+)", f"{name or ''}{head[len(name or ''):]}" if not head.lstrip().startswith(name or "\0") else head)
            if pair:
                edges.append((f"symbol::{path}::{pair[2]}", "implements", f"symbol::{path}::{pair[1]}", line(begin)))
        elif what == "use" and vis == "public":
            target = " ".join(head.split())
            if "{" not in target and "*" not in target and target:
                edges.append((unit, "reexports", f"symbol::{path}::{target.rsplit('::', 1)[-1]}", line(begin)))
    return entities, [{"src_id": s, "rel": r, "dst_id": d, "provenance_path": path, "provenance_line": n} for s, r, d, n in edges]


def extract_rust(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (with a running number for later rows to win) and edges of the .rs files in files (path, component_id, content).
    Each file is parsed once; what it holds goes to a table that both are read from."""
    source = files.where(F.col("path").endswith(".rs")).select("path", "component_id", "content")
    kinds = {"line_start": pa.int32(), "line_end": pa.int32(), "exported": pa.bool_(), "n": pa.int32(), "provenance_line": pa.int32()}
    struct = lambda ddl: pa.struct([(c := x.split()[0], kinds.get(c, pa.string())) for x in ddl.split(", ")])
    schema = pa.schema([("entity", struct(f"{ENTITY}, n int")), ("edge", struct(EDGE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                entities, edges = rust_facts(p, c, (b or b"").decode("utf-8", "replace"))
                rows = [{"entity": e | {"n": k}, "edge": None} for k, e in enumerate(entities)] + [{"entity": None, "edge": e} for e in edges]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    typed = lambda ddl: ", ".join(f"{c}: {t}" for c, t in (x.split() for x in ddl.split(", ")))
    facts = materialize(source.mapInArrow(run, f"entity struct<{typed(ENTITY)}, n: int>, edge struct<{typed(EDGE)}>"), "rust")
    return facts.where("entity is not null").select("entity.*"), facts.where("edge is not null").select("edge.*")
