"""The audits and the archives against plain Python, on odd rows."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyarrow import fs

from wayfinder.llm import divergence, filter_audit, warc
from wayfinder.shared import fresh_path

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, part string, n long, edges string"


def made_documents(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Größe", "LOUD", "NOISE", "x#y", "two parts", "ſ"]
    out = []
    for i in range(n):
        size = rng.choice([0, 3, 49, 50, 51, 80, 200])
        few = rng.choice([words, words[:12], words[-6:]])
        text = rng.choice([" ", "\t\n ", "  "]).join(rng.choice(few) for _ in range(size))
        out.append((i if rng.random() > 0.1 else None, text if rng.random() > 0.05 else None, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "B", None, "ü"])))
    out += rng.sample(out, n // 4)  # whole rows again
    out += [(10_000 + i, out[0][1], "en", "hot") for i in range(n // 3)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra", 1, "clash") for r in rows], SCHEMA)


def plain_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = defaultdict(list)
    for d, t, _, s in rows:
        t = t or ""
        w = BLANK.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        docs[s or ""].append(({f for f, x in fails.items() if x}, d is not None and d in good, d is not None and d in toxic))
    out, shapley = [], Counter()
    for part, own in docs.items():
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                left = [x for x in own if not x[0] & set(order[:k])]
                gone = [x for x in left if f in x[0]]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), k + 1, len(left) - len(gone), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit(spark):
    rows = made_documents(1, 60)
    labels = [(i, i % 3, i % 2) for i in range(0, 60, 2)] + [(4, 1, None), (4, None, None), (None, 1, 1), (999, 1, 1)]
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(frame(spark, rows), marks)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)
    assert filter_audit.audit(frame(spark, []), marks).count() == 0


def test_filter_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "x y", "s"), (2, "x", "s"), (3, None, None)], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, none, {"X": lambda t: t.contains("x"), "Y": lambda t: t.contains("y")}, repeats=None)
    by = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in got.collect()}
    assert by["s", "XY", 1] == (0, 2, 0, 1, 3) and by["s", "XY", 2] == (0, 0, 1, 0, 1) and by["s", "YX", 1] == (1, 1, 0, 0, 1) and by["", "YX", 2] == (1, 0, 0, 0, 0)


def plain_divergence(rows, least, top):
    docs, groups = defaultdict(Counter), set()
    seen = defaultdict(Counter)
    for _, t, lang, s in rows:
        terms = TERM.findall((t or "").translate(LOW))
        docs[lang or "", s or ""].update(terms)
        seen[lang or ""].update(set(terms))
        groups.add((lang or "", s or ""))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = sorted(s for l2, s in groups if l2 == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(docs[lang, s]) for s in own}
        q = share(sum((docs[lang, s] for s in own), Counter()))
        for s in own:
            parts = {"pair": [(-sum(abs(p[s][t] - p[x][t]) for t in kept), x) for x in own if x != s], "term": [(q[t] - p[s][t], t) for t in kept if docs[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                first = sorted(items, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(first[: top if part == "term" else None])]
    return sorted(out)


@pytest.mark.parametrize("cells", [divergence.CELLS, 7])
def test_divergence(spark, cells):
    """With 7 cells a term has a block of its own, and sources meet in slices."""
    rows = made_documents(2, 80) + [(1, None, "xx", "only"), (2, "", "yy", "one"), (3, "rare words", "yy", "two")]
    got = divergence.divergence(frame(spark, rows), min_documents=5, top=4, cells=cells)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain_divergence(rows, 5, 4)


def test_divergence_of_no_rows_and_large_counts(spark):
    assert divergence.divergence(frame(spark, [])).count() == 0
    counts, total = np.array([10**15, 7, 0, 8 * 10**15]), 8 * 10**15 + 10**15 + 7
    assert divergence.shares(counts, total, 4).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 20) for c in counts]
    assert divergence.shares(np.array([9]), 9, 1).tolist() == [10**9 + 1]


PAGES = [
    (5, "http://Example.com/a?b=1#c", "<p>one</p>"),
    (9, "https://example.com/a?b=1", "<p>one</p>"),
    (7, "http://user@m.example.com", "<p>one</p>"),
    (None, "no address", "<p>one</p>"),
    (None, None, "<p>lone</p>"),
    (1, None, None),
    (2, "http://x.org/\r\nWARC-Type: response", ""),
    (3, "http://größe.de/ß é", "\r\n\r\nWARC/1.1\r\n\r\n é你"),
    (3, "http://größe.de/ß é", "\r\n\r\nWARC/1.1\r\n\r\n é你"),
    (-4, "http://example.com/a?b=1", "x" * 3_000_000),
    (4, "://", "y"),
]


def digest_of(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def plain_captures(pages):
    keeper = {}
    for p, _, h in pages:
        if p is not None:
            keeper[h or ""] = max(p, keeper.get(h or "", p))
    return Counter((p, len((h or "").encode()), digest_of(h), "response" if keeper.get(h or "", p) == p else "revisit", None if keeper.get(h or "", p) == p else keeper[h or ""]) for p, _, h in pages)


def pages_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", "x") for r in rows], "page_id long, url string, html string, digest string, archive string").repartition(parts)


DIGEST = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archives_of_odd_pages(spark):
    got = warc.capture_histories(pages_of(spark, PAGES))
    assert Counter(map(tuple, got.select(*DIGEST).collect())) == plain_captures(PAGES)
    assert warc.capture_histories(pages_of(spark, [])).count() == 0


def test_histories_are_merged_in_order(spark):
    """Small archives, runs, blocks and fans take several passes over several ranges; one URL has a third of all captures."""
    rng = random.Random(3)
    pages = [(i, "http://hot.com/" if rng.random() < 0.35 else f"http://{rng.choice('abc')}.com/{rng.randrange(40)}", f"<p>{rng.randrange(300)}</p>") for i in range(700)]
    got = warc.capture_histories(pages_of(spark, pages, 5), archive_bytes=9_000, run_rows=20, fan_in=3, range_rows=60, block_rows=8).orderBy("range", "block", "place").collect()
    assert Counter(tuple(r[c] for c in DIGEST) for r in got) == plain_captures(pages)
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in got]
    assert keys == sorted(keys) and len({r["range"] for r in got}) > 5
    assert {r["url_key"]: r["page_id"] for r in got if r["page_id"] in (0, 1, 2)} == {warc.url_key(u): p for p, u, _ in pages[:3]}


def test_archives_can_be_read_by_any_gzip_and_by_place(spark):
    folder = fresh_path(spark, "warc-test")
    files = warc.write_archives(pages_of(spark, PAGES), folder).collect()
    store, path = fs.FileSystem.from_uri(folder)
    found = []
    for f in files:
        blob = store.open_input_file(f"{path}/{f['archive']}").read()
        whole = gzip.decompress(blob)
        parts = list(warc.members(store.open_input_stream(f"{path}/{f['archive']}", compression=None)))
        assert whole == b"".join(x[2] for x in parts) and len(parts) == f["n_records"] and f["bytes"] == len(blob)
        found += [warc.read_capture(folder, f["archive"], at, size) for at, size, _ in parts]
    assert len(found) == len(PAGES) and {r["url"] for r in found if r["page"] == 2} == {"http://x.org/%0D%0AWARC-Type:%20response"}
    bad = warc.record(1, "http://a.b/", b"payload", digest_of("other"), None, warc.EPOCH)
    with pytest.raises(ValueError):
        warc.parse(bad)


def test_url_keys():
    keys = {"HTTP://u:p@WWW.Example.COM:80/A?b#c": "com:80,example,www)/A?b", "http://a.b": "b,a)/", "http://a.b?q": "b,a)?q", "http:///x": "", "plain": "", "": ""}
    assert {u: warc.url_key(u) for u in keys} == keys


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 33])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.choice("abc"), rng.randrange(3), rng.randrange(3), i) for _ in range(rng.randrange(6))) for i in range(k)]
    merged = list(warc.LoserTree([iter(r) for r in runs]))
    assert merged == sorted((x for r in runs for x in r), key=lambda x: (x[:3], x[3]))
