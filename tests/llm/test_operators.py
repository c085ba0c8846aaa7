"""Each operator against a plain brute-force version, over the small tables and over odd rows."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations
from math import log10

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayfinder.llm import ann, decontamination, licenses, lm, ngram_join, packing, queries, secrets, token_files, toxicity, url_filter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, id string, mask string"

ODD = [
    (0, "Licensed under CC BY-NC 4.0. All rights reserved, all Rights reserved.", 7),
    (1, None, 1),
    (2, "", 0),
    (3, "  \t\n", 0),
    (4, "password = 'abcDEF123456' token:short AKIAABCDEFGHIJKL and deadbeefdeadbeefdeadbeefdeadbeef é", 0),
    (5, "one two three four five six", 0),
    (6, "one two three four five six", 0),
    (7, "one two three four", 0),
    (8, "ONE two\u00a0three Größe 你好 <|endoftext|> it's 12 'll", 0),
    (9, " ".join(f"w{i % 900}" for i in range(30_000)), 0),
    (10, " ".join(f"w{i % 900}" for i in range(29_900)), 0),
    (11, "This work is licensed under the very GNU General Public License, version 3.", 0),
    (11, "This work is licensed under the very GNU General Public License, version 3.", 0),
    (12, "\x1cAKIA\x1f x\u2003y \u0130 ſecret=abcdefgh1 tOKEN = abcdefgh2", 0),
    (None, "no id at all here", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "src", n, "x", "y", "z") for i, t, n in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return queries.table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def both(docs, odd, texts):
    return ((docs, texts), (odd, [(i, t) for i, t, _ in ODD]))


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_url_filter(spark, sf_dir):
    pages = queries.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = [(r[0], r[1]) for r in pages.collect()] + [(-1, None), (-2, "no scheme"), (-3, "HTTP://Example.COM/en/7x?q#f"), (-4, "a://b.org/es/1"), (-5, "x://notcom/en/"), (-6, "://"), (-6, "://")]
    extra = spark.createDataFrame([(i, u, None) for i, u in rows[-7:]], "page_id long, url string, html string")
    found = url_filter.filter_urls(pages.unionByName(extra)).collect()

    def judge(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, None))

    want = {i: judge(u) for i, u in rows}
    assert len(found) == len(rows)
    for r in found:
        host, path, rule, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        assert rule is None or r["verdict"] == verdict
    assert {r["verdict"] for r in found if r["rule"] is None} == {"allow", "block"}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def plain_shares(edges, seeds, steps=300):
    """Shares of one side by plain iteration. edges: (src, dst) to weight; seeds: host to weight."""
    out, start = Counter(), {h: w / sum(seeds.values()) for h, w in seeds.items()}
    for (s, _), w in edges.items():
        out[s] += w
    rank = dict(start)
    for _ in range(steps):
        new = Counter({h: 0.15 * x for h, x in start.items()})
        for (s, d), w in edges.items():
            new[d] += 0.85 * rank.get(s, 0) * w / out[s]
        rank = new
    return {h: x / sum(rank.values()) for h, x in rank.items()}


def test_propagation_against_dense_iteration(spark):
    edges = {("a", "b"): 1.0, ("b", "c"): 2.0, ("b", "a"): 1.0, ("d", "c"): 1.0}
    got = {(r["side"], r["host"]): r["share"] for r in url_filter.propagate(spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, weight double"), spark.createDataFrame([("trust", "a", 2.0), ("distrust", "c", 1.0)], "side string, host string, weight double")).collect()}
    for side, seeds, links in (("trust", {"a": 2.0}, edges), ("distrust", {"c": 1.0}, {(d, s): w for (s, d), w in edges.items()})):
        for h, x in plain_shares(links, seeds).items():
            assert abs(got.get((side, h), 0) - x) < 5e-4


def test_a_walk_that_does_not_settle_is_an_error(spark):
    with pytest.raises(RuntimeError):
        url_filter.propagate(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double"), spark.createDataFrame([("trust", "a", 1.0)], "side string, host string, weight double"), settled=0.0, every=1, most=2)


def test_url_verdicts_against_a_plain_walk(spark):
    """Every verdict, the walk's included; links in queries name no host, and columns of the pages clash with the operator's."""
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url", "html").collect()]
    far = "".join(f'<a href="http://h{i}.zz/">' for i in range(3))
    rows += [(-1, "http://h0.zz/x", '<a href="/go?u=https://example.com/en/1"> <A HREF=//h1.zz/y> <a href=\'HTTP://Bad.org/es/1\'>'), (-2, "http://h1.zz/", far), (-3, "http://bad.org/es/2", far), (-4, "http://lone.zz/", None), (-5, None, far), (-6, "http://h2.zz", '<a href="http://ok.net/de/1">'), (-7, "http://ok.net/de/2", "")]
    frame = spark.createDataFrame([(*r, "k", "h", 0.5) for r in rows], "page_id long, url string, html string, key string, host string, trust double")
    split = lambda u: (m[1].translate(LOW), m[2]) if (m := re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")) else ("", "")

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    edges, seeds, hosts = Counter(), {"allow": Counter(), "block": Counter()}, set()
    for _, url, html in rows:
        host, path = split(url)
        hosts.add(host)
        for link in set(re.findall(r"""(?i)href\s*=\s*["']?([^"'\s>#]+)""", html or "")):
            if re.match(r"(?i)([a-z][a-z0-9+.-]*:)?//", link):
                hosts.add(to := split("x:" + link if link.startswith("//") else link)[0])
                edges[host, to] += 1
        if host and (verdict := rule(host, path)[1]):
            seeds[verdict][host] += 1
    for host in list(hosts):
        labels = host.split(".")
        hosts.update(".".join(labels[i:]) for i in range(len(labels) - 1))
    for host in hosts:
        above = host.partition(".")[2]
        if "." in above:
            edges[host, above] += 1
            edges[above, host] += 1
    edges = {(s, d): w for (s, d), w in edges.items() if s and d and s != d}
    trust, distrust = plain_shares(edges, seeds["allow"]), plain_shares({(d, s): w for (s, d), w in edges.items()}, seeds["block"])
    found = url_filter.filter_urls(frame).collect()
    assert len(found) == len(rows)
    by = {i: u for i, u, _ in rows}
    close = 0
    for r in found:
        host, path = split(by[r["page_id"]])
        t, d = trust.get(host, 0), distrust.get(host, 0)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule(host, path)[0]) and abs(r["trust"] - t) < 5e-4 and abs(r["distrust"] - d) < 5e-4
        if r["rule"] is None and abs(d - t) < 1e-3 and d != t:
            close += 1
        else:
            assert r["verdict"] == (rule(host, path)[1] or ("block" if d > t else "allow")), r
    assert close < len(rows) / 4


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = queries.table(spark, "/root/testdata/sf0.01", "documents"), queries.table(spark, "/root/testdata/sf0.01", "labels")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] == (crc(i) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for i, r in found.items())
    held = [(found[i]["score"], y) for i, y in truth.items() if i in found and found[i]["held_out"]]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.85, auc
    flipped = toxicity.toxicity(docs, labels.selectExpr("doc_id", f"case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end as toxic"))
    assert {r["doc_id"]: r["score"] for r in flipped.collect()} == {i: r["score"] for i, r in found.items()}


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (99, 0), (5, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, labels).count() == len(ODD)
    assert {r["score"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 4, 0, 2, 7])
    scores, move, start = rng.normal(size=17), np.exp(rng.normal(size=(2, 2))), np.exp(rng.normal(size=2))
    want, want_pairs = [], np.zeros((2, 2))
    for end, n in zip(np.cumsum(lengths), lengths, strict=True):
        s, total, hit, joint = scores[end - n : end], 0.0, np.zeros(n), np.zeros((2, 2))
        for path in np.ndindex(*[2] * n):
            w = np.prod([np.exp(s[t]) if path[t] else 1 for t in range(n)]) * (start[path[0]] if n else 1) * np.prod([move[path[t], path[t + 1]] for t in range(n - 1)])
            total += w
            hit += w * np.array(path)
            for t in range(n - 1):
                joint[path[t], path[t + 1]] += w
        want += list(hit / total)
        want_pairs += joint / total
    for block in (1, 2, 3, 4, 100):  # a text in several blocks gives what it gives in one
        p, pairs = toxicity.forward_backward(scores, lengths, move, start, block)
        assert np.allclose(p, want) and np.allclose(pairs, want_pairs)
    assert len(toxicity.forward_backward(np.empty(0), np.array([0, 0]), move, start)[0]) == 0


def plain_toxicity(text, model):
    """The whole score of a text, token by token."""
    words = ALNUM.findall((text or "").translate(LOW))
    odds = [np.exp(np.clip(model.bias + sum(model.weights.get(f, 0.0) for f in [w, *(w[:n] + "*" for n in toxicity.STEMS if len(w) >= n)]), -30, 30)) for w in words]
    ahead, behind = [], [np.ones(2)]
    for x in odds:
        f = (ahead[-1] @ model.move if ahead else model.start) * [1, x]
        ahead.append(f / f.sum())
    for x in odds[:0:-1]:
        b = model.move @ ([1, x] * behind[-1])
        behind.append(b / b.sum())
    p = [float(a[1] * b[1] / (a * b).sum()) for a, b in zip(ahead, behind[::-1], strict=False)]
    features = [1, max(p), np.log1p(sum(p)), sum(p) / np.sqrt(len(p))] if p else [1, 0, 0, 0]
    return 1 / (1 + np.exp(-np.clip(features @ model.head, -30, 30)))


def test_toxicity_scores_against_token_by_token(spark, odd, docs, texts):
    wide = queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = toxicity.train(wide, queries.table(spark, "/root/testdata/sf0.01", "labels"))
    assert model.weights and model.head is not None
    for frame, rows in both(docs, odd, texts):
        got = toxicity.score_documents(frame, model).collect()
        same([(r["doc_id"], round(r["score"], 6), r["predicted"]) for r in got], [(i, round(float(x), 6), int(x >= 0.3)) for i, x in ((i, plain_toxicity(t, model)) for i, t in rows)])
        words = {r["doc_id"]: r["spans"] for r in got}
        for i, t in rows:
            assert all(ALNUM.fullmatch(t[x["start"] : x["end"]].translate(LOW)) and x["marginal"] >= 0.5 for x in words[i])


def test_toxicity_ignores_labels_of_absent_documents_and_bounds_its_sample(spark):
    rows = [(i, f"plain words about nothing {i} " + ("vile nasty slur " * 3 if i % 3 == 0 else "kind gentle note ")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    want = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    ghosts = labels.unionByName(spark.range(1000, 21000).selectExpr("id as doc_id", "1 as toxic"))
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, ghosts).collect()} == want
    assert all((x >= 0.3) == (i % 3 == 0) for i, x in want.items())
    again = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 0"))  # a repeated row weighs once
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(again, labels).collect()} == want
    # a text that is too long for the sample is left out alone, toxic or clean, labelled or not
    huge = spark.createDataFrame([(1000, "vile nasty slur " + "endless " * 4_200_000), (1001, "kind gentle note " + "endless " * 4_200_000)], "doc_id long, text string")
    wide = labels.unionByName(spark.createDataFrame([(1000, 1), (1001, 0)], "doc_id long, toxic int"))
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs.unionByName(huge), wide).collect()}
    assert {i: x >= 0.3 for i, x in found.items() if i < 1000} == {i: x >= 0.3 for i, x in want.items()} and set(found) == {*want, 1000, 1001}
    for bound in (10, 31 * 32):
        with pytest.raises(ValueError, match="sample_bytes"):
            toxicity.train(docs, labels, sample_bytes=bound)
    assert toxicity.train(docs, labels.where("toxic = 0")).head is None


def test_toxicity_of_a_very_long_text_takes_no_step_for_each_token():
    import time

    model = toxicity.Model({"bad": 3.0}, -2.0, np.array([[2.0, 0.5], [0.5, 2.0]]), np.ones(2), np.array([-3.0, 2.0, 1.0, 0.5]))
    began = time.process_time()
    scores, spans = toxicity.judge(pa.array(["bad word " * 100_000, None], pa.string()), model, toxicity.WordScores(model))
    assert time.process_time() - began < 3 and scores[0] > scores[1] and len(spans[0]) >= 1


def test_licenses(odd, docs, texts):
    for frame, rows in both(docs, odd, texts):
        want = []
        for i, t in rows:
            w = ALNUM.findall((t or "").translate(LOW))
            at = sorted((k, label) for p, label in licenses.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
            want.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
        found = licenses.scan_licenses(frame).collect()
        same([tuple(r[:6]) for r in found], want)
        assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)
    by = {r["doc_id"]: r for r in licenses.scan_licenses(odd).collect()}
    assert "cc-by-nc-4.0" in by[0]["labels"] and "gpl-3.0" in by[11]["labels"]  # one word more shifts the diagonal
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


def plain_notices(words):
    """(label, begin, end) of each notice by diagonal voting, place by place."""
    out = []
    for phrase, label in licenses.NOTICES:
        t = phrase.split()
        votes = {}
        for i in range(len(words) - 2):
            for pos in range(len(t) - 2):
                if words[i : i + 3] == t[pos : pos + 3]:
                    votes.setdefault(i - pos, set()).add(pos)
        runs, last = [], None
        for begin, d in sorted((d + min(p), d) for d, p in votes.items()):
            end = d + max(votes[d]) + 3
            if last is None or abs(d - last[0]) > licenses.STEP or begin > last[1] + licenses.STEP:
                runs.append([begin, end, set()])
            runs[-1] = [min(runs[-1][0], begin), max(runs[-1][1], end), runs[-1][2] | votes[d]]
            last = d, end
        for begin, end, places in runs:
            if len({p + k for p in places for k in range(3)}) / len(t) >= licenses.COVER and end - begin <= 2 * len(t):
                out.append((label, begin, end))
    return sorted(out)


def test_license_notices_against_plain_voting(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(150):
        words = list(rng.choice(["the", "software", "license", "this", "work", "is", "under", "x", "y"], int(rng.integers(0, 12))))
        for k in rng.integers(0, len(licenses.NOTICES), int(rng.integers(0, 3))):
            own = licenses.NOTICES[k][0].split()
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(0, len(own)))
                own[at : at + int(rng.integers(0, 2))] = ["new"] * int(rng.integers(0, 3))
            words += own + list(rng.choice(["a", "b"], int(rng.integers(0, 4))))
        rows.append((i, " ".join(words)))
    rows += rows[:3]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, plain_notices(t.split())) for i, t in rows]
    same([(r["doc_id"], sorted((x["label"], x["begin"], x["end"]) for x in r["spans"] or [])) for r in got], want)
    assert sum(bool(w) for _, w in want) > 50


def brute_contamination(rows, items, window=13):
    wins = {}
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    sizes = {len(x) for x in wins}
    for i, t in rows:
        w, hit, who = ALNUM.findall((t or "").translate(LOW)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    who |= found
        yield i, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, sf_dir, odd, docs, texts):
    bench = queries.table(spark, sf_dir, "benchmark").unionByName(spark.createDataFrame([(900, None), (901, "..."), (902, "two three"), (902, "two three")], "item_id long, text string"))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    for frame, rows in both(docs, odd, texts):
        want = list(brute_contamination(rows, items))
        same([tuple(r[:6]) for r in decontamination.decontaminate(frame, bench).collect()], want)
        same([tuple(r[:6]) for r in decontamination.decontaminate(frame, bench, automaton_words=400).collect()], want)  # several rounds, some items in two
    clash = odd.selectExpr("*", "'m' as __hit_mask", "'i' as __hit_items", "'t' as item_id")
    kept = decontamination.drop_contaminated(clash, bench, automaton_words=400)
    assert kept.columns == clash.columns
    same([r["doc_id"] for r in kept.collect()], [w[0] for w in brute_contamination([(i, t) for i, t, _ in ODD], items) if not w[5]])
    spans = {r["doc_id"]: r["spans"] for r in decontamination.decontaminate(odd, bench).collect()}
    assert [ODD[5][1][s["start"] : s["end"]] for s in spans[5]] == ["two three"]
    assert {r["n_hit"] for r in decontamination.decontaminate(odd, bench.limit(0)).collect()} == {0}


def brute_secrets(text):
    out = []
    for k, r in enumerate(secrets.RULES):
        out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
    return [(secrets.RULES[k].kind, s, e) for s, k, e in sorted(out)]


def test_secrets(odd, docs, texts):
    for frame, rows in both(docs, odd, texts):
        want = []
        for i, t in rows:
            spans = brute_secrets(t or "")
            base = [s for s in spans if s[0] in ("assign", "access", "hex")]
            line = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
            n = Counter(s[0] for s in spans)
            want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(line(base).encode()).hexdigest(), line(spans)))
        same([tuple(r) for r in secrets.digest(secrets.find_secrets(frame)).collect()], want)
    clean = {r["doc_id"]: r for r in secrets.redact(odd).collect()}
    assert clean[4]["text"] == "password = '[redacted]' token:short [redacted] and [redacted] é" and clean[4]["n_chars"] == len(clean[4]["text"])
    assert clean[1]["text"] is None and clean[5]["text"] == ODD[5][1]


def test_trigram_queries_never_miss():
    for r in secrets.RULES:
        query, samples = secrets.trigram_query(r.pattern), ["api_key=abcdefgh", 'PASSWD" : "xyz12345', "AKIAABCDEFGHIJKL", "a" * 40, "ghp_" + "a1" * 20, "xoxb-1234567890ab", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "x" * 35]
        index = secrets.SegmentIndex(sorted(secrets.trigrams_of(query)))
        index.build([s.encode() for s in samples])
        assert {i for i, s in enumerate(samples) if re.search(r.pattern, s)} <= set(index.find(query).tolist())
    assert secrets.trigram_query(r"[0-9a-f]+") is True


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = BLANK.findall((t or "").translate(LOW))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            up[top(a)] = top(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(i, len(s), least.get(top(k)) if s else i) for k, (i, s) in enumerate(sets)]


def test_ngram_join(spark, odd, docs, texts):
    for frame, rows in both(docs, odd, texts):
        same([tuple(r) for r in ngram_join.jaccard_join(frame).collect()], brute_components(rows))
    assert ngram_join.jaccard_join(odd.limit(0)).count() == 0


def test_ngram_join_light_and_chained_sets(spark):
    rng = np.random.default_rng(3)
    rows = []
    for base in range(12):
        words = [f"b{base}x{k}" for k in range(int(rng.integers(4, 60)))]
        for _ in range(12):
            mine = list(words)
            for _ in range(int(rng.integers(0, 3))):
                mine[int(rng.integers(0, len(mine)))] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(mine[: len(mine) - int(rng.integers(0, 3))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(r) for r in ngram_join.jaccard_join(frame).collect()], brute_components(rows))
    kept = ngram_join.keep_one(frame, ngram_join.grouped_rows(frame))
    same([r["doc_id"] for r in kept.collect()], {c for _, _, c in brute_components(rows)})


def test_ngram_join_null_ids_link_and_bridge(spark):
    """A chain whose middle has no id, a group without any id, repeated ids with other texts and repeated rows."""
    words = [f"w{k}" for k in range(60)]
    rows = [(5, " ".join(words)), (None, " ".join([*words[:54], *"abcdef"])), (3, " ".join([*words[:53], "g", *"abcdef"])), (3, "other words that this id has as well"), (None, "x y z u v w"), (None, "x y z u v w"), (9, "x y z u v q"), (9, "x y z u v q"), (None, "alone without any other"), (None, None), (None, "other words that this id has as well")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert want[1][2] == want[0][2] == 3
    same([tuple(r) for r in ngram_join.jaccard_join(frame).collect()], want)
    wide = frame.selectExpr("*", "1 as rk", "'c' as component", "2 as id")
    kept = ngram_join.keep_one(wide, ngram_join.grouped_rows(wide))
    assert kept.columns == wide.columns
    same([(r["doc_id"], r["text"]) for r in kept.collect()], [rows[2], rows[3], rows[4], rows[6], rows[8], rows[9]])


def test_light_boundary_is_cheapest():
    sizes = {n: 100 for n in range(1, 41)}
    x = ngram_join.boundary(sizes)
    assert 5 < x < 16 and ngram_join.boundary({5: 10}) > 5 and ngram_join.shared_least(9, 9) == 8


@pytest.mark.parametrize("segment", [ann.SEGMENT, 300])
def test_ann_recall_and_exact_scores(spark, segment):
    """Also with many segments, repeated ids among candidates, and one that asks with two vectors."""
    rows = queries.table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")
    odd = spark.createDataFrame([(-20, None), (-40, [0.0] * 64), (-60, [float("nan")] * 64), (-80, [1.0] * 3), (-100, [None] + [1.0] * 63)], "vec_id long, embedding array<float>")
    first = rows.where("vec_id in (1, 2)")
    again = first.unionByName(first.where("vec_id = 1")).unionByName(rows.where("vec_id = 3").selectExpr("20L as vec_id", "embedding"))
    vectors = rows.unionByName(again).unionByName(odd)
    found = ann.search(vectors, vectors.where("vec_id % 20 = 0"), segment=segment, block=50).collect()
    ids, x = zip(*[(r[0], r[1]) for r in rows.unionByName(again).collect()], strict=True)
    ids, x = np.array(ids), np.array(x, np.float64)
    hits = []
    for q in np.unique(ids[ids % 20 == 0]):
        v = min(map(tuple, x[ids == q]))
        near = sorted((-float(np.dot(v, y)), int(i)) for i, y in zip(ids, x, strict=True) if i != q)[:20]
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda r: (-r["score"], r["vec_id"]))
        assert all(min(abs(s - r["score"]) for s in x[ids == r["vec_id"]] @ v) < 1e-12 for r in mine)
        hits.append(sum((Counter(i for _, i in near) & Counter(r["vec_id"] for r in mine)).values()) / 20)
    assert np.mean(hits) >= 0.9 and min(r["query_id"] for r in found) >= 0
    assert ann.search(odd, odd).count() == 2 * 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<double>")
    same([tuple(r) for r in ann.search(few, few.where("vec_id % 20 = 0")).collect()], [(0, 1, 1, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)])


def test_lm_base_scores(odd, docs, texts):
    for frame, rows in both(docs, odd, texts):
        tokens = [(i, [*BLANK.findall((t or "").translate(LOW)), None]) for i, t in rows]
        c = Counter(w for i, ws in tokens if crc(i) % 7 != 2 for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted(((i, crc(i) % 7 == 2, len(ws), sum(c[w] > 0 for w in ws), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens), key=repr)
        got = sorted((tuple(r[:6]) for r in lm.lm_scores(frame).collect()), key=repr)
        assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
        model = lm.train(frame.where(lm.trains()).selectExpr("coalesce(text, '') as text"))
        large = sorted(((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(frame, model, vocabulary_words=0).collect()), key=repr)
        small = sorted(((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(frame, model).collect()), key=repr)
        assert large == small
    assert lm.lm_scores(odd.limit(0)).count() == 0


def test_lm_scores_against_exact_counts(spark, docs, texts):
    """The filter's answers differ from exact, quantised counts by false probes only."""
    tokens = {i: [*BLANK.findall((t or "").translate(LOW)), None] for i, t in texts}
    trained = [ws for i, ws in tokens.items() if crc(i) % 7 != 2]
    one, two = Counter(w for ws in trained for w in ws), Counter(p for ws in trained for p in zip([None, *ws[:-1]], ws))
    n, v = sum(one.values()), len(one)
    read = lambda c: float(lm.COUNT_OF[c.bit_length()])
    apart = []
    for r in lm.lm_scores(docs).collect():
        ws, want = tokens[r["doc_id"]], 0.0
        for a, w in zip([None, *ws[:-1]], ws):
            low = min((read(one[w]) + 1) / (n + v + 1), 1.0)
            context = read(one[a])
            want += log10(lm.WEIGHT * min(read(two[a, w]), context) / context + (1 - lm.WEIGHT) * low if context else low)
        assert r["score"] < 0
        apart.append((abs(r["score"] - want) / len(ws), r["held_out"]))
    assert np.mean([x for x, held in apart if not held]) < 0.05 and np.mean([x for x, held in apart if held]) < 0.3, (np.mean([x for x, h in apart if not h]), np.mean([x for x, h in apart if h]))


def test_long_texts_without_blanks(spark):
    """A megabyte in one word: tokenised as by the library, and scored, joined and scanned as one word."""
    text = "".join(np.random.default_rng(6).choice(list("abcdefghij0123456789+/"), 1_000_000))
    frame = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")
    want = plain_ids([(1, text), (2, text + " end")], 1)
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_file_digest(frame, TOKENIZER).collect()], [(i, len(x), zlib.crc32(x.tobytes())) for i, x in want])
    assert sum(r["length"] for r in packing.pack(frame, TOKENIZER).collect()) == sum(len(x) for _, x in want)
    assert [r["n_tokens"] for r in lm.lm_scores(frame).orderBy("doc_id").collect()] == [2, 3]
    same([tuple(r) for r in ngram_join.jaccard_join(frame).collect()], [(1, 1, 1), (2, 1, 2)])
    assert [r["n_words"] for r in decontamination.decontaminate(frame, frame.selectExpr("doc_id as item_id", "'end' as text")).orderBy("doc_id").collect()] == [len(ALNUM.findall(text)), len(ALNUM.findall(text)) + 1]


def test_lm_filter_reads_counts_back():
    rng = np.random.default_rng(0)
    keys, counts = rng.integers(1, 1 << 62, 5000).astype(np.uint64), rng.integers(1, 300, 5000)
    f = lm.Filter(np.frombuffer(lm.Filter.slice_of(keys, counts, 1 << 19), np.uint8), 1)
    got = f.counts(keys)
    assert np.all(got >= np.where(counts == 1, 1, counts / 1.5)) and np.mean(got <= counts * 1.5) > 0.8
    assert np.mean(f.counts(rng.integers(1, 1 << 62, 5000).astype(np.uint64)) > 0) < 0.05


def test_word_cache_equals_plain_encoding(texts):
    from wayfinder.llm.tokens import PieceEncoder

    plain = Tokenizer.from_file(TOKENIZER)
    some = [t or "" for _, t in texts] + [t or "" for _, t, _ in ODD] + ["a\u0301 \u0301b \u2000 ΑΣ Σ σς", "x<|endoftext|>y <|startoftext|>", "A<|ENDOFTEXT|>B.", "end.", ".5 a", "é.è,É! ×. ÷. 😀. İ. ß) x'.s a.'s it's. '.x \u0301. a\u0301. a\u0338= a=\u0338 don't,"]
    rng, letters = np.random.default_rng(5), [*"aZsé×÷ÀİΣ9.,'!<|>=^`~ \t\n\u0301\u0338\u00a0\x1c\u2028😀文"]
    some += ["".join(rng.choice(letters, int(rng.integers(1, 40)))) for _ in range(3000)]
    for bound in (96_000_000, 2_000):
        coder = PieceEncoder(TOKENIZER, bound)
        assert coder.grouped and coder.lowers and coder.cuts
        for texts in (some, some[-300:], []):
            flat, begin = coder.encode(pa.array([*texts, None], pa.string()))
            for t, a, b in zip([*texts, ""], begin[:-1], begin[1:], strict=True):
                assert plain.encode(t, add_special_tokens=False).ids == flat[a:b].tolist(), t[:50]


def plain_ids(rows, end):
    t = Tokenizer.from_file(TOKENIZER)
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")) for i, x in rows]


def test_packing(odd, docs, texts):
    for frame, rows in both(docs, odd, texts):
        ids = plain_ids(rows, 2)
        found = packing.pack(frame, TOKENIZER).collect()
        by_doc, by_seq = {}, {}
        for r in found:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_seq.setdefault(r["sequence_id"], []).append(r)
        copies = Counter(i for i, _ in ids)
        for i, x in ids:
            pieces = by_doc[i]
            assert sum(p["length"] for p in pieces) == copies[i] * len(x) and all(p["doc_tokens"] == len(x) and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in pieces)
        padding = 0
        for pieces in by_seq.values():
            at = 0
            for p in sorted(pieces, key=lambda p: p["offset"]):
                assert p["offset"] == at and p["length"] > 0
                at += p["length"]
            assert at <= 4096
            padding += 0 if at & (at - 1) == 0 else 4096 - at
        assert padding == 0
    assert packing.pack(odd.limit(0), TOKENIZER).count() == 0


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        key = packing.hilbert_index(grid, bits)
        order = grid[np.argsort(key)]
        assert sorted(key) == list(range(len(grid))) and np.all(np.abs(np.diff(order, axis=0)).sum(axis=1) == 1)


def test_token_files(odd, docs, texts):
    for frame, rows in both(docs, odd, texts):
        want, at = [], 0
        for i, x in sorted(plain_ids(rows, 1), key=lambda r: (r[0] is not None, r[0])):
            want.append((i, at, len(x), zlib.crc32(x.tobytes())))
            at += len(x)
        same([tuple(r) for r in token_files.token_file_digest(frame, TOKENIZER).collect()], want)
    assert token_files.token_file_digest(odd.limit(0), TOKENIZER).count() == 0


def test_ranked_coding_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 4096, 10_001):
        v = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.encode_values(v)
        assert len(control) == -(-n // 4) and np.array_equal(token_files.decode_values(control, data, n), v)
    blob = token_files.pack_shard([3, None], [1, 2], np.array([7, 70000, 2], np.uint32))
    docs, counts, ranks = token_files.unpack_shard(blob)
    assert (docs, counts.tolist(), ranks.tolist()) == ([3, None], [1, 2], [7, 70000, 2])


def test_pieces_encoded_together_equal_pieces_alone():
    from array import array

    from wayfinder.llm.tokens import PieceEncoder

    coder = PieceEncoder(TOKENIZER)
    words = ["plain", "a", "İstanbul", "ΟΔΟΣ", "straße", "ǅ", "étude", "文字", "ﬁne", "x1", "don't", "tail.", "ᾳ", "K"]
    pieces = list(dict.fromkeys(words + [f"w{'ab' * (k % 7)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]))
    alone = {x: array("H", coder.tokenizer.encode(x, add_special_tokens=False).ids).tobytes() for x in pieces}
    assert coder.encode_words(pieces) == alone
