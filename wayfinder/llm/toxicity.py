"""Toxicity: a linear-chain conditional random field tags toxic tokens; marginals aggregate to document scores.

Document labels become token labels: in a toxic document, a token is labelled toxic if its word or one of its stems is
far likelier in toxic than in clean documents. The field (two states; word and stem weights, transitions) is fitted by
gradient ascent on its log-likelihood, a small logistic model on held-back documents turns forward-backward marginals
into a score, and tokens whose marginal is at least one half are the offending spans.

Fitting uses a bounded sample: SAMPLE_DOCS toxic and as many clean labelled documents of SAMPLE_BYTES of text each,
chosen by hash of the id; longer labelled texts than 1/LARGEST of that are left out of the sample, whole. Scoring reads every
whole text. Only the text enters a score.

Defined results: a null or empty text has no tokens and gets the score of no evidence; labels that are null or name no
document are ignored, of several the largest holds, of a repeated id one text is learned from; without labels of both kinds every score is 0; if both
kinds have labels and all texts of one are too long for the sample, training fails instead of scoring nothing; repeated rows
each get a row.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.llm.common import WORD_BYTES, bound_batches, flat_bytes, id_text_crc, of_bytes, release, slices_of, whole, words_in

SAMPLE_DOCS = 1000
#: UTF-8 bytes of the texts of either kind: documents are taken in order of the hash of their id as long as they fit. A text
#: that takes more than a share of 1/LARGEST is not learned from, so that LARGEST texts fit at least.
SAMPLE_BYTES, LARGEST = 32_000_000, 32
#: Tokens that are worked through one after another; longer texts are cut into such blocks, with the same result.
STRIDE = 128
#: A feature marks toxic tokens if it is so many times likelier in toxic documents and in so many of them at least (number, share); rarer features than LEAST_DOCS get no weight.
LIFT, LEAST_DOCS, LEAST_SHARE = 5.0, 3, 0.02
STEMS = (4, 5, 6)
BLOCK, STEPS, RATE, DECAY = 64, 30, 0.3, 0.05
#: Tokens whose features are worked on at once.
PART = 100_000
CUT = 0.3


def features_of(word: str) -> list[str]:
    """The word and its stems (a stem ends in * so that it differs from a word)."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences laid end to end: the time-major place of every token, the widths of the steps, and each sequence's rank
    by falling length. Step t holds widths[t] sequences, so that those which go on are always the first ones."""
    rank = np.empty(len(lengths), np.int64)
    rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
    longest = int(lengths.max(initial=0))
    widths = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    begin = np.cumsum(lengths) - lengths
    step = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    return np.concatenate(([0], np.cumsum(widths)))[step] + np.repeat(rank, lengths), widths, rank


def transfers(odds: np.ndarray, widths: np.ndarray, lead: np.ndarray, move: np.ndarray) -> np.ndarray:
    """2 x 2 by block: how the state before a block weighs its last state, up to one factor for each block."""
    out, at = lead.copy(), 0
    for t, n in enumerate(widths):
        m, now = out[:, :, :n], odds[at : at + n]
        if t:
            m[:, 0], m[:, 1] = m[:, 0] * move[0, 0] + m[:, 1] * move[1, 0], m[:, 0] * move[0, 1] + m[:, 1] * move[1, 1]
        m[:, 1] *= now
        m /= m.sum(axis=(0, 1))
        at += n
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray, block: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 by token and summed pair marginals (2 x 2), for sequences laid end to end.

    scores: log odds of state 1 by token. Sequences are cut into blocks that are worked through side by side; what a block
    does to the messages that pass it is a 2 x 2 product, so that a sequence takes steps as its blocks and not as its tokens.
    """
    blocks = -(-lengths // block)
    owner, first = np.repeat(np.arange(len(lengths)), blocks), np.cumsum(blocks) - blocks
    number = np.arange(len(owner)) - first[owner]
    place, widths, rank = time_major(np.minimum(block, lengths[owner] - number * block))
    at = np.concatenate(([0], np.cumsum(widths)))
    odds = np.empty(len(scores))
    odds[place] = np.exp(np.clip(scores, -30, 30))
    lead = np.empty((2, 2, len(owner)))
    lead[:, :, rank] = np.where(number == 0, start[None, :, None], move[:, :, None])
    into, behind = np.full((2, len(owner)), 0.5), np.ones((2, len(owner)))
    if len(owner) > len(lengths) - (lengths == 0).sum():
        by = transfers(odds, widths, lead, move)
        chain = [rank[first[blocks > k] + k] for k in range(int(blocks.max()))]
        before = [rank[first[blocks > k + 1] + k] for k in range(len(chain) - 1)]
        for here, after in zip(before, chain[1:], strict=True):
            passed = np.einsum("in,ijn->jn", into[:, here], by[:, :, here])
            into[:, after] = passed / passed.sum(axis=0)
        for here, after in zip(before[::-1], chain[:0:-1], strict=True):
            passed = np.einsum("ijn,jn->in", by[:, :, after], behind[:, after])
            behind[:, here] = passed / passed.sum(axis=0)
    ahead = np.empty((2, len(scores)))
    for t, n in enumerate(widths):
        now = slice(at[t], at[t + 1])
        if t:
            a0, a1 = ahead[:, at[t - 1] : at[t - 1] + n]
            f0, f1 = a0 * move[0, 0] + a1 * move[1, 0], a0 * move[0, 1] + a1 * move[1, 1]
        else:
            f0, f1 = np.einsum("in,ijn->jn", into, lead)
        f1 = f1 * odds[now]
        total = f0 + f1
        ahead[0, now], ahead[1, now] = f0 / total, f1 / total
    marginal, pairs = np.empty(len(scores)), np.zeros((2, 2))

    def joint(a: np.ndarray, e: list[np.ndarray]) -> np.ndarray:
        parts = np.array([[a[i] * move[i, j] * e[j] for j in (0, 1)] for i in (0, 1)])
        return (parts / parts.sum(axis=(0, 1))).sum(axis=2)

    b0 = b1 = np.empty(0)
    for t in range(len(widths) - 1, -1, -1):
        n, more = widths[t], len(b0)
        now = slice(at[t], at[t + 1])
        c0, c1 = behind[0, :n].copy(), behind[1, :n].copy()
        if more:
            e = [b0, b1 * odds[at[t + 1] : at[t + 1] + more]]
            pairs += joint(ahead[:, at[t] : at[t] + more], e)
            n0, n1 = move[0, 0] * e[0] + move[0, 1] * e[1], move[1, 0] * e[0] + move[1, 1] * e[1]
            c0[:more], c1[:more] = n0 / (n0 + n1), n1 / (n0 + n1)
        p0, p1 = ahead[0, now] * c0, ahead[1, now] * c1
        marginal[now] = p1 / (p0 + p1)
        b0, b1 = c0, c1
    if len(later := rank[number > 0]):
        pairs += joint(into[:, later], [b0[later], (b1 * odds[: len(b1)])[later]])
    return marginal[place], pairs


@dataclass
class Model:
    """weights: log odds by feature; move and start: potentials of the chain; head: logistic model on a document's marginals."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    move: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.ones(2))
    head: np.ndarray | None = None


class WordScores(dict):
    """Log odds by word, made when first asked for; forgotten beyond a bound."""

    def __init__(self, model: Model, most: int = 400_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        get = self.model.weights.get
        self[word] = out = self.model.bias + sum(get(f, 0.0) for f in features_of(word))
        return out


def tag(texts: pa.Array, model: Model, known: WordScores) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens, text by text, and tokens per text."""
    words, which, begin = words_in(of_bytes(*flat_bytes(whole(texts), WORD_BYTES)))
    scores = np.fromiter(map(known.__getitem__, words), np.float64, len(words))[which]
    return forward_backward(scores, np.diff(begin), model.move, model.start)[0], np.diff(begin)


def summary(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: 1, largest marginal, log of 1 + sum, sum per root of length."""
    out = np.zeros((len(lengths), 4))
    out[:, 0] = 1
    full = np.flatnonzero(lengths)
    if len(full):
        at = (np.cumsum(lengths) - lengths)[full]
        sums = np.add.reduceat(marginals, at)
        out[full, 1], out[full, 2], out[full, 3] = np.maximum.reduceat(marginals, at), np.log1p(sums), sums / np.sqrt(lengths[full])
    return out


def fit(rows: list[tuple[str, int]], prior: float) -> Model:
    """From (text, toxic) rows: the head from marginals of chains that were fitted on the other half, the chain from all."""
    if len({y for _, y in rows}) < 2:
        return Model()
    toxic, clean = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    halves = [toxic[k::2] + clean[k::2] for k in (0, 1)]
    x, y = [], []
    for own, other in (halves, halves[::-1]):
        chain = fit_chain(own)
        known, texts = WordScores(chain), [t for t, _ in other]
        x += [summary(*tag(pa.array(texts[a : a + 100], pa.large_string()), chain, known)) for a in range(0, len(texts), 100)]
        y += [v for _, v in other]
        del chain, known
        release()
    model = fit_chain(rows)
    release()
    model.head = logistic(np.concatenate(x), np.array(y, float), prior)
    return model


def fit_chain(rows: list[tuple[str, int]]) -> Model:
    """Token labels from document labels by lift, then gradient ascent (each step scaled by the gradients so far) over blocks of tokens."""
    sizes = Counter(y for _, y in rows)
    number: dict[str, int] = {}
    cut = []
    for t, y in rows:
        words = t.encode("utf-8").translate(WORD_BYTES).decode("utf-8").split(" ")
        cut.append((np.array([number.setdefault(w, len(number)) for w in words if w], np.int32), y))
    # features as numbers: of all words one after another, and how many each word has
    names: dict[str, int] = {}
    ids, widths = array("i"), array("i")
    for w in number:
        of_word = features_of(w)
        ids.extend(names.setdefault(f, len(names)) for f in of_word)
        widths.append(len(of_word))
    number.clear()
    all_of, sizes_of = np.array(ids, np.int32), np.array(widths, np.int64)
    begins = np.cumsum(sizes_of) - sizes_of
    in_docs = np.zeros((2, len(names)), np.int64)
    for words, y in cut:
        u = np.unique(words)
        own = np.arange(sizes_of[u].sum()) + np.repeat(begins[u] - (np.cumsum(sizes_of[u]) - sizes_of[u]), sizes_of[u])
        in_docs[y, np.unique(all_of[own])] += 1
    least = max(LEAST_DOCS, LEAST_SHARE * sizes[1])
    lift = (in_docs[1] / max(1, sizes[1])) / ((in_docs[0] + 0.5) / max(1, sizes[0]))
    common = in_docs.sum(axis=0) >= LEAST_DOCS
    marked = common & (in_docs[1] >= least) & (lift >= LIFT)
    by_word = lambda of_feature: np.diff(np.concatenate(([0], np.cumsum(of_feature[all_of])))[np.append(begins, len(all_of))])
    toxic = by_word(marked) > 0
    sizes_of, all_of = by_word(common), (np.cumsum(common) - 1).astype(np.int32)[all_of[common[all_of]]]
    index = dict(zip((f for f, c in zip(names, common, strict=True) if c), range(int(common.sum())), strict=True))
    names.clear()
    tokens = np.concatenate([np.empty(0, np.int32), *(ids for ids, _ in cut)])
    if not len(tokens):
        return Model()
    lengths = [min(BLOCK, len(ids) - a) for ids, _ in cut for a in range(0, len(ids), BLOCK)]
    y = (np.repeat([bool(v) for _, v in cut], [len(ids) for ids, _ in cut]) & toxic[tokens]).astype(float)
    width, begin = sizes_of[tokens].astype(np.int8), (np.cumsum(sizes_of) - sizes_of)[tokens].astype(np.int32)
    ends = np.cumsum(width, dtype=np.int64)
    flat = np.empty(int(ends[-1]), np.int32)
    parts = [(a, min(a + PART, len(y))) for a in range(0, len(y), PART)]
    for a, b in parts:  # by parts, as indexes and floats take several times the room of the numbers themselves
        first = ends[a] - width[a]
        flat[first : ends[b - 1]] = all_of[np.arange(ends[b - 1] - first) + np.repeat(begin[a:b] - (ends[a:b] - width[a:b] - first), width[a:b])]
    del begin, all_of, tokens, cut
    of = lambda a, b: flat[ends[a] - width[a] : ends[b - 1]]
    size = np.array(lengths)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(size) - size] = False
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[:-1][inner[1:]].astype(int), y[1:][inner[1:]].astype(int)), 1)
    share = min(max(y.mean(), 1e-6), 0.5)
    weights, move, bias = np.zeros(len(index)), np.zeros((2, 2)), float(np.log(share / (1 - share)))
    slow, slow_move, slow_bias = np.full(len(index), 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(STEPS):
        emitted = np.concatenate([np.bincount(np.repeat(np.arange(b - a), width[a:b]), weights[of(a, b)], b - a) for a, b in parts])
        p, pairs = forward_backward(bias + emitted, size, np.exp(move), np.ones(2))
        error = y - p
        g = sum((np.bincount(of(a, b), np.repeat(error[a:b], width[a:b]), len(index)) for a, b in parts), -DECAY * weights)
        gm, gb = seen_pairs - pairs, error.sum()
        slow, slow_move, slow_bias = slow + g * g, slow_move + gm * gm, slow_bias + gb * gb
        weights += RATE * g / np.sqrt(slow)
        move += RATE * gm / np.sqrt(slow_move)
        bias += RATE * gb / np.sqrt(slow_bias)
    return Model({f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-3}, float(bias), np.exp(move))


def logistic(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Penalised logistic regression by Newton steps; classes are weighed so that toxic has the share prior."""
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    weigh = np.where(y == 1, prior / n1, (1 - prior) / n0) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weigh * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weigh * (y - p)) - 0.1 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learns=None, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """learns: a condition on the id; rows for which it fails are not learned from. A ValueError where documents of both kinds
    are labelled and the bound on texts leaves one kind none."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marks = marks.where(learns(F.col("id"))) if learns else marks
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    marks = marks.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    share = marks.agg(F.avg("y")).head()[0]
    if share is None:
        return Model()
    order = [F.xxhash64("id"), "id"]
    chosen = marks.where("y = 1").orderBy(*order).limit(sample_docs).unionByName(marks.where("y = 0").orderBy(*order).limit(sample_docs))
    # at most twice sample_docs ids: fit to be broadcast, as is what is left of them below
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    sized = texts.select("id", "h", F.octet_length("text").cast("long").alias("size")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.struct("h", "size")).alias("one"))
    sized = sized.where(F.col("one.size") <= sample_bytes // LARGEST)
    so_far = F.sum("one.size").over(Window.partitionBy("y").orderBy(*order))
    kept = sized.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes).select("id", "y", "one.h")
    rows = texts.join(F.broadcast(kept), ["id", "h"]).groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    if 0 < share < 1 and len({r["y"] for r in rows}) < 2:
        raise ValueError(f"all labelled texts of one kind take more than {sample_bytes // LARGEST} bytes; a larger sample_bytes lets them be learned from")
    return fit([(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["id"] * 2654435761 % (1 << 32), r["id"]))], float(share))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, score, predicted, spans (start, end and marginal of offending tokens, in characters)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known = WordScores(m)
        for part in slices_of(batches):
            scores, spans = judge(part.column(1), m, known)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array((scores >= cut).astype(np.int32)), pa.array(spans, spans_type)], names=["doc_id", "score", "predicted", "spans"])

    return bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, score double, predicted int, spans array<struct<start: int, end: int, marginal: double>>")


def judge(texts: pa.Array, model: Model, known: WordScores) -> tuple[np.ndarray, list[list[dict]]]:
    if model.head is None:
        return np.zeros(len(texts)), [[] for _ in texts]
    marginals, lengths = tag(texts, model, known)
    scores = 1 / (1 + np.exp(-np.clip(summary(marginals, lengths) @ model.head, -30, 30)))
    ends = np.cumsum(lengths)
    bad = np.flatnonzero(marginals >= 0.5)
    spans: list[list[dict]] = [[] for _ in texts]
    owner = np.searchsorted(ends, bad, side="right")
    for i in np.unique(owner).tolist():
        here, text = bad[owner == i], texts[i].as_py().encode("utf-8")
        at = here - (ends[i] - lengths[i])
        edge = np.diff(np.concatenate(([0], np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 0x20, [0])).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1)[at], np.flatnonzero(edge == -1)[at]
        chars = np.concatenate(([0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)))
        spans[i] = [{"start": int(s), "end": int(e), "marginal": float(p)} for s, e, p in zip(chars[begin], chars[end], marginals[here], strict=True)]
    return scores, spans


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that never saw the labels of held-out ids (crc32 of the id, mod 4, is 2)."""
    model = train(docs, labels, learns=lambda i: ~held_out(i))
    return score_documents(docs, model).select("doc_id", (id_text_crc("doc_id") % 4 == 2).alias("held_out"), "score", "predicted", "spans")


def reject_toxic(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The documents whose score is below cut, with all their columns as they are."""
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known = WordScores(m)
        for part in slices_of(batches):
            yield part.filter(pa.array(judge(part.column(at), m, known)[0] < cut))

    return bound_batches(docs).mapInArrow(keep, docs.schema)
