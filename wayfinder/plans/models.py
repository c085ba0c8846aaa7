"""Models behind summaries, vectors and reranking: a small protocol, offline stand-ins, HTTP providers, retries."""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.config import Reranker


class Provider(Protocol):
    def complete(self, prompt: str, max_tokens: int) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class OfflineProvider:
    """Deterministic: hashed word vectors of unit length; a completion repeats the prompt's first words as JSON."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def complete(self, prompt: str, max_tokens: int) -> str:
        words = re.findall(r"\w+", prompt)[: max(1, min(max_tokens, 24))]
        return json.dumps({"short_summary": " ".join(words), "keywords": sorted(set(w.lower() for w in words))[:5]})

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v))
            out.append([x / size for x in v] if size else v)
        return out


class RequestFailed(Exception):
    def __init__(self, message: str, again: bool):
        super().__init__(message)
        self.again = again


def retried(call: Callable, tries: int = 3, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """call(), again after doubling waits if it failed in a way that may pass (transport, time-out, status 500 or more)."""
    for k in range(tries):
        try:
            return call()
        except RequestFailed as e:
            if not e.again or k + 1 == tries:
                raise
            sleep(wait * 2**k)


def in_flight(calls: Iterable[Callable], most: int) -> Iterator:
    """Results of calls in their order, of which ``most`` run at once. A call is taken when one before it is given out, so that a
    task holds no more of its input than that."""
    if most <= 1:
        yield from (call() for call in calls)
        return
    with ThreadPoolExecutor(most) as pool:
        running = deque()
        try:
            for call in calls:
                running.append(pool.submit(call))
                if len(running) >= most:
                    yield running.popleft().result()
            while running:
                yield running.popleft().result()
        finally:  # who stops asking doesn't wait for what hasn't begun
            for left in running:
                left.cancel()


class HttpProvider:
    """A chat-completions and embeddings endpoint in the common JSON form."""

    def __init__(self, base_url: str, model: str, embedding_model: str, key: str = "", timeout: float = 60, temperature: float = 0.2):
        self.base_url, self.model, self.embedding_model, self.key, self.timeout, self.temperature = base_url.rstrip("/"), model, embedding_model, key, timeout, temperature

    def _post(self, path: str, body: dict) -> dict:
        def call() -> dict:
            request = urllib.request.Request(self.base_url + path, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}))
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                raise RequestFailed(f"status {e.code}", e.code >= 500) from e
            except (urllib.error.URLError, TimeoutError) as e:
                raise RequestFailed(str(e), True) from e

        return retried(call)

    def complete(self, prompt: str, max_tokens: int) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens, "temperature": self.temperature, "response_format": {"type": "json_object"}}
        reply = self._post("/chat/completions", body)
        try:
            return reply["choices"][0]["message"]["content"] or ""
        except (KeyError, IndexError, TypeError) as e:
            raise RequestFailed("a reply without a choice", False) from e

    def embed(self, texts: list[str]) -> list[list[float]]:
        rows = self._post("/embeddings", {"model": self.embedding_model, "input": texts})["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]

    def rerank(self, query: str, texts: list[str]) -> list[tuple[int, float]]:
        rows = self._post("/rerank", {"model": self.model, "query": query, "documents": texts})["results"]
        return [(r["index"], r["relevance_score"]) for r in rows]


def scorer_of(provider, query: str, config: Reranker, most: int = 1) -> Callable[[list[str]], list[tuple[int, float]]]:
    """A second-stage scorer for the search: texts go in batches of the configured size, ``most`` of which are asked at once."""

    def score(texts: list[str]) -> list[tuple[int, float]]:
        begins = range(0, len(texts), config.batch_size)
        found = in_flight((functools.partial(provider.rerank, query, texts[a : a + config.batch_size]) for a in begins), most)
        return [(a + i, s) for a, part in zip(begins, found, strict=True) for i, s in part if 0 <= i < config.batch_size]

    return score


def tolerant_json(text: str) -> dict | None:
    """The first JSON object in a reply: whole, in a code fence, amid prose, with ) for the last }, or cut off."""
    for start in (m.start() for m in re.finditer(r"\{", text)):
        try:
            found, _ = json.JSONDecoder().raw_decode(text[start:])
            return found
        except ValueError:
            pass
        for candidate in mended(text[start:]):
            try:
                return json.loads(candidate)
            except ValueError:
                continue
    return None


def mended(text: str) -> Iterator[str]:
    """A cut-off object closed after what it holds, then after ever less of it, back to its last whole values."""
    text = text.strip().removesuffix("```").strip()
    if text.endswith(")"):
        text = text[:-1] + "}"
    open_, inside, escaped, ends = [], False, False, []
    for i, c in enumerate(text):
        if inside:
            inside, escaped = escaped or c != '"', c == "\\" and not escaped
            if not inside:
                ends.append((i + 1, "".join(open_)))
        elif c == '"':
            inside = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_:
                break
            open_.pop()
            ends.append((i + 1, "".join(open_)))
        elif c.isdigit() or c in "el":  # numbers, true, false, null
            ends.append((i + 1, "".join(open_)))
    yield text + ('"' if inside else "") + "".join(reversed(open_))
    for end, closing in reversed(ends):
        yield text[:end] + closing[::-1]


def make_provider(config, name: str, model: str, key: str = "") -> Callable[[], Provider] | None:
    """What makes the configured provider in a task; None for no name, 'offline' for the stand-in."""
    if not name:
        return None
    if name == "offline":
        return functools.partial(OfflineProvider, config.embedding.dimensions)
    if name not in config.providers:
        raise ValueError(f"no provider is called {name!r}")
    given = config.providers[name]
    return functools.partial(HttpProvider, given["base_url"], model or config.summary.model, config.embedding.model, key or given.get("api_key", ""), float(given.get("timeout_secs", 60)), config.summary.temperature)


def embedding_text() -> Column:
    keys = F.when(F.size("keywords") > 0, F.concat(F.lit("Keywords: "), F.array_join("keywords", ", ")))
    return F.concat_ws("\n", F.concat_ws(": ", "kind", "name"), "short_summary", keys)


def embed_rows(work: DataFrame, make: Callable[[], Provider], model: str, dimensions: int, batch: int = 32) -> DataFrame:
    """entity_id, model, dimensions, updated_at, vector of work (entity_id, kind, name, short_summary, keywords). A batch that
    fails is sent one by one; what fails alone, or comes with other dimensions, gives no row and is due again next time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for f in frames:
            rows = list(zip(f["entity_id"], f["text"], strict=True))
            out = []
            for a in range(0, len(rows), batch):
                part = rows[a : a + batch]
                out += [(i, v) for (i, _), v in zip(part, _embedded(provider, [t for _, t in part]), strict=True) if v is not None and len(v) == dimensions]
            yield pd.DataFrame({"entity_id": pd.Series([i for i, _ in out], dtype=object), "vector": pd.Series([v for _, v in out], dtype=object)})

    found = work.select("entity_id", embedding_text().alias("text")).mapInPandas(run, "entity_id string, vector array<float>")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return found.select("entity_id", F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"), stamp.alias("updated_at"), "vector")


def _embedded(provider: Provider, texts: list[str]) -> list[list[float] | None]:
    try:
        found = provider.embed(texts)
        if len(found) == len(texts):
            return found
    except Exception:
        if len(texts) == 1:
            return [None]
    return [None] if len(texts) == 1 else [_embedded(provider, [t])[0] for t in texts]
