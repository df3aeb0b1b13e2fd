"""Language models and embeddings as injected providers, with deterministic ones for offline use.

Provider failures are values (a status column), so no task dies because one prompt failed."""

from __future__ import annotations

import hashlib
import subprocess
import tempfile
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable
from json import dumps, loads
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LanguageModel(Protocol):
    def generate(self, prompt: str, *, json: bool = False) -> str: ...


class Embedding(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ProviderError(RuntimeError):
    """A call that gave no answer; retryable ones may be tried again."""

    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


class HashedNgrams:
    """Embeds texts as signed counts of hashed character n-grams: each n-gram is hashed once for a text, those of three code points, which fit one key, once for many."""

    #: Hashed n-grams that are kept at most.
    HELD = 1 << 20

    def __init__(self, width: int = 64, sizes: tuple[int, ...] = (1, 2, 3)):
        self.width, self.sizes = width, sizes
        self.places: dict[int, int] = {}

    def _hashed(self, gram: str) -> int:
        """The signed place of an n-gram, from 1 or -1."""
        h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
        return (h % self.width + 1) * (1 if h >> 63 else -1)

    def _place(self, key: int) -> int:
        found = self.places.get(key)
        if found is None:
            found = self._hashed("".join(chr(c - 1) for c in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c))
            if len(self.places) >= self.HELD:
                self.places.clear()
            self.places[key] = found
        return found

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts, strict=True):
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
            for n in self.sizes:
                if n > 3:
                    for gram, count in Counter(text[i : i + n] for i in range(len(text) - n + 1)).items():
                        place = self._hashed(gram)
                        row[abs(place) - 1] += count if place > 0 else -count
                    continue
                keys = np.zeros(max(0, len(codes) - n + 1), np.int64)
                for i in range(n):
                    keys = keys << 21 | codes[i : i + len(keys)]
                grams, counts = np.unique(keys, return_counts=True)
                places = np.array([self._place(k) for k in grams.tolist()], np.int64)
                np.add.at(row, np.abs(places) - 1, np.sign(places) * counts)
        return out.tolist()


class Scripted:
    """Answers by a function of the prompt; for tests and offline runs."""

    def __init__(self, answer: Callable[[str], str]):
        self.answer = answer

    def generate(self, prompt: str, *, json: bool = False) -> str:
        return self.answer(prompt)


class LocalHttp:
    """A model server that takes a POST of a prompt and answers with a field `response`; an error or an empty answer fails, nothing else is asked instead."""

    def __init__(self, url: str, model: str, timeout: float = 600.0, temperature: float | None = None):
        self.url, self.model, self.timeout, self.temperature = url, model, timeout, temperature

    def generate(self, prompt: str, *, json: bool = False) -> str:
        ask: dict[str, object] = {"model": self.model, "prompt": prompt, "stream": False, "think": False}
        if self.temperature is not None:
            ask["options"] = {"temperature": self.temperature}
        if json:
            ask["format"] = "json"
        request = urllib.request.Request(self.url, data=dumps(ask).encode(), headers={"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as got:
                said = loads(got.read())
        except urllib.error.HTTPError as e:
            raise ProviderError(f"{self.url}: {e}", e.code == 429 or e.code >= 500) from e
        except (OSError, ValueError) as e:
            raise ProviderError(f"{self.url}: {e}", isinstance(e, OSError)) from e
        if not isinstance(said, dict) or not said.get("response"):
            raise ProviderError(f"{self.url}: no answer")
        return said["response"]


class CommandLine:
    """A program that gets the prompt through a pipe and leaves its answer in the file that the prompt's last line names.

    The file lies in a folder of the worker's own that goes with the call; a failure or an empty file fails the call."""

    def __init__(self, command: list[str], timeout: float = 600.0):
        self.command, self.timeout = command, timeout

    def generate(self, prompt: str, *, json: bool = False) -> str:
        with tempfile.TemporaryDirectory(prefix="plexgraph-call-") as folder:
            answer = Path(folder) / "answer.txt"
            try:
                subprocess.run(self.command, input=f"{prompt}\n\nYour reply belongs in this file: {answer}".encode(), capture_output=True, timeout=self.timeout, check=True)
            except (OSError, subprocess.SubprocessError) as e:
                raise ProviderError(f"{self.command[0]}: {e}") from e
            said = answer.read_text(encoding="utf-8").strip() if answer.exists() else ""
        if not said:
            raise ProviderError(f"{self.command[0]}: no answer")
        return said


class Patient:
    """Retries retryable failures with growing pauses, and paces all attempts."""

    def __init__(self, inner: LanguageModel, retries: int = 2, pause: float = 5.0, interval: float = 0.0, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.retries, self.pause, self.interval, self.sleep = inner, retries, pause, interval, sleep

    def generate(self, prompt: str, *, json: bool = False) -> str:
        for attempt in range(self.retries + 1):
            try:
                return self.inner.generate(prompt, json=json)
            except ProviderError as e:
                if not e.retryable or attempt == self.retries:
                    raise
                self.sleep(self.pause * (attempt + 1))
            finally:
                if self.interval:
                    self.sleep(self.interval)
        raise AssertionError


class Router:
    """Providers by name; an unknown name is an error, never a silent default."""

    def __init__(self, providers: dict[str, LanguageModel], default: str):
        self.providers, self.default = providers, default

    def get(self, name: str | None = None) -> LanguageModel:
        if (name or self.default) not in self.providers:
            raise ValueError(f"unknown provider {name!r}")
        return self.providers[name or self.default]


def generated(prompts: DataFrame, model: LanguageModel, prompt: str = "prompt", json: bool = False, parallel: int | None = None) -> DataFrame:
    """prompts with response and ok; parallel caps how many calls run at once."""

    def own(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts:
            try:
                rows.append({"response": model.generate(x.as_py(), json=json), "ok": True})
            except Exception as e:  # any failure of a call is a value
                rows.append({"response": str(e), "ok": False})
        return pa.array(rows, pa.struct([("response", pa.string()), ("ok", pa.bool_())]))

    df = prompts.repartition(parallel) if parallel else prompts
    said = F.arrow_udf(own, "struct<response:string,ok:boolean>").asNondeterministic()
    return df.withColumn("__said", said(prompt)).select(*prompts.columns, F.when(F.col("__said.ok"), F.col("__said.response")).alias("response"), F.col("__said.ok").alias("ok"))


def embedded(text: Column, provider: Embedding) -> Column:
    """The embeddings of a text column, in Arrow batches."""

    def own(batch: pa.Array) -> pa.Array:
        return pa.array(provider.embed([x or "" for x in batch.to_pylist()]) if len(batch) else [], pa.list_(pa.float32()))

    return F.arrow_udf(own, "array<float>")(text)
