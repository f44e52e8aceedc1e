"""Outside services behind replaceable providers. The ones here are deterministic stand-ins that need no network.

A provider maps a batch of texts to a batch of answers and runs inside tasks (``mapInArrow``), so calls run in parallel
over partitions; pacing and retries are a provider's own matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.functions.steady import give_back, slices

Answer = Callable[[list[str]], list[str]]
#: Bytes of translations that a worker remembers, about.
KEPT_BYTES = 8 << 20
Embed = Callable[[list[str]], list[list[float] | None]]


def keyword_scorer(profile: str) -> Answer:
    """Scores each 'ID:' block of a prompt by the share of the profile's words that it holds, in a fenced JSON array."""
    wanted = set(re.findall(r"\w+", profile.lower()))

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            items = []
            for block in prompt.split("\n\n"):
                m = re.match(r"ID: (.*)\n", block)
                if m:
                    have = set(re.findall(r"\w+", block.lower()))
                    items.append({"id": m[1], "score": round(len(have & wanted) / max(1, len(wanted)), 6)})
            out.append("```json\n" + json.dumps(items) + "\n```")
        return out

    return answer


def hashed_embedding(size: int = 64) -> Embed:
    """A unit vector of hashed word counts; None for texts without words."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for text in texts:
            v = np.zeros(size)
            for w in re.findall(r"\w+", text.lower()):
                h = hashlib.md5(w.encode()).digest()
                v[h[0] % size] += 1 + h[1] / 255
            norm = float(np.linalg.norm(v))
            out.append((v / norm).tolist() if norm else None)
        return out

    return embed


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of ``size`` rows, so that a worker holds the texts and answers of one call."""
    for batch in batches:
        for k in range(0, len(batch), size):
            yield batch.slice(k, size)
        give_back()


def asked(prompts: DataFrame, provider: Answer, key: str = "batch", size: int = 20) -> DataFrame:
    """(key, response) for each (key, prompt); a prompt whose call fails has a null response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, size):
            try:
                answers: list[str | None] = list(provider(part.column(1).to_pylist()))
            except Exception:  # a chunk that fails is skipped, as its rows keep their scores
                answers = [None] * len(part)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(answers, pa.string())], [key, "response"])

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, "prompt").mapInArrow(run, f"{key} {kind}, response string")


def translated(rows: DataFrame, provider: Answer, key: str = "id", text: str = "text", cut: int = 6000, attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """(key, signature, translation) for each (key, text): the first ``cut`` letters, asked for up to ``attempts`` times, with growing pauses of ``pause``
    seconds and more between; null where all fail. The md5 of what is asked is the signature, by which answers can be kept; equal texts of a batch that come within some megabytes are asked for once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = {}, 0
        for batch in batches:
            for part in slices(batch, batch.column(1)):
                asked_ = [(t or "")[:cut] for t in part.column(1).to_pylist()]
                if weight > KEPT_BYTES:
                    known, weight = {}, 0
                for t in asked_:
                    for k in range(0 if t in known else attempts):
                        try:
                            known[t] = provider([t])[0]
                            break
                        except Exception:  # tried again, then left untranslated
                            known[t] = None
                            time.sleep(pause * 2**k)
                        finally:
                            weight += 2 * len(t) + 200
                signatures = [hashlib.md5(t.encode()).hexdigest() for t in asked_]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signatures, pa.string()), pa.array([known[t] for t in asked_], pa.string())], [key, "signature", "translation"])
            known, weight = {}, 0  # what failed in a batch is asked again in the next

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.substring(F.col(text), 1, cut).alias(text)).mapInArrow(run, f"{key} {kind}, signature string, translation string")


def _each(provider, texts: list[str]) -> list:
    """The provider's answers to ``texts``; if the call fails, each text alone, and None for those whose own call fails."""
    try:
        return list(provider(texts))
    except Exception:  # one text may be the cause
        if len(texts) == 1:
            return [None]
        return [_each(provider, [t])[0] for t in texts]


def attempted(rows: DataFrame, provider: Answer, key: str = "id", text: str = "text", size: int = 20) -> DataFrame:
    """(key, answer) for each (key, text), ``size`` texts a call; null where a text's call fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, size):
            made = _each(provider, [t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string())], [key, "answer"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, answer string")


def embedded(rows: DataFrame, provider: Embed, key: str = "id", text: str = "text", size: int = 256) -> DataFrame:
    """(key, vector) for each (key, text); null where the provider gives none or fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, size):
            made = _each(provider, [t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.float32()))], [key, "vector"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, vector array<float>")
