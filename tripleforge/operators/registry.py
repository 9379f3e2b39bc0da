"""Pluggable model operators: text to triples and mentions, with retries and fallbacks that keep their meaning."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

EXTRACTORS: dict[str, Callable[[str], list[tuple[str, str, str]]]] = {}


def extractor(name: str):
    def add(f):
        EXTRACTORS[name] = f
        return f

    return add


@extractor("first_last")
def first_last(sentence: str) -> list[tuple[str, str, str]]:
    """Fallback: the first word relates to the last."""
    words = sentence.split()
    return [(words[0], "relatedTo", words[-1])] if len(words) > 1 else []


@extractor("copula")
def copula(sentence: str) -> list[tuple[str, str, str]]:
    """What stands before and after the first copula."""
    words = sentence.split()
    for k, word in enumerate(words):
        if word.lower() in ("is", "are", "was", "were") and 0 < k < len(words) - 1:
            return [(" ".join(words[:k]), word.lower(), " ".join(words[k + 1 :]))]
    return []


def extract(sentences: DataFrame, f: Callable[[str], list[tuple[str, str, str]]], fallback: Callable = first_last, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """(id, sub, rel, obj, status) of sentences (id, sentence). A failing model is asked again, waiting twice as long
    each time; then the fallback's triples come with status ERROR."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, sentence in zip(batch["id"], batch["sentence"], strict=True):
                status, found = "ERROR", None
                for n in range(tries):
                    try:
                        found, status = f(sentence or ""), "OK"
                        break
                    except Exception:  # noqa: BLE001  whatever a model raises
                        time.sleep(wait * 2**n)
                if found is None:
                    found = fallback(sentence or "")
                rows += [(key, *triple, status) for triple in found]
            yield pd.DataFrame(rows, columns=["id", "sub", "rel", "obj", "status"])

    return sentences.select("id", "sentence").mapInPandas(run, "id long, sub string, rel string, obj string, status string")
