"""Interfaces for remote services; credentials come from configuration, and nothing is fetched without a client."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NucleotideClient(Protocol):
    def fetch(self, accession: str, start: int, end: int) -> str: ...


class HomologyClient(Protocol):
    def search(self, sequence: str) -> list[tuple[str, float, int, int]]:
        """title, expect, align_len and identities of each hit, best first."""


class FileClient(Protocol):
    def download(self, name: str) -> bytes: ...


def download_files(wanted: DataFrame, client: Callable[[], FileClient]) -> DataFrame:
    """name and content of the files that rows (name) ask for; each task makes one client."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = client()
        for pdf in batches:
            for name in pdf["name"]:  # a file at a time
                yield pd.DataFrame({"name": [name], "content": [service.download(name)]})

    return wanted.select("name").mapInPandas(run, "name string, content binary")


def search_hits(chains: DataFrame, client: Callable[[], HomologyClient], limit: float = 0.1) -> DataFrame:
    """chain_id, hit, title, expect, align_len, identities of the significant hits of rows (chain_id, seq)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = client()
        for pdf in batches:
            rows = [(c, k, *hit) for c, s in zip(pdf["chain_id"], pdf["seq"]) for k, hit in enumerate(service.search(s))]
            yield pd.DataFrame(rows, columns=["chain_id", "hit", "title", "expect", "align_len", "identities"])

    found = chains.select("chain_id", "seq").mapInPandas(run, "chain_id string, hit int, title string, expect double, align_len int, identities int")
    return significant(found, "expect", limit)


def fetch_ranges(wanted: DataFrame, client: Callable[[], NucleotideClient]) -> DataFrame:
    """Add ``nt`` to rows (acc, s_start, s_end); each task makes one client, which keeps to its service's rate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = client()
        for pdf in batches:
            yield pdf.assign(nt=[service.fetch(a, int(s), int(e)) for a, s, e in zip(pdf["acc"], pdf["s_start"], pdf["s_end"])])

    return wanted.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema), "nt string"]))


def ranges_from_table(wanted: DataFrame, sequences: DataFrame) -> DataFrame:
    """The same from a local table (acc, sequence)."""
    return wanted.join(sequences, "acc").withColumn("nt", F.substr("sequence", F.col("s_start"), F.col("s_end") - F.col("s_start") + 1)).drop("sequence")


def significant(hits: DataFrame, expect: str = "expect", limit: float = 0.1) -> DataFrame:
    return hits.where(F.col(expect) < limit)


def not_predicted(title: Column) -> Column:
    """Whether the first three words of a title speak neither of predicted nor of synthetic sequences."""
    return ~F.lower(F.substring_index(title, " ", 3)).rlike("predicted|synthetic")


def good_match(title: Column, organism: Column, length: Column, identities: Column, least: int = 100, share: float = 0.96) -> Column:
    """The organism is named before the title's first comma, or the match is long and close."""
    named = F.contains(F.lower(F.substring_index(title, ",", 1)), organism)
    return named | ((length >= least) & (identities / length >= share))
