"""Column functions over sequences and identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookup import CHAIN_LETTER, CODON_FAMILY, CODON_LABEL, LABEL_CODON, RESIDUE_FAMILY, mapped

# Ambiguity codes and the first base each may stand for; the two maps differ for K and M.
IUPAC_A = ("YRWSKMDVHBXN", "CAAGTCAAACAA")
IUPAC_B = ("RYSWKMBDHVN", "ACGAGACAAAA")


def first_base(nt: Column, codes: tuple[str, str] = IUPAC_A) -> Column:
    return F.translate(nt, *codes)


def reverse_complement(nt: Column) -> Column:
    return F.reverse(F.translate(nt, "ACGT", "TGCA"))


def codons(nt: Column) -> Column:
    """Whole triplets of a sequence, in order."""
    return F.regexp_extract_all(nt, F.lit("(...)"), 1)


def translate(nt: Column) -> Column:
    """Protein of a nucleotide sequence; ``*`` is a stop, ``X`` an unknown triplet."""
    return F.array_join(F.transform(codons(nt), lambda c: F.coalesce(mapped(c, CODON_FAMILY), F.lit("X"))), "")


def codon_label(nt: Column) -> Column:
    """Label of one triplet after ambiguity codes take their first base; null for stops and unknown ones."""
    return mapped(first_base(nt, IUPAC_B), CODON_LABEL)


def label_codon(label: Column) -> Column:
    return mapped(label, LABEL_CODON)


def residue_letter(name: Column) -> Column:
    """One-letter family of a three-letter residue; X for any other."""
    return F.coalesce(mapped(name, RESIDUE_FAMILY), F.lit("X"))


def chain_letter(number: Column) -> Column:
    return mapped(number, CHAIN_LETTER)


def repair_id(text: Column) -> Column:
    """Undo a spreadsheet's reading of an identifier as a number: 1.00E+12 was 1E12."""
    return F.when(F.length(text) > 4, F.concat(F.substring(text, 1, 1), F.substring(text, 5, 1), F.right(text, F.lit(2)))).otherwise(text)


def split_first(text: Column, mark: str) -> tuple[Column, Column]:
    """What is before and after the first ``mark``; without one, the whole and null."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring_index(text, mark, 1)).otherwise(text), F.when(at > 0, F.substr(text, at + len(mark)))


def field(text: Column, n: int, sep: str = "\t") -> Column:
    """The n-th field, counted from 0; null beyond the last."""
    return F.get(F.split(text, f"\\Q{sep}\\E"), n)


def accession(title: Column) -> Column:
    """What stands between the third and fourth vertical bar."""
    return field(title, 3, "|")


def organism_word(text: Column) -> Column:
    """First word in small letters; the virus that titles name by its initials is named so."""
    return F.when(F.contains(F.lower(text), F.lit("human immunodeficiency virus")), "hiv").otherwise(F.lower(F.substring_index(text, " ", 1)))


def one_based_slice(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start, end - start + 1)


def drop_gaps(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(""))


def drop_unknown(protein: Column, nt: Column, backward: bool = False) -> Column:
    """The nucleotides without the triplets that face an X; ``backward`` counts triplets from the end."""
    triplets = F.transform(F.sequence(F.lit(1), F.greatest(F.length(nt).cast("int"), F.lit(1)), F.lit(3)), lambda i: F.substr(nt, i, F.lit(3)))
    if backward:
        triplets = F.transform(triplets, lambda t, i: F.substr(nt, F.greatest(F.length(nt) - 2 - i * 3, F.lit(1)), F.lit(3)))
    kept = F.filter(triplets, lambda t, i: F.coalesce(F.substr(protein, i + 1, F.lit(1)) != "X", F.lit(True)))
    return F.array_join(F.reverse(kept) if backward else kept, "")


def strand_of(nt: Column, protein: Column) -> Column:
    """0 if the sequence reads as the protein forward, 1 backward, else null."""
    return F.when(translate(nt) == protein, 0).when(translate(reverse_complement(nt)) == protein, 1)


LCS_TYPE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("length", "start1", "end1", "start2", "end2")] + [T.StructField("text", T.StringType())])


class _Automaton:
    """The suffix automaton of a text (Blumer and others 1985): states are sets of substrings that end at the same places."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]  # suffix link, longest substring, where it first ends
        last = 0
        for at, c in enumerate(text, 1):
            here = self._state({}, 0, at, at)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = here
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[q] != self.length[p] + 1:  # q also holds longer substrings: those stay, the others get a state
                    twin = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = q = twin
                self.link[here] = q
            last = here

    def _state(self, goes: dict[str, int], link: int, length: int, first: int) -> int:
        self.next.append(goes)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def longest(self, other: str) -> tuple[int, int, int]:
        """Length of the longest substring of ``other`` in the text, where it first ends there, and its first end in the text."""
        state, size, best = 0, 0, (0, 0, 0)
        for at, c in enumerate(other, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            if size > best[0]:
                best = (size, at, self.first[state])
        return best


def _longest_common(a: str, b: str, known: dict[str, _Automaton] | None = None) -> tuple[int, int, int, int, int, str]:
    known = {} if known is None else known
    if b not in known:
        known.clear()
        known[b] = _Automaton(b)
    best, i, j = known[b].longest(a)
    return best, i - best, i, j - best, j, a[i - best : i]


@F.pandas_udf(LCS_TYPE)
def longest_common_substring(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Length, half-open 0-based ranges in both texts, and the substring: the earliest end in the first text, then in the second.

    The work of a pair grows with the sum of its lengths, its memory with the second; pairs that repeat in a batch are compared once.
    """
    for first, second in pairs:
        known: dict[tuple[str, str], tuple] = {}
        rows, made = [], {}
        for a, b in zip(first, second):
            pair = (a or "", b or "")
            if pair not in known:
                known[pair] = _longest_common(*pair, made)
            rows.append(known[pair])
        yield pd.DataFrame(rows, columns=["length", "start1", "end1", "start2", "end2", "text"])
