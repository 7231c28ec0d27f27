"""Operator 8: secrets in text, by patterns and by a token-efficiency test.

Three fixed patterns give the base spans (``assign access hex``). The method
adds spans of kind ``random``: a long run of key-like characters which a public
byte-pair vocabulary needs many tokens for (few characters per token) is a
random string, unless it is a known digest or an identifier.

Null text counts as empty; texts of any length are searched whole; offsets are
code points, end exclusive; rows are independent of each other, so repeated rows
give repeated results; an empty table gives none. Columns beyond doc_id and text
aren't read and may have any name. The vocabulary is read on each executor, from
a path that all have or from a file sent along with ``SparkContext.addFile``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Where the public vocabulary lies on every executor; a parameter of ``scan``.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_CHARS_PER_TOKEN = 2.2
MIN_RANDOM_CHARS = 16

# The base patterns with their least lengths, and the vocabulary's
# own way of cutting plain ASCII strings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, so shorter runs can go unmatched
KINDS = ("assign", "access", "hex", "random")
CUT = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"

_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RANDOM_CHARS},}}")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z", re.IGNORECASE)
_NUMBER = re.compile(r"[0-9+/_=-]+\Z")
#: A piece of a name between separators: words (in any usual case), then perhaps a number; or a number.
_PIECE = re.compile(r"(?:(?:[A-Z]?[a-z]+|[A-Z]+(?![a-z]))+[0-9]{0,4}|[0-9]{1,8})\Z")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_VOWEL = re.compile("[aeiouy]", re.IGNORECASE)
LEAST_WORD_CHARS = 3


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken
    from pyspark import SparkFiles

    if not os.path.exists(path):  # sent along with the job
        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


def _is_name(run: str) -> bool:
    """An identifier: pieces between separators are words that can be spoken, of some length on average, and numbers."""
    pieces = [p for p in re.split("[+/_=-]+", run) if p]
    if not all(map(_PIECE.match, pieces)):
        return False
    found = [w for p in pieces for w in _WORD.findall(p)]
    spoken = sum(bool(_VOWEL.search(w)) or len(w) < LEAST_WORD_CHARS for w in found)
    return bool(found) and sum(map(len, found)) >= LEAST_WORD_CHARS * len(found) and 4 * spoken >= 3 * len(found)


def _is_known(run: str) -> bool:
    """A digest, a UUID, a number or an identifier."""
    return bool(_DIGEST.match(run) or _UUID.match(run) or _NUMBER.match(run)) or _is_name(run)


def spans_of(text: str, vocabulary: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of all spans of one text, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in _RUN.finditer(text):
        run = m[0]
        if run.isalpha() and (run[1:].islower() or run.isupper()):
            continue
        if not _is_known(run) and len(run) < MAX_CHARS_PER_TOKEN * len(_encoder(vocabulary).encode_ordinary(run)):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[rank]}:{start}:{end}" for start, rank, end in found)


def scan(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per document: counts of base kinds, hash of base spans, all spans.

    Narrow: no shuffle, one pass, every whole text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = spans_of(text or "", vocabulary)
                base = [x for x in found if x[1] < 3]
                counts = [sum(x[1] == rank for x in base) for rank in range(3)]
                rows.append((doc_id, *counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(found)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]).astype({"doc_id": batch["doc_id"].dtype})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
