"""Byte-level BPE: encoding and decoding with a local rank file.

The merging is tiktoken's; what is added here is the regex pre-splitting of long texts.  A text longer than
``SPLIT_AT`` code points is cut at *safe boundaries* before it goes to the encoder, so that one very long text never
needs one very long regex match state.  A boundary is safe when no match of the pattern can span it and no look-ahead
to its left can see over it.  With the usual byte-BPE pattern that is so

* where a character that is not white space is followed by white space: every alternative holds white space only at
  its start, and the look-ahead ``(?!\\S)`` belongs to a match of white space only, and
* where a letter is followed by a character that is neither letter, digit nor white space, or a digit by a letter.

A run of white space longer than ``LONG_RUN`` is more than the regex engine's stack holds.  It has one match by itself,
all of it at the end of a text and all but its last character elsewhere, and is given to the encoder as that match.

Defined results: a null text is an empty text and has no ids; decoding gives back exactly the bytes of the text.
Repeated rows are encoded each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.batches import map_batches

SPLIT_AT = 65_536
LONG_RUN = 65_536
_SPACE = r"\p{White_Space}"
_SAFE = regex.compile(rf"(?<=[^{_SPACE}])(?={_SPACE})|(?<=\p{{L}})(?=[^{_SPACE}\p{{L}}\p{{N}}])|(?<=\p{{N}})(?=\p{{L}})")
_RUN = regex.compile(rf"{_SPACE}{{{LONG_RUN + 1},}}+")

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def safe_parts(text: str, size: int = SPLIT_AT) -> list[str]:
    """The text in parts of about ``size`` code points, cut at safe boundaries only (a part is longer if it has none)."""
    out, start = [], 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if found is None:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankTokenizer:
    """A tiktoken encoding made from a local rank file, or from ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self._own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._ranks, self._runs = ranks, r"\s+(?!\S)" in pattern

    @functools.cached_property
    def _one_match(self):
        """The same ranks for texts that are one match."""
        import tiktoken

        return tiktoken.Encoding("match", pat_str=r"[\s\S]+", mergeable_ranks=self._ranks, special_tokens={})

    @classmethod
    @functools.cache
    def load(cls, path: str, pattern: str) -> RankTokenizer:
        """One per Python worker."""
        return cls(read_ranks(path), pattern)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= SPLIT_AT:
            return np.asarray(self._own.encode_ordinary(text), dtype="<u4")
        found = []
        for part in safe_parts(text):
            at = 0
            for run in _RUN.finditer(part) if self._runs and len(part) > LONG_RUN else ():
                end = run.end() - (run.end() < len(part))
                found += [self._own.encode_ordinary(part[at : run.start()]), self._one_match.encode_ordinary(part[run.start() : end])]
                at = end
            found.append(self._own.encode_ordinary(part[at:]))
        return np.concatenate([np.asarray(ids, dtype="<u4") for ids in found])

    def decode(self, ids: np.ndarray) -> bytes:
        """Raw bytes, which need not be valid UTF-8 if ids were cut."""
        return self._own.decode_bytes(ids.tolist())


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others
    for the code points from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class JsonTokenizer:
    """Ids as the tokenizers library gives them for a byte-level BPE file with ``add_special_tokens=False``.

    The library itself encodes about 1.5 MB a second and core here.  Its ids equal those of tiktoken with the same
    vocabulary as ranks, at five times the speed, as long as both read the pattern's classes alike.  That depends on
    the Unicode tables in each, so only texts within ``_ALIKE`` (Latin scripts, common punctuation) go to tiktoken and
    all others to the library.  A text without two white-space characters in a row has the same matches when the
    pattern's look-ahead is left out, which is quicker still.

    Strings of the file's added tokens get those tokens' ids; what lies between them is encoded by itself.  A file that
    is not the plain byte-level BPE that all this is true of (:meth:`plain`) is left to the library, whole texts at a time.
    """

    _ALIKE = re.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ‐-‧€]*")
    _RUN = re.compile(r"\s\s")
    # The usual byte-BPE pattern with possessive repeats, and the same for texts of single white spaces.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    PATTERN_SINGLE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self._full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        self._plain = self.plain(own)
        if self._plain:
            self._added = {t["content"]: t["id"] for t in own.get("added_tokens") or ()}
            self._cuts = re.compile("|".join(map(re.escape, sorted(self._added, key=len, reverse=True)))) if self._added else None
            byte = byte_of_character()
            ranks = {bytes(byte[c] for c in token): i for token, i in own["model"]["vocab"].items() if token not in self._added}
            self._quick, self._single = RankTokenizer(ranks, self.PATTERN), RankTokenizer(ranks, self.PATTERN_SINGLE)

    @staticmethod
    def plain(file: dict) -> bool:
        """Whether the file's ids are those of its ranks: byte-level BPE with the usual pattern, nothing normalized or
        added, merges in the order of their ids, and added tokens that match as they are."""
        model, before, vocab = file["model"], file.get("pre_tokenizer") or {}, file["model"].get("vocab", {})
        added = {t["content"] for t in file.get("added_tokens") or ()}
        ids = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in model.get("merges", ())]
        known = byte_of_character()
        return (
            model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and file.get("normalizer") is None
            and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and not any(t[k] for t in file.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and all(a < b for a, b in itertools.pairwise([-1, *ids]))
            and len(ids) + len(known) == len(vocab.keys() - added) and known.keys() <= vocab.keys()
        )

    @classmethod
    @functools.cache
    def load(cls, path: str) -> JsonTokenizer:
        return cls(path)

    def encode(self, text: str) -> np.ndarray:
        if not self._plain:
            return np.asarray(self._full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if self._cuts is None or not self._cuts.search(text):
            return self._ordinary(text)
        found, at = [], 0
        for m in self._cuts.finditer(text):
            found += [self._ordinary(text[at : m.start()]), np.array([self._added[m[0]]], dtype="<u4")]
            at = m.end()
        return np.concatenate([*found, self._ordinary(text[at:])])

    def _ordinary(self, text: str) -> np.ndarray:
        if self._ALIKE.fullmatch(text):
            return (self._quick if self._RUN.search(text) else self._single).encode(text)
        return np.concatenate([np.asarray(self._full.encode(p, add_special_tokens=False).ids, dtype="<u4") for p in safe_parts(text)])

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        return map(self.encode, texts)


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encodes every whole text and decodes the ids again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = RankTokenizer.load(ranks, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = own.encode(text or "")
                rows.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, ENCODED)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The ids themselves: ``doc_id, ids array<int>``."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = RankTokenizer.load(ranks, pattern)
        for batch in batches:
            ids = [own.encode(t or "").astype("i4") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Ids back to raw bytes: ``doc_id, content binary`` (null ids: empty)."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = RankTokenizer.load(ranks, pattern)
        for batch in batches:
            content = [own.decode(np.asarray(i)) if i is not None else b"" for i in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": content})

    return map_batches(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), work, "doc_id long, content binary")
