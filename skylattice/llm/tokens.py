"""Exact token counts for every prefix, by dynamic programming over byte prefixes.

The pre-tokenizer cuts a text into pieces that byte pair encoding never joins, so the count of a text is the sum over
its pieces. Inside a piece the encoding of a prefix is that of a shorter prefix plus one last token: the token t may
follow the last token p of the shorter prefix exactly if encoding the bytes of p and t together gives p and t again.
So one pass over the prefixes, longest token first, finds the last token of each, and with it the count.
Pieces repeat a lot: the counts of a piece are kept, in a table of bounded size, for all texts of a worker.

The vocabulary file's path is a parameter; the counts equal those of the library that the file is made for.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The byte-level pre-tokenizer's pattern (White_Space as that library's engine has it).
PIECE = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pieces of up to so many characters are kept, and so many of them.
KEEP_CHARS, KEEP_PIECES = 64, 600_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Edge(Exception):
    """A space beside other white space or at an end: the text is cut as a whole."""


class _Memo(dict):
    """A table of bounded size that fills itself; keys that are too long aren't kept."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= KEEP_CHARS:
            if len(self) >= KEEP_PIECES:
                self.clear()
            self[key] = value
        return value


class PrefixCounter:
    """Counts of a byte-level BPE vocabulary in a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # A token's number is its age: single bytes first, then the merges in their order.
        self.age = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.born: dict[tuple[int, int], int] = {}
        for a, b in merges:
            a, b = as_bytes(a), as_bytes(b)
            pair = (self.age[a], self.age[b])
            self.born[pair] = len(self.parts)
            self.age.setdefault(a + b, len(self.parts))
            self.parts.append(pair)
        self.ends = ahocorasick.Automaton()
        for token, age in self.age.items():
            self.ends.add_word(token.decode("latin-1"), (len(token), age))
        self.ends.make_automaton()
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(PIECE)
        self.pairs = {}
        self.totals = _Memo(lambda piece: self.piece_counts(piece.encode("utf-8", "surrogatepass"))[-1])
        self.words = _Memo(self._word)

    def _follows(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay apart: no merge across their border is due before both are complete.

        Taken backwards in time, the younger of the two falls into its parts; the part at the border goes on.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is not None:
            return known
        due, apart = 1 << 60, True
        while True:
            joint = self.born.get((a, b))
            if joint is not None and joint < due:
                apart = False
                break
            # The right token is made before the left one's next step only if it is older; equal ages: left first.
            left, right = self.parts[a], self.parts[b]
            if left is None and right is None:
                break
            if right is None or left is not None and a > b:
                due, a = a, left[1]
            else:
                due, b = b + 1, right[0]
        if len(self.pairs) >= KEEP_PIECES:
            self.pairs.clear()
        self.pairs[key] = apart
        return apart

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token counts of the prefixes of one piece, from 0 bytes to all."""
        counts, last, pairs = [0] * (len(piece) + 1), [-1] * (len(piece) + 1), self.pairs
        for at, (size, t) in self.ends.iter(piece.decode("latin-1")):  # at each end, the longest token first
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                ok = pairs.get((last[start], t))
                if not (self._follows(last[start], t) if ok is None else ok):
                    continue
            counts[end], last[end] = counts[start] + 1, t
        return counts

    def _run(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, self.pieces.findall(text)))

    def _word(self, word: str) -> int:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Edge
        return self._run(" " + word)

    def _plain(self, text: str) -> int:
        """Between single spaces, a word with the space before it is cut alike in every text, so words are kept too."""
        words = text.split(" ")
        first = words.pop(0)
        try:
            if first[-1:].isspace():
                raise _Edge
            return self._run(first) + sum(map(self.words.__getitem__, words))
        except _Edge:
            return self._run(text)

    def _split(self, text: str) -> list[str]:
        """Plain parts at even places, special strings at odd ones."""
        return [text] if self.cut_special is None else self.cut_special.split(text)

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; 0 for null."""
        parts = self._split(text or "")
        return sum(map(self._plain, parts[::2])) + len(parts) // 2

    def prefix_counts(self, text: str | None) -> list[int]:
        """For each number of code points from 0 to all: the tokens of that prefix, encoded on its own."""
        out, base, run = [0], 0, ""
        for i, part in enumerate(self._split(text or "")):
            if i % 2 == 0:
                out.extend(base + n for n in self._inside(part)[1:])
                run = part
            else:  # until it is whole, a special string is ordinary text after the run before it
                out.extend(base + n for n in self._inside(run + part[:-1])[len(run) + 1 :])
                base += self._run(run) + 1
                out.append(base)
        return out

    def _inside(self, part: str) -> list[int]:
        counts, base = [0] * (len(part) + 1), 0
        for m in self.pieces.finditer(part):
            a, b = m.span()
            piece = part[a:b]
            if piece.isspace() or piece[0] == "'":
                # Cut with a look ahead: a prefix that ends here is cut anew.
                for end in range(a + 1, b + 1):
                    counts[end] = base + self._run(part[a:end])
            else:
                table, at = self.piece_counts(piece.encode("utf-8", "surrogatepass")), 0
                for end in range(a + 1, b + 1):
                    at += len(part[end - 1].encode("utf-8", "surrogatepass"))
                    counts[end] = base + table[at]
            base = counts[b]
            if a and part[a].isspace() and part[a - 1].isspace():
                # White space at a prefix's end is one piece, however it is cut before a word.
                back = a
                while back and part[back - 1].isspace():
                    back -= 1
                end = a + 1
                while end <= b and part[end - 1].isspace():
                    counts[end] = counts[back] + self._run(part[back:end])
                    end += 1
        return counts

    def truncate(self, text: str | None, budget: int) -> str:
        """The longest prefix whose own count is within the budget."""
        counts = self.prefix_counts(text)
        return (text or "")[: max((i for i, n in enumerate(counts) if n <= budget), default=0)]


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is the path of a byte-level BPE file in tokenizers' JSON form, readable on every executor.
    Nulls count as empty texts: 0 bytes, 0 tokens, not over the limit. Repeated rows are counted each; an empty table
    gives no rows; other columns are not looked at.
    """

    @F.pandas_udf(T.LongType())
    def n_tokens(texts: pd.Series) -> pd.Series:
        count = counter(vocabulary).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        n_tokens(F.col(text_col)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
