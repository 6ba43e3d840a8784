"""Exact token counts of texts with a public byte-level tokenizer, memoised by line."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Vocabulary file (ranks of byte sequences); a path that every executor reaches.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer cuts a text before it merges bytes (fixed value, published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lines, and pieces of lines, that a worker remembers; then it forgets all of them.
REMEMBERED = 200_000
#: The pattern's classes within Latin-1, for the standard library's faster matcher: letters, numbers, white space.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall

_TIMING = re.compile(r"(\d\d):(\d\d):(\d\d)([,.])(\d\d\d) --> (\d\d):(\d\d):(\d\d)([,.])(\d\d\d)", re.ASCII).fullmatch
_BLANK = " \t\r"


class Counter:
    """Counts tokens exactly as the tokenizer does on the whole text.

    The pattern never joins characters across a line break with text around it: a run of white space that holds a break is cut
    from the words before and after it. So the count of a text is the sum over its lines and white-space runs, if no line begins
    or ends with white space; the lines are memoised. Texts with such lines are counted by lines that exclude the blanks, and
    anything unusual is counted as a whole. A timing line is the sum over its numbers, each a piece of its own.
    """

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._lines: dict[str, int] = {}
        self._numbers = {f"{n:0{width}d}": self.whole(f"{n:0{width}d}") for width in (2, 3) for n in range(10**width)}
        self._spaced = {f"{n:02d}": self.whole(f" {n:02d}") for n in range(100)}
        self._marks = {c: self.whole(c) for c in ":,."}
        self._arrow = self.whole(" -->")
        self._gaps: dict[str, int] = {}
        self._pieces: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self._encode(text))

    def __call__(self, text: str) -> int:
        if "\r" in text:
            return self._with_blanks(text)
        known, total, empty = self._lines, 0, 0
        lines = text.split("\n")
        last = len(lines) - 1
        for at, line in enumerate(lines):
            if line:
                n = known.get(line)
                if n is None:
                    n = self._line(line)
                if n < 0:
                    return self._with_blanks(text)
                total += n + (1 if empty else 0) + (self._gap("\n" * (empty - 1)) if empty > 1 else 0)
                empty = 0
            if at < last:
                empty += 1
        return total + (self._gap("\n" * empty) if empty else 0)

    def _line(self, line: str) -> int:
        """Tokens of a line, -1 if white space is at its ends."""
        if line[0].isspace() or line[-1].isspace():
            n = -1
        elif parts := _TIMING(line):
            h1, m1, s1, c1, f1, h2, m2, s2, c2, f2 = parts.groups()
            two, marks = self._numbers, self._marks
            return two[h1] + two[m1] + two[s1] + marks[c1] + two[f1] + self._arrow + self._spaced[h2] + two[m2] + two[s2] + marks[c2] + two[f2] + 4 * marks[":"]
        elif max(line) <= "\xff":
            n = self._by_pieces(line)
        else:
            n = self.whole(line)
        known = self._lines
        if len(known) >= REMEMBERED:
            known.clear()
        if len(line) <= 200:
            known[line] = n
        return n

    def _by_pieces(self, line: str) -> int:
        known, total = self._pieces, 0
        for piece in _PIECES(line):
            n = known.get(piece)
            if n is None:
                n = self.whole(piece)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = n
            total += n
        return total

    def _gap(self, blanks: str) -> int:
        n = self._gaps.get(blanks)
        if n is None:
            n = self.whole(blanks)
            if len(blanks) <= 64:
                self._gaps[blanks] = n
        return n

    def _with_blanks(self, text: str) -> int:
        """Texts with blanks or carriage returns beside line breaks: a run of white space before text gives its last character away if that is no plain space."""
        total, gap = 0, ""
        for line in text.split("\n"):
            words = line.strip(_BLANK)
            if not words:
                gap += line + "\n"
                continue
            start = line.index(words[0])
            gap += line[:start]
            if words[0].isspace() or words[-1].isspace() or (gap and gap[-1] != "\n"):
                return self.whole(text)
            n = self._lines.get(words)
            if n is None:
                n = self._line(words)
            if n < 0:
                return self.whole(text)
            if gap:
                total += self._gap(gap[-1]) + (self._gap(gap[:-1]) if len(gap) > 1 else 0)
            total += n
            gap = line[start + len(words) :] + "\n"
        gap = gap[:-1]
        return total + (self._gap(gap) if gap else 0)


@lru_cache(maxsize=4)
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


def with_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """All columns but the text, and n_tokens BIGINT of the whole text; a NULL text has 0 tokens like an empty one."""
    others = [c for c in documents.columns if c != text]
    schema = documents.select(*others).schema.add("n_tokens", T.LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            sizes = [tokens(v) if (v := t.as_py()) else 0 for t in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(sizes, pa.int64())], names=[*others, "n_tokens"])

    return documents.select(*others, text).mapInArrow(count, schema)
