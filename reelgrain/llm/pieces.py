"""Oversized texts cut into pieces under a token limit, at natural boundaries, with an overlap.

The lengths of a text's tokens, summed, give each token's byte offset; the starts of sections, paragraphs, sentences and
words that coincide with a token's start make one sorted array of token numbers per kind. A piece from token s ends at
the last boundary of the best kind that binary search finds at or before s + limit, and the next piece begins `overlap`
tokens before that end. A boundary in the first half of a piece counts only where no kind has one in the second (words:
past twice the overlap), so that pieces are not short without need. Without a boundary the cut is hard, between
characters. A piece whose own encoding is longer than its share of the text's is cut again with a smaller limit, so that
every piece holds at most `limit` tokens. Its own encoding differs from the text's at its ends only: up to where the
pre-tokens from its start fall in with the text's, and from its last pre-token on; these alone are encoded again.

Defined results. Null and empty texts have one piece without tokens. Texts within the limit stay whole. The overlap is
up to three tokens longer where the token to begin with starts within a character. Repeated rows are each cut.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrain.llm.bpe import VOCABULARY, Encoder, encoder, read_vocabulary

LIMIT, OVERLAP = 1024, 64
#: Kinds of boundaries, best first.
KINDS = ("section", "paragraph", "sentence", "word")
ENDERS, CLOSERS, FULL_STOPS = ".!?…؟", "'\"”»)]", "。！？।"
OUT = "doc_id bigint, piece_no int, n_pieces int, doc_tokens bigint, first_token bigint, end_token bigint, piece_tokens int, cut string, text string"


@cache
def _spaces() -> np.ndarray:
    """Whether each code point is white space to the encoder's pattern."""
    import regex

    out = np.zeros(0x110000, bool)
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    out[[ord(x) for x in regex.findall(r"\s", "".join(map(chr, points)))]] = True
    return out


def _is_in(points: np.ndarray, letters: str) -> np.ndarray:
    return np.isin(points, [ord(x) for x in letters])


def boundaries(points: np.ndarray, kind: str) -> np.ndarray:
    """Places between code points, in order, where a piece of a kind begins: a heading or after a rule of dashes, after an empty line, after a sentence or line, at a change between white space and other characters."""
    n = len(points)
    if kind == "word":
        space = _spaces()[points]
        return np.flatnonzero(space[1:] != space[:-1]) + 1
    line = np.flatnonzero(points[:-1] == 10) + 1  # what follows a line feed
    if kind == "sentence":
        end, close = _is_in(points, ENDERS), _is_in(points, CLOSERS)
        ended = end.copy()
        ended[1:] |= close[1:] & end[:-1]
        after = np.flatnonzero(ended[:-1] & _spaces()[points[1:]]) + 1
        return np.unique(np.concatenate([after, np.flatnonzero(_is_in(points[:-1], FULL_STOPS)) + 1, line]))
    if kind == "paragraph":
        at = lambda k: points[np.maximum(line - k, 0)]
        plain = (line >= 2) & (at(2) == 10) & (points[line] != 10)
        windows = (line >= 4) & (at(2) == 13) & (at(3) == 10) & (at(4) == 13) & (points[line] != 10) & (points[line] != 13)
        return line[plain | windows]
    out = []
    for place in line[_is_in(points[line], "#-=*")].tolist():
        mark, end = points[place], place
        while end < n and points[end] == mark:
            end += 1
        if (mark == 35 and end - place <= 6 and end < n and points[end] == 32) or (mark != 35 and end - place >= 3 and end < n and points[end] == 10):
            out.append(place)
    return np.array(out, np.int64)


class Layout:
    """A text's tokens with the places where it may be cut."""

    def __init__(self, own: Encoder, text: str):
        self.own, self.text = own, text
        ids, self.starts, self.firsts = own.encode_parts(text)
        self.n = len(ids)
        if not self.n:
            return
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (self.points > 0x7F).astype(np.int64) + (self.points > 0x7FF) + (self.points > 0xFFFF)
        byte_at = np.concatenate([[0], np.cumsum(width)])  # of each character
        offset = np.concatenate([[0], np.cumsum(np.frombuffer(own.lengths, np.int32)[np.frombuffer(ids, np.int32)])])  # of each token
        # the character where each token begins, -1 within one
        place = np.searchsorted(byte_at, offset)
        self.char = np.where(byte_at[place] == offset, place, -1)
        self.kinds: dict[str, np.ndarray] = {}  # each is found when a better kind has no place

    def at(self, kind: str) -> np.ndarray:
        """Token numbers where a boundary of a kind lies at a token's start, in order."""
        if kind not in self.kinds:
            places = boundaries(self.points, kind)
            sound = np.flatnonzero(self.char >= 0)
            k = np.searchsorted(self.char[sound], places)
            k = np.minimum(k, len(sound) - 1)
            self.kinds[kind] = sound[k[self.char[sound[k]] == places]]
        return self.kinds[kind]

    def size(self, s: int, e: int) -> int:
        """Tokens of the encoding of the text from token s to token e."""
        first, end = int(self.char[s]), int(self.char[e])
        if end == len(self.text) and (k := bisect_left(self.starts, first)) < len(self.starts) and self.starts[k] == first:
            return self.n - s
        run = end  # white space before the end is parted anew as a whole
        while run > first and self.text[run - 1].isspace():
            run -= 1
        last = bisect_right(self.starts, min(run, end - 1)) - 1  # the pre-token that reaches the end, or the first of the white space there
        place, head = first, 0
        k = bisect_left(self.starts, place)
        if self.starts[k] != place:  # begin within a pre-token: go on until the pre-tokens fall in with the text's
            if self.starts[last] <= place:
                return len(self.own.encode(self.text[place:end]))
            for m in self.own.pieces_between(self.text, place, end):
                head += len(self.own.encode(m.group()))
                place = m.end()
                k = bisect_left(self.starts, place)
                if self.starts[k] == place or place >= self.starts[last]:
                    break
        if k > last or self.starts[k] != place:
            return head + len(self.own.encode(self.text[place:end]))
        return head + self.firsts[last] - self.firsts[k] + len(self.own.encode(self.text[self.starts[last] : end]))


def cut(own: Encoder, text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str, str]]:
    """(first token, end token, tokens of the piece itself, kind of the cut at its end, its text) of each piece."""
    if not text or len(text) <= limit and len(text.encode("utf-8", "surrogatepass")) <= limit:  # a token has a byte at least
        n = len(own.encode(text))
        return [(0, n, n, "end", text or "")]
    layout = Layout(own, text)
    n, char = layout.n, layout.char
    if n <= limit:
        return [(0, n, n, "end", text)]
    out, s = [], 0
    while True:
        room = limit
        while True:
            most = s + room
            if most >= n:
                e, kind = n, "end"
            else:
                e, kind = _end(layout, s, most, room, overlap)
            size = layout.size(s, e)
            if size <= limit:
                break
            room -= size - limit
        out.append((s, e, size, kind, text[char[s] : char[e]]))
        if e >= n:
            return out
        s = e - overlap
        while char[s] < 0:
            s -= 1


def _end(layout: Layout, s: int, most: int, room: int, overlap: int) -> tuple[int, str]:
    """The last boundary of the best kind in the second half of the room, else past twice the overlap, else the last whole character."""
    for half in (True, False):
        for kind in KINDS:
            if half or kind != "word":
                at = layout.at(kind)
                k = int(np.searchsorted(at, most, "right")) - 1
                if k >= 0 and at[k] > s + (room // 2 if half and kind != "word" else 2 * overlap):
                    return int(at[k]), kind
    e = most
    while layout.char[e] < 0:
        e -= 1
    return e, "hard"


def pieces(documents: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """A row per piece of each document."""
    if not 0 <= 4 * overlap < limit:
        raise ValueError("the overlap must be under a quarter of the limit")
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                columns: list[list] = [[] for _ in range(9)]
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found = cut(own, text.as_py(), limit, overlap)
                    for k, (s, e, size, kind, piece) in enumerate(found):
                        for c, v in zip(columns, (doc, k, len(found), found[-1][1], s, e, size, kind, piece if with_text else None)):
                            c.append(v)
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in OUT.split(", ")])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, OUT)


def oversized(documents: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id of the documents that are cut."""
    return pieces(documents, vocabulary, limit, with_text=False).filter((F.col("piece_no") == 0) & (F.col("doc_tokens") > limit)).select("doc_id").distinct()
