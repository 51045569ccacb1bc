"""Splitting oversized documents at the deepest valleys of lexical cohesion.

Two blocks of words slide over a document.  Where the blocks before and after a gap share few
words, the topic changes.  A piece ends at the deepest such valley among the best boundaries
(article, else paragraph, else line, else word) of its size window.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in each of the two sliding blocks.
BLOCK_WORDS = 40
ARTICLE, PARAGRAPH, LINE, WORD = 3, 2, 1, 0
#: Odd factors and values of a polynomial hash of a word.
_HASH = np.random.default_rng(20240301).integers(1, 2**62, 256, dtype=np.int64)
_PLACE = np.random.default_rng(20240302).integers(1, 2**62, 64, dtype=np.int64) | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes (of the lower-case letters) of the words of UTF-8 bytes."""
    solid = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [len(raw)]))))
    h = _HASH[_LOWER[raw]] * _PLACE[place % 64]
    h[~solid] = 0
    return start, end, np.add.reduceat(h, start)


def cohesion(ids: np.ndarray, width: int) -> np.ndarray:
    """Cosine similarity of the ``width`` words before and after each gap g = 0 .. len(ids).

    Equal ids are equal words; a negative id equals nothing.  Each pair of equal words at most
    two blocks apart adds one to a range of gaps, so the sums are differences run up.
    """
    n = len(ids)
    across, within = np.zeros(n + width + 2), np.zeros(n + width + 2)
    for d in range(1, min(2 * width, n)):
        i = np.flatnonzero((ids[d:] == ids[:-d]) & (ids[d:] >= 0))
        if not len(i):
            continue
        np.add.at(across, np.maximum(i + 1, i + d - width + 1), 1)
        np.add.at(across, np.minimum(i + d, i + width) + 1, -1)
        if d < width:
            np.add.at(within, i + d + 1, 1)
            np.add.at(within, i + width + 1, -1)
    dot, inside = np.cumsum(across), np.cumsum(within)
    gaps = np.arange(n + 1)
    known = np.concatenate(([0], np.cumsum(ids >= 0)))
    left = known[gaps] - known[np.maximum(gaps - width, 0)] + 2 * inside[gaps]
    ahead = np.minimum(gaps + width, n)
    # Pairs of the block after a gap: those wholly inside (g, g + width].
    right_pairs = inside[np.minimum(gaps + width, n + width)]
    right = known[ahead] - known[gaps] + 2 * right_pairs
    return dot[gaps] / np.sqrt(np.maximum(left, 1) * np.maximum(right, 1))


def valley_depth(similarity: np.ndarray, reach: int) -> np.ndarray:
    """How far each gap lies below the highest similarity within ``reach`` gaps on either side."""
    s = pd.Series(similarity)
    before = s.rolling(reach, min_periods=1).max().to_numpy()
    after = s[::-1].rolling(reach, min_periods=1).max().to_numpy()[::-1]
    return before + after - 2 * similarity


def boundaries(raw: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which a piece may end, and their classes.

    A word ends before white space, a line after its line feed, a paragraph after an empty
    line.  An article ends where a paragraph does, with the end of a sentence, and a headline
    (letters mostly capitals) follows; an advert amid a sentence is no article.
    """
    space = _SPACE[raw]
    at_word = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    feeds = np.flatnonzero(raw == 10)
    at_line = feeds + 1
    kind = np.full(len(at_line), LINE)
    if len(at_line):
        blank = np.diff(np.concatenate(([-1], feeds))) == 1
        kind[blank] = PARAGRAPH
        for k in np.flatnonzero(blank):
            stop = feeds[k + 1] if k + 1 < len(feeds) else len(data)
            line = data[feeds[k] + 1 : stop].decode("utf-8", "replace")
            letters = [c for c in line if c.isalpha()]
            ended = data[max(0, feeds[k] - 8) : feeds[k]].rstrip()[-1:] in (b".", b"!", b"?")
            if ended and len(letters) > 3 and sum(c.isupper() for c in letters) >= 0.8 * len(letters):
                kind[k] = ARTICLE
    pos = np.concatenate((at_word, at_line))
    kinds = np.concatenate((np.full(len(at_word), WORD), kind))
    order = np.lexsort((kinds, pos))
    return pos[order], kinds[order]


def char_start(raw: np.ndarray, pos: int) -> int:
    """The start of the UTF-8 character that holds the byte at ``pos``."""
    while 0 < pos < len(raw) and raw[pos] & 0xC0 == 0x80:
        pos -= 1
    return pos


def split_text(text: str, limit: int, overlap: int, token_ends: Callable[[str], np.ndarray] | None = None) -> list[tuple[int, int, int, int]]:
    """Pieces of a text as (first byte, end byte, first token, end token).

    ``token_ends`` gives the byte position after each token; without it each byte is a token.
    A piece has at most ``limit`` tokens.  The next one starts ``overlap`` tokens before its
    end, or up to three bytes earlier where that lies inside a character.  A text that isn't
    over the limit is one piece; an empty one has none.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    ends = token_ends(text) if token_ends else np.arange(1, len(raw) + 1)
    starts = np.concatenate(([0], ends))[:-1]
    if not len(raw):
        return []
    if len(ends) <= limit:
        return [(0, len(raw), 0, len(ends))]
    w_start, w_end, hashes = words_of(raw)
    long_word = (w_end - w_start) > 3
    ids = np.where(long_word, hashes & (2**62 - 1), -1)
    depth = valley_depth(cohesion(ids, BLOCK_WORDS), 2 * BLOCK_WORDS)
    pos, kinds = boundaries(raw, data)
    out, first = [], 0
    while True:
        if len(ends) - first <= limit:
            out.append((int(starts[first]), len(raw), first, len(ends)))
            return out
        top = int(ends[first + limit - 1])
        low = int(ends[first + overlap + (limit - overlap) // 2])
        a, b = np.searchsorted(pos, low), np.searchsorted(pos, top, "right")
        if a == b:  # nothing in the size window: the last boundary before it, if it brings the text on
            least = int(ends[first + overlap + 3]) if first + overlap + 3 < len(ends) else top
            a0 = np.searchsorted(pos, least, "right")
            a, b = (b - 1, b) if a0 < b else (b, b)
        if a < b:
            best = kinds[a:b].max()
            own = np.flatnonzero(kinds[a:b] == best) + a
            deep = depth[np.searchsorted(w_start, pos[own])]
            cut = int(pos[own[len(own) - 1 - int(np.argmax(deep[::-1]))]])
        else:
            cut = char_start(raw, top)
            if cut <= starts[first]:
                cut = top
        stop = int(np.searchsorted(ends, cut, "right"))  # whole tokens up to the cut
        stop = max(stop, first + overlap + 1)
        cut = int(ends[stop - 1])
        out.append((int(starts[first]), cut, first, stop))
        back = char_start(raw, int(starts[stop - overlap]) if overlap else cut)
        nxt = int(np.searchsorted(starts, back, "right")) - 1 if overlap else stop
        first = max(nxt, first + 1)


def rank_file_tokens(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Token ends by a public byte-level vocabulary in the form of ranks, and the pattern that splits texts for it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.cumsum([len(x) for x in coder.decode_tokens_bytes(coder.encode_ordinary(text))], dtype=np.int64)


def split_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 6000, overlap: int = 200, rank_file: str | None = None, pattern: str | None = None
) -> DataFrame:
    """The pieces of every document of more than ``limit`` tokens.

    Columns: ``doc`` (the id), ``piece`` (from 0), ``n_pieces``, ``start_token``, ``end_token`` and ``text``.
    A token is a byte of the UTF-8 text, or a token of the vocabulary in ``rank_file``, which
    belongs to the ``pattern`` that comes with it.  Such a
    token has at least one byte, so shorter texts never leave the JVM.

    Documents that aren't over the limit, empty ones and NULL texts give no rows.  A NULL id is
    kept.  Repeated rows are split each for itself.  A text without any boundary is cut at the
    limit, between characters.  An empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].cast("string").alias("text")).where(F.octet_length("text") > limit)
    kind = rows.schema["doc"].dataType.simpleString()

    if rank_file and not pattern:
        raise ValueError("a vocabulary needs its pattern")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = rank_file_tokens(rank_file, pattern) if rank_file else None
        for b in batches:
            out, of = [], []
            for at, text in enumerate(b.column("text").to_pylist()):
                pieces = split_text(text, limit, overlap, ends)
                if len(pieces) > 1:
                    data = text.encode("utf-8", "surrogatepass")
                    of += [at] * len(pieces)
                    out += [(k, len(pieces), s, e, data[a:b_].decode("utf-8", "replace")) for k, (a, b_, s, e) in enumerate(pieces)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(pa.array(of, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                ["doc", "piece", "n_pieces", "start_token", "end_token", "text"],
            )

    return rows.mapInArrow(cut, f"doc {kind}, piece int, n_pieces int, start_token bigint, end_token bigint, text string")
