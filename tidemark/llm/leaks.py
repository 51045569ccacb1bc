"""Test items that stand, whole or in part, in training documents.

Both sides are brought to templates.  Words are folded (case, accents, hyphens at line ends and
common misreadings); words that most items share are dropped; numbers, names and units become typed
placeholders.  What is left are template words and placeholders.  Three of these in a row, two of them
template words at least, are a window, and its key tells the words and the types, not what fills the slots.
Windows of documents and items are joined by hash.  A damaged word still finds its template word over
one lost, added or changed letter; one that doesn't looks like a name, and items have windows with a
placeholder in place of each word, and without it, to be found by.

Joined windows are compared slot by slot.  A document and an item whose slots agree in two windows near
each other, or that share more windows with other numbers and names in the slots, are a candidate.  Where columns mix, lines
hold too few words in a row; there three windows of just two words, names being told by themselves, do as well.

For candidates the letters of document and item, slots filled in again, are aligned by short runs of
equal letters on neighbouring diagonals, and the longest stretch of the item's words that is printed is
taken.  A stretch in which most slots differ is that of a re-parameterised item: it ends at them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import Unsupported

#: Kinds of words that aren't template words, whose numbers start at 0.
NUMBER, NAME, UNIT, COMMON = -1, -2, -3, -4
#: Shortest unknown word that counts as a name; shorter ones are taken for debris.
NAME_LETTERS = 4

_HYPHEN = re.compile(r"[-=¬\u00ad‐‑][-=¬\u00ad‐‑ \t]*\r?\n[ \t]*")
_JOINT = re.compile(r"[ \t]+\x00")
_WORD = re.compile(r"[a-z0-9]+")
#: Letters that don't decompose into a plain one and an accent.
_PLAIN = (("ſ", "s"), ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ı", "i"))
#: Letters that are read for each other, brought to one form.
_CONFUSED = (("vv", "w"), ("rn", "m"), ("cl", "d"), ("li", "h"), ("ii", "n"), ("0", "o"), ("1", "l"))


def folded(text: str) -> str:
    """Lower case without accents; words broken by a hyphen at a line end are joined."""
    text = _HYPHEN.sub("\x00", text.replace("\x00", " ")).lower()
    if "\x00" in text:
        text = _JOINT.sub("", text).replace("\x00", "")
    if not text.isascii():
        for a, b in _PLAIN:
            if a in text:
                text = text.replace(a, b)
        text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return text


def one_form(word: str) -> str:
    for a, b in _CONFUSED:
        if a in word:
            word = word.replace(a, b)
    return word


def shortened(word: str) -> list[str]:
    """The word with one letter left out, in every way."""
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


class Vocabulary(dict):
    """Number of the template word or known name that any word stands for, or its kind.

    Template words have the numbers below ``templates``, names of items those from there on.  A word that isn't known is compared with the known ones by what is left of either when
    one letter is taken out, so one lost, added or changed letter does no harm.
    """

    #: Words remembered at most; further ones are looked up each time.
    REMEMBERED = 400_000

    def __init__(self, known: dict[str, int], templates: int):
        super().__init__(known)
        self.templates, self.base = templates, 8 + max(known.values(), default=0)
        self.forms: dict[str, int] = {}
        for w, n in known.items():
            self.forms.setdefault(one_form(w), n)
        self.near: dict[str, int] = {}
        for w, n in known.items():
            if len(w) >= 5:
                for s in shortened(one_form(w)):
                    self.near.setdefault(s, n)

    def __missing__(self, word: str) -> int:
        n = self._find(word)
        if len(self) < self.REMEMBERED:
            self[word] = n
        return n

    def _find(self, word: str) -> int:
        digits = sum(c.isdigit() for c in word)
        if digits * 2 >= len(word):
            return NUMBER
        form = one_form(word)
        if form in self.forms:
            return self.forms[form]
        if len(word) >= 5:
            if form in self.near:
                return self.near[form]
            for s in shortened(form):
                if s in self.forms:
                    return self.forms[s]
                if s in self.near:
                    return self.near[s]
        return NAME if len(word) >= NAME_LETTERS else COMMON

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of windows of three numbers or kinds: which count, their keys, which of the three are slots, and which windows are filled.

        With two template words a window has placeholders for all else.  With fewer it counts if known names make up for
        them: then the names stay in the key, the window is filled, and its slots agree where the key does.
        """
        typed = np.where(ids >= self.templates, NAME, ids)
        template = (typed >= 0).sum(axis=1)
        filled = (template < 2) & ((ids >= 0).sum(axis=1) >= 2)
        key = self.key(*np.where(filled[:, None], ids, typed).T)
        return (template >= 2) | filled, key, (typed == NAME) | (typed == NUMBER), filled

    def key(self, a: np.ndarray, b: np.ndarray, c: np.ndarray | int = COMMON) -> np.ndarray:
        """One number for three numbers or kinds, or for two: common words are in no window."""
        m = np.int64(self.base)
        with np.errstate(over="ignore"):
            return ((np.int64(4) + a) * m + b + 4) * m + c + 4


_CODE = np.full(256, 255, np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
    _CODE[ord(_c)] = _i


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters and digits of words, confused ones in one form, and the word of each."""
    code = _CODE[np.frombuffer(one_form(" ".join(words)).encode(), np.uint8)]
    letter = code != 255
    return code[letter], np.cumsum(~letter)[letter]


Q = 6


def runs(code: np.ndarray, length: int = Q) -> np.ndarray:
    """A number for the ``length`` letters that begin at each place: exact up to twelve, a hash beyond."""
    if len(code) < length:
        return np.zeros(0, np.int64)
    if length == 1:
        return code.astype(np.int64)
    # From runs of half the length: those that begin the run and those that end it.
    half = length // 2
    first = runs(code, half)
    rest = first if 2 * half == length else runs(code, length - half)
    return first[: len(code) - length + 1] + rest[half:] * np.array(37, np.int64) ** half


class Page:
    """The letters of a document and their runs."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.grams = runs(self.code)


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Letters to change, take out or put in to turn one short run of letters into the other."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    y = b.tolist()
    row = list(range(len(y) + 1))
    for k, x in enumerate(a.tolist(), 1):
        last, row[0] = row[0], k
        for j, z in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != z))
    return row[-1]


@dataclass(frozen=True)
class Rules:
    """Parameters of the search."""

    words: int = 20  #: consecutive words of an item that make a leak
    drift: int = 400  #: words by which windows may shift against each other and count together:
    agreeing: int = 2  #: how many whose slots agree make a candidate,
    sharing: int = 4  #: or how many whatever their slots,
    pairs: int = 3  #: or how many of just two words, for lines too short for more
    slot: float = 0.34  #: share of a slot's letters that damage may change
    reach_of_window: int = 16  #: words of a document that a window may span
    joined: int = 12  #: letters that damage may take at a time within a stretch
    damage: float = 0.5  #: share of these letters, one more allowed, that may differ,
    swapped: float = 0.34  #: or if they hold a whole word, which may be another one
    single: int = 20  #: letters of words that stand alone in what a break skips
    lost: int = 1  #: letters lost where a passage breaks off and goes on,
    twice: int = 8  #: or by chance equal to what stands in between
    beside: int = 30  #: letters of foreign text that a stretch may skip,
    least: int = 7  #: if it has so many letters;
    reach: int = 250  #: a break this wide
    near: int = 14  #: takes so many,
    alone: int = 20  #: and a wider one, or another order, takes so many
    common: float = 0.33  #: share of the items of a language from which on a word is no template word
    slots: int = 3  #: slots that differ in a re-parameterised item at least,
    other: float = 0.66  #: and their share of all slots


class Item:
    """A test item, prepared for alignment: its letters, the word of each, their runs, and which words are slots."""

    def __init__(self, text: str, vocabulary: Vocabulary, rules: Rules):
        words = _WORD.findall(folded(text))
        self.rules = rules
        self.code, self.word = letters(words)
        ids = np.array([vocabulary[w] for w in words], np.int64)
        self.slot = (ids == NAME) | (ids == NUMBER) | (ids >= vocabulary.templates)
        grams = runs(self.code)
        self.order = np.argsort(grams, kind="stable")
        self.grams = grams[self.order]

    def alike(self, a: int, b: int, other: np.ndarray) -> bool:
        """Whether letters ``a`` to ``b`` of the item may be ``other``, damaged.  A whole word must be nearly right."""
        r = self.rules
        word = self.word
        off = distance(self.code[a:b], other)
        if off <= 1:
            return True
        # Words that begin and end between a and b.
        first = word[a] + (a > 0 and word[a - 1] == word[a]) if a < b else 0
        last = word[b - 1] - (b < len(word) and word[b] == word[b - 1]) if a < b else -1
        if a == b or first > last:
            return off <= max(2, 1 + r.damage * (b - a))
        return off <= 0.5 + r.swapped * (b - a)

    def printed(self, page: Page) -> tuple[int, int, int]:
        """The most consecutive words of the item that stand among the letters of a document, its slots
        there and how many of these differ."""
        r, code, grams = self.rules, page.code, page.grams
        own, order = self.grams, self.order
        lo, hi = np.searchsorted(own, grams), np.searchsorted(own, grams, "right")
        n = hi - lo
        if not n.any():
            return 0, 0, 0
        d = np.repeat(np.arange(len(grams)), n)
        i = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        by = np.lexsort((i, d - i))
        i, d = i[by], d[by]
        start = np.flatnonzero(np.concatenate(([True], (np.diff(d - i) != 0) | (np.diff(i) > 1))))
        stop = np.concatenate((start[1:], [len(i)])) - 1
        equal = sorted(zip(i[start].tolist(), (i[stop] + Q).tolist(), d[start].tolist(), (d[stop] + Q).tolist(), strict=True))

        # Stretches: equal letters, carried on over short gaps in which the letters are much alike.
        mine = self.code
        every: list[list] = []
        live: dict[int, list[list]] = {}  # by where they end in the document
        for i0, i1, d0, d1 in equal:
            best, least = None, 0
            for key in ((d0 >> 5) - 1, d0 >> 5, (d0 >> 5) + 1):
                here = live.get(key)
                if not here:
                    continue
                here[:] = [c for c in here if c[3] >> 5 == key and i0 - c[1] <= r.joined]
                for c in here:
                    if i1 <= c[1] or d1 <= c[3]:
                        continue
                    back = max(0, c[1] - i0, c[3] - d0)
                    gi, gd = i0 + back - c[1], d0 + back - c[3]
                    if back >= i1 - i0 or gi > r.joined or gd > r.joined + 4 or (best is not None and gi + gd >= least):
                        continue
                    if (gi or gd) and not self.alike(c[1], c[1] + gi, code[c[3] : c[3] + gd]):
                        continue
                    best, least = c, gi + gd
            if best is None:
                best = [i0, i1, d0, d1, 0, []]
                every.append(best)
            elif i0 > best[1] or d0 - best[3] != i0 - best[1]:
                best[5].append((min(i0, best[1]), max(i0, best[1])))
            best[4] += i1 - max(i0, best[1] if best[4] else i0)
            best[1], best[3] = i1, d1
            live.setdefault(d1 >> 5, []).append(best)
        parts = sorted(c for c in every if c[4] >= r.least)

        # The passage goes on in another stretch where the last one ended: past an advert, a line of
        # the next column, or in another column.  The farther away, the longer it must be.
        begin, before, length = [c[0] for c in parts], [-1] * len(parts), [c[4] for c in parts]
        ends: dict[int, list[int]] = {}
        own_text, page_text = mine.tobytes(), code.tobytes()
        for b, c in enumerate(parts):
            for e in range(c[0] - (r.single if c[4] >= r.near else r.lost), c[0] + r.twice + 1):
                for a in ends.get(e, ()):
                    p = parts[a]
                    if begin[a] >= begin[b]:
                        continue
                    away = abs(c[2] - p[3])
                    need = r.least if away <= r.beside else r.near if away <= r.reach else r.alone
                    if c[0] - e > r.lost:
                        # A word or two may stand by themselves among the lines of the other column.
                        need = r.near
                        if not (p[3] < c[2] and away <= r.reach) or page_text.find(own_text[e : c[0]], p[3], c[2]) < 0:
                            continue
                    if min(c[4], length[a]) >= need:  # what has gone on from stretch to stretch counts together
                        begin[b], before[b], length[b] = begin[a], a, length[a] + c[4]
            ends.setdefault(c[1], []).append(b)
        word = self.word
        whole = np.bincount(word, minlength=len(self.slot))
        best = (0, 0, 0)
        for k, c in enumerate(parts):
            if word[c[1] - 1] - word[begin[k]] + 1 > best[0]:
                inside = np.bincount(word[begin[k] : c[1]], minlength=len(whole)) * 2 >= np.maximum(whole, 1)
                if inside.sum() <= best[0]:
                    continue
                changed = np.zeros(len(whole), bool)
                at = k
                while at >= 0:
                    for a, b in parts[at][5]:
                        changed[word[a : max(b, a + 1)]] = True
                    at = before[at]
                slots = inside & self.slot
                other = slots & changed
                n, n_slots, n_other = int(inside.sum()), int(slots.sum()), int(other.sum())
                if n_other >= r.slots and n_other >= r.other * n_slots:
                    # Another item of the same template: what is printed ends at its slots.
                    n = int(np.bincount(np.cumsum(other)[inside & ~other]).max(initial=0))
                best = max(best, (n, n_slots, n_other))
        return best


OCCURRENCE = pa.schema([("word", pa.string()), ("lang", pa.string()), ("n", pa.int64()), ("capital", pa.bool_()), ("small", pa.bool_()), ("after", pa.int64())])
ITEM_WINDOW = pa.schema([("i1", pa.int64()), ("i2", pa.int64()), ("item_key", pa.int64()), ("item_place", pa.int32()), ("item_slots", pa.string()), ("sort", pa.int32())])


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def occurrences(items: DataFrame) -> DataFrame:
    """``word``, ``lang`` and how an item (``text``, ``lang``) has it: how often, as a name, in small letters, after a number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                words = _WORD.findall(folded(text))
                capital = set(_WORD.findall(folded(" ".join(re.findall(r"(?<=[a-z,;] )[A-Z]\w+", text)))))
                small = set(_WORD.findall(folded(" ".join(re.findall(r"\b[a-zß-ÿ]\w*", text)))))
                after = Counter(b for a, b in zip(words, words[1:], strict=False) if a.isdigit())
                out += [(w, lang, n, w in capital, w in small, after[w]) for w, n in Counter(words).items()]
            yield batch(out, OCCURRENCE)

    return items.select("text", "lang").mapInArrow(count, "word string, lang string, n bigint, capital boolean, small boolean, after bigint")


#: Different words of all items that are sent to the tasks; more raise an error.
MOST_WORDS = 2_000_000


def vocabulary_of(items: DataFrame, rules: Rules) -> Vocabulary:
    """The words of all items (``text``, ``lang``) by kind.

    A unit is a word that stands after numbers at least every second time, in three items or more.  A name is
    written with a capital within sentences, never small, and belongs to few items.  A common word stands in many of
    the items of its language, or again and again in one.  All are counted over all items.
    """
    sizes = items.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_items"))
    by_lang = occurrences(items).groupBy("word", "lang").agg(
        F.count("*").alias("seen"),
        F.sum("n").alias("n"),
        F.count_if("capital").alias("named"),
        F.count_if("small").alias("plain"),
        F.sum("after").alias("after"),
        F.count_if(F.col("after") > 0).alias("after_in"),
    )
    many = F.col("seen") > F.greatest(F.lit(3.0), rules.common * F.col("_items"))
    sums = by_lang.join(sizes, F.col("lang").eqNullSafe(F.col("_lang"))).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("seen", "n", "named", "plain", "after", "after_in")], F.max(many).alias("many"))
    kind = (
        F.when((F.col("after_in") >= 3) & (2 * F.col("after") >= F.col("n")), UNIT)
        .when((F.col("named") > 0) & (F.col("plain") == 0) & (F.col("seen") <= 3), NAME)
        .when(F.col("many") | ((F.col("seen") > 3) & (F.col("n") >= 1.4 * F.col("seen"))) | (F.length("word") < 3), COMMON)
        .otherwise(0)
    )
    words = sums.where(~F.col("word").rlike("^[0-9]+$")).select("word", kind.alias("kind")).limit(MOST_WORDS + 1).toPandas()
    if len(words) > MOST_WORDS:
        raise Unsupported(f"items of more than {MOST_WORDS} different words; search for them in parts")
    words = words.sort_values("word")
    template, name = (words["kind"] == 0).to_numpy(), (words["kind"] == NAME).to_numpy()
    number = np.where(template, np.cumsum(template) - 1, np.where(name, template.sum() + np.cumsum(name) - 1, words["kind"]))
    return Vocabulary(dict(zip(words["word"], number.tolist(), strict=True)), int(template.sum()))


#: Sorts of windows: with placeholders, with the names themselves, and just two words.
TYPED, FILLED, PAIR = 0, 1, 2


def item_windows(words: list[str], vocabulary: Vocabulary) -> list[tuple[int, int, str, int]]:
    """(key, place, slots, sort) of an item's windows, also as they look with a word damaged, lost or put in."""
    left = [(p, x) for p, w in enumerate(words) if (x := vocabulary[w]) != COMMON]
    other = (-1, NAME)
    windows: list[tuple[int, list[tuple[int, int]]]] = []
    for i, (place, _) in enumerate(left):
        three, four = left[i : i + 3], left[i : i + 4]
        if len(three) == 3:
            windows.append((place, three))
            windows += [(place, [(p, NAME if k == j else x) for k, (p, x) in enumerate(three)]) for j in range(3)]
        if len(four) == 4:
            windows += [(place, [four[0], *four[2:]]), (place, [*four[:2], four[3]])]
        if len(three) >= 2:
            a, b = three[:2]
            windows += [(place, [a, other, b]), (place, [other, a, b]), (place, [a, b, other])]
    if not windows:
        return []
    good, key, slot, filled = vocabulary.windows(np.array([[x for _, x in w] for _, w in windows], np.int64))
    out: dict[tuple[int, int], tuple[str, int]] = {}
    for k in np.flatnonzero(good).tolist():
        place, window = windows[k]
        slots = "".join(one_form(words[p]) for (p, _), is_slot in zip(window, slot[k], strict=True) if is_slot and p >= 0)
        out.setdefault((int(key[k]), place), (slots, FILLED if filled[k] else TYPED))
    for (place, a), (_, b) in zip(left, left[1:], strict=False):
        if a >= 0 and b >= 0:
            out.setdefault((int(vocabulary.key(np.int64(a), np.int64(b))), place), ("", PAIR))
    return [(key, place, *rest) for (key, place), rest in out.items()]


def document_windows(words: list[list[str]], vocabulary: Vocabulary, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Document, place and key of each window, then the words of all documents and the places of a window's slots in these."""
    sizes = np.array([len(x) for x in words], np.int64)
    every = [w for x in words for w in x]
    number = np.fromiter((vocabulary[w] for w in every), np.int64, len(every))
    doc, first = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
    left = np.flatnonzero(number != COMMON)
    at = np.stack((left[:-2], left[1:-1], left[2:]), axis=1)
    at = at[(doc[at[:, 0]] == doc[at[:, 2]]) & (at[:, 2] - at[:, 0] <= reach)]
    good, key, slot, _ = vocabulary.windows(number[at])
    two = np.stack((left[:-1], left[1:]), axis=1)
    two = two[(doc[two[:, 0]] == doc[two[:, 1]]) & (two[:, 1] - two[:, 0] <= reach // 2) & (number[two] >= 0).all(axis=1)]
    at, begin = at[good], np.concatenate((at[good, 0], two[:, 0]))
    slots = np.concatenate((np.where(slot[good], at, -1), np.full((len(two), 3), -1)))
    d = doc[begin]
    return d, begin - first[d], np.concatenate((key[good], vocabulary.key(*number[two].T))), every, slots


#: Bytes up to which the windows of the items are sent to all tasks; more are joined by shuffling both sides.
BROADCAST_BYTES = 32 << 20
#: Bits of a filter that leaves out windows which no item has, before they are joined.
FILTER_BITS = 22


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_col: str = "doc_id",
    doc_text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    item_lang: str | None = None,
    rules: Rules | None = None,
) -> DataFrame:
    """``doc``, ``item``, ``words``, ``leaked``, ``n_slots`` and ``n_other`` of each document and item that share template windows.

    ``words`` is the longest stretch of the item's words that the document prints; ``leaked`` says
    whether it reaches ``rules.words``.  ``n_slots`` are the numbers and names in this stretch, and ``n_other`` those that the
    document prints differently: by damage, or, if it is most of them, as another item of the same template,
    whose stretch ends at them.  Items that share a passage count each.

    The items are the stated query set.  Their vocabulary, bounded by ``MOST_WORDS``, is collected when this is
    called and sent to the tasks with a filter of ``2**FILTER_BITS`` bits; all else is joined by Spark, so the rows are a
    function of the tables.  Documents are joined by a 128-bit hash of their text; copies are spread.

    NULL and empty texts on either side give no rows; NULL ids are kept.  Repeated documents each
    give their rows, repeated items too.  Empty tables give no rows.  Other columns are not read.
    """
    rules = rules or Rules()
    spark = docs.sparkSession
    hashes = lambda c, a, b: [F.xxhash64(c, F.lit(3)).alias(a), F.xxhash64(F.lit(5), c).alias(b)]
    rows = docs.select(docs[doc_col].alias("doc"), docs[doc_text].cast("string").alias("text")).where("length(text) > 0").select("doc", "text", *hashes("text", "d1", "d2"))
    lang: Column = items[item_lang] if item_lang else F.lit(None)
    tests = items.select(items[item_col].alias("item"), items[item_text].cast("string").alias("text"), lang.cast("string").alias("lang")).where("length(text) > 0").select("item", "text", "lang", *hashes("text", "i1", "i2"))
    vocabulary = vocabulary_of(tests, rules)
    known = spark.sparkContext.broadcast(vocabulary)

    # --- windows of the items, and a filter of their keys

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = zip(*[b.column(c).to_pylist() for c in ("i1", "i2", "text")], strict=True)
            yield batch([(i1, i2, *w) for i1, i2, text in each for w in item_windows(_WORD.findall(folded(text)), known.value)], ITEM_WINDOW)

    texts = tests.select("i1", "i2", "text").dropDuplicates(["i1", "i2"])
    of_items = texts.mapInArrow(cut_items, "i1 bigint, i2 bigint, item_key bigint, item_place int, item_slots string, sort int")
    size = 1 << FILTER_BITS
    present = np.zeros(size, bool)
    counted = of_items.groupBy(F.pmod("item_key", F.lit(size)).cast("int").alias("bit")).count().toPandas()
    present[counted["bit"].to_numpy(int)] = True
    passes = spark.sparkContext.broadcast(np.packbits(present))

    # --- windows of the documents, joined by key, slots compared

    def cut_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(passes.value).astype(bool)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                words = [_WORD.findall(folded(x)) for x in part.column("text").to_pylist()]
                doc, place, key, every, slots = document_windows(words, known.value, rules.reach_of_window)
                keep = np.flatnonzero(bits[key % size])
                filled = ["".join(one_form(every[p]) for p in three if p >= 0) for three in slots[keep].tolist()]
                of = pa.array(doc[keep])
                yield pa.RecordBatch.from_arrays(
                    [part.column("d1").take(of), part.column("d2").take(of), pa.array(key[keep]), pa.array(place[keep].astype(np.int32)), pa.array(filled, pa.string())],
                    ["d1", "d2", "key", "place", "slots"],
                )

    of_documents = rows.select("d1", "d2", "text").mapInArrow(cut_documents, "d1 bigint, d2 bigint, key bigint, place int, slots string")
    # A window of an item takes some sixty bytes.
    few = counted["count"].sum() * 64 <= BROADCAST_BYTES
    hits = of_documents.join(F.broadcast(of_items) if few else of_items, F.col("key") == F.col("item_key"))
    pair = ["d1", "d2", "i1", "i2"]
    most = F.greatest(F.length("slots"), F.length("item_slots"))
    pair_of_words = F.col("sort") == PAIR
    agree = (F.col("sort") == FILLED) | (~pair_of_words & (F.levenshtein("slots", "item_slots") <= rules.slot * most))
    offset = F.col("place") - F.col("item_place")
    half = rules.drift // 2
    # Windows count together if they fall in one of two overlapping bins of offsets; places are bits, so copies don't count.
    bins = F.array(F.floor(offset / rules.drift) * 2, F.floor((offset + half) / rules.drift) * 2 + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("item_place", F.lit(61)))
    if_ = lambda c: F.when(c, bit).otherwise(F.lit(0).cast("bigint"))
    marks = {"agreeing": if_(agree), "sharing": if_(~pair_of_words), "pairs": if_(pair_of_words)}
    near = hits.select(*pair, F.explode(bins).alias("bin"), *[c.alias(m) for m, c in marks.items()]).groupBy(*pair, "bin").agg(*[F.bit_or(m).alias(m) for m in marks])
    enough = (F.bit_count("agreeing") >= rules.agreeing) | (F.bit_count("sharing") >= rules.sharing) | (F.bit_count("pairs") >= rules.pairs)
    candidates = near.where(enough).select(*pair).distinct()

    # --- letters of the candidates, aligned

    copies = 16
    # Alignment takes much time a byte, so its partitions are not left to be merged by size.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    to = candidates.select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_salt"), "i1", "i2")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(copies)).cast("int"))
    met = salted.join(to.repartition(n, "_d1", "_d2", "_salt").hint("merge"), (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("salt") == F.col("_salt")))
    own = texts.select(F.col("i1").alias("_i1"), F.col("i2").alias("_i2"), F.col("text").alias("item_text"))
    both = met.join(F.broadcast(own) if few else own, (F.col("i1") == F.col("_i1")) & (F.col("i2") == F.col("_i2"))).select("doc", met["text"], "i1", "i2", "item_text")
    kind = rows.schema["doc"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared: OrderedDict[str, Item] = OrderedDict()
        last, page = None, None
        for b in batches:
            out = []
            for text, test in zip(b.column("text").to_pylist(), b.column("item_text").to_pylist(), strict=True):
                if text != last:
                    page, last = Page(letters(_WORD.findall(folded(text)))[0]), text
                if test not in prepared:
                    prepared[test] = Item(test, known.value, rules)
                    if len(prepared) > 2000:
                        prepared.popitem(last=False)
                out.append(prepared[test].printed(page))
            found = np.array(out, np.int32).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc", "i1", "i2")], *[pa.array(x) for x in found.T]], ["doc", "i1", "i2", "words", "n_slots", "n_other"])

    aligned = both.mapInArrow(align, f"doc {kind}, i1 bigint, i2 bigint, words int, n_slots int, n_other int")
    ids = tests.select("item", F.col("i1").alias("_i1"), F.col("i2").alias("_i2"))
    return aligned.join(ids, (F.col("i1") == F.col("_i1")) & (F.col("i2") == F.col("_i2"))).select(
        "doc", "item", "words", (F.col("words") >= rules.words).alias("leaked"), "n_slots", "n_other"
    )
