"""Evaluation texts leaking into training text (problem 8).

Both sides are brought to the same words: characters that were escaped,
mis-decoded, composed or hidden are restored, markup and punctuation go, words
broken over lines are joined.  A second, canonical form replaces numbers,
units and names by typed placeholders.  Windows of five canonical words of the
items are hashed; a document's windows are joined with them, which finds every
stretch of 30 words with at most five edits, since five edits leave at least
one run of five words.  The slots of the matched windows are then compared:
equal, consistently exchanged (a re-parameterised item) or in conflict; and an
exact check on the words themselves decides.  An item re-told with other names
and numbers, whose words alone would not show it, is told by its canonical
words and by every slot being exchanged for one value throughout.

The items are a stated query set.  They are sent to the workers in blocks of
bounded size, one pass over the documents for each block; a block is dropped
from memory once its pass has been written.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.runtime import bound_batches, cut, received, share

#: Words in a row that make a leak, and the words and edits of an inexact one.
RUN, STRETCH, ONE_IN = 12, 30, 6
#: Words of a template window.
WINDOW = 5
#: Of those triples, distinct ones at least, for a first look.
MIN_DISTINCT = 11
#: Triples of words that a stretch of 30 words with five edits keeps at least, and the diagonals of one band.
MIN_TRIPLES, BAND = 13, 24
#: Words of a template window that must be no placeholders, and diagonals that a re-told item may stray.
LITERAL, STRAY = 3, 8
#: Characters of items in one block that is sent to the workers.
BLOCK_CHARS = 4_000_000

#: Number words and units that become placeholders.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half quarter dozen first second third fourth fifth sixth seventh eighth ninth tenth"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg ton tons tonne tonnes pound pounds ounce ounces ml l litre litres liter liters "
    "second seconds minute minutes hour hours day days week weeks month months year years decade decades percent usd eur gbp dollar dollars euro euros pence cents"
).split()

_TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]{0,300}>|<!--.*?-->", re.S)
_LATIN = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_MOJIBAKE = re.compile(f"[Â-ô][\u0080-¿{_LATIN}]{{1,3}}")
_ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:=[0-9A-F]{2})+|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}")
_JOINED = re.compile(r"[‐‑­-]\s*\n[>\s]*(?=\w)|=\r?\n")
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ]+")
#: Signs that only part words; taken out first, most texts are plain ASCII.
_PARTING = "£€–—“”„«»…•·°§©®›‹¿¡"
_TABLE = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + b" " * 128
#: Letters of other scripts that look like Latin ones.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅαορνιτκ", "aeopcyxijsdhlABEKMHOPCTXIJSaopvitk")


#: Tags that may stand within a word, by their first letters.
_INLINE = ("b>", "i>", "u>", "/b", "/i", "/u", "em", "/e", "st", "/s", "sp", "wb", "fo", "/f")


def _demoji(m: re.Match) -> str:
    try:
        return bytes(ord(c) if ord(c) < 256 else c.encode("cp1252")[0] for c in m.group()).decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def _unescape(m: re.Match) -> str:
    s = m.group()
    if s[0] == "\\":
        return chr(int(s[2:], 16))
    try:
        return bytes(int(s[i + 1 : i + 3], 16) for i in range(0, len(s), 3)).decode("utf-8")
    except UnicodeDecodeError:
        return s


def _plain(text: str) -> str:
    """The text with its characters restored, without markup."""
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m.group()[1:3].lower() in _INLINE else " ", text)
    if "%" in text or "=" in text or "\\" in text:
        text = _ESCAPED.sub(_unescape, text)
    if not text.isascii():
        if "Â" in text or "Ã" in text or "â" in text:
            text = _MOJIBAKE.sub(_demoji, text)
        text = text.replace("’", "'").replace("‘", "'").replace("‐", "-").replace("‑", "-").replace(" ", " ")
        for sign in _PARTING:
            text = text.replace(sign, " ")
        if not text.isascii():
            text = _HIDDEN.sub("", text)
            if not text.isascii():
                text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(_LOOKALIKE)
    if "\n" in text and ("-\n" in text or "-\r\n" in text or "- \n" in text or "=\n" in text):
        text = _JOINED.sub("", text)
    return text


def words(text: str, names: set | None = None) -> list[str]:
    """The words of a text, however they are written; ``names`` receives those that stand capitalised within a sentence.

    Apostrophes and hyphens do not part words.
    """
    text = _plain(text).replace("'", "").replace("-", "").replace("*", "")
    if names is not None:
        names |= {m[1].lower() for m in re.finditer(r"(?<=[a-z,] )([A-Z][^\W_]*)", text)}
    low = text.lower()
    return low.encode().translate(_TABLE).decode().split() if low.isascii() else _WORD.findall(low)


class Index:
    """Windows of a block of items, by the hash of their canonical words."""

    def __init__(self, items: list[tuple[int, str]]):
        names: set[str] = set()
        self.ids, self.texts = [], []
        for item, text in items:
            if text and (w := words(text, names)):
                self.ids.append(item)
                self.texts.append(w)
        plain = {x for w in self.texts for x in w}
        # A word is a name if it never stands uncapitalised; those of one text only would be chance.
        numbers, units = set(NUMBERS), set(UNITS)
        self.slots = {x: "#" if x in numbers else "~" for x in numbers | units} | {x: "@" for x in names & plain if x not in numbers | units}
        self.code: dict[str, int] = {}
        for w in self.texts:
            for x in w:
                self.code.setdefault(self.canonical(x), len(self.code))
        self.words = {x: self.code[self.canonical(x)] for x in plain} | {x: self.code[c] for x, c in self.slots.items() if c in self.code}
        keys, where = [], []
        slots = {self.code[c] for c in "#~@" if c in self.code}
        for n, w in enumerate(self.texts):
            h = self.hashes(w)
            # Windows that are mostly placeholders stand in any text.
            bare = np.array([self.words[x] not in slots for x in w], np.int64)
            if len(h):
                h = np.where(np.convolve(bare, np.ones(WINDOW, np.int64), "valid") >= LITERAL, h, -1)
            keys.append(h)
            where.append(np.stack([np.full(len(h), n), np.arange(len(h))], 1))
        keys, where = (np.concatenate(x) if x else np.zeros((0,), np.int64) for x in (keys, where))
        where, keys = (where[keys >= 0], keys[keys >= 0]) if len(keys) else (where, keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.where = keys[order], where[order] if len(order) else np.zeros((0, 2), np.int64)
        self.triples = [_triples(w) for w in self.texts]

    def canonical(self, word: str) -> str:
        return self.slots.get(word) or ("#" if word.isdigit() else word)

    def hashes(self, w: list[str]) -> np.ndarray:
        """A hash for each window; a word that is in no item may stand for a name that an item has, -1 where none has one."""
        get, number, name = self.words.get, self.code.get("#", -1), self.code.get("@", -1)
        c = np.array([c if (c := get(x)) is not None else number if x.isdecimal() else name for x in w], np.int64)
        n = len(c) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        h, bad = np.zeros(n, np.int64), np.zeros(n, bool)
        with np.errstate(over="ignore"):
            for j in range(WINDOW):
                part = c[j : j + n]
                h = h * np.int64(1_000_003) + part
                bad |= part < 0
        h = h & np.int64(0x7FFFFFFFFFFFFFFF)
        h[bad] = -1
        return h

    def matches(self, text: str) -> list[tuple]:
        """``(item, kind, longest run, stretch, slots exchanged)`` of each item that the text holds."""
        w = words(text)
        h = self.hashes(w)
        at = np.flatnonzero(h >= 0)
        if not len(at) or not len(self.keys):
            return []
        lo, hi = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(at):
            return []
        # All (position, item, position in the item) of equal windows.
        count = hi - lo
        first = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        p, n, q = np.repeat(at, count), self.where[first, 0], self.where[first, 1]
        # A run of 12 words shows as eight windows on one diagonal at least.
        line, size = np.unique(np.stack([n, p - q], 1), axis=0, return_counts=True)
        runs: dict[int, int] = {}
        for i, d in line[size >= RUN - WINDOW + 1].tolist():
            runs[i] = max(runs.get(i, 0), self._run(w, self.texts[i], p[(n == i) & (p - q == d)].tolist(), d))
        found, own = [], _triples(w)
        for i in np.unique(n).tolist():
            run = runs.get(i, 0)
            if run < RUN and (told := self._retold(w, self.texts[i], p[n == i], q[n == i])):
                found.append((self.ids[i], "template", run, *told))
                continue
            if run < RUN and len(self.triples[i].keys() & own.keys()) < MIN_DISTINCT:
                continue
            pairs = list(zip(p[n == i].tolist(), q[n == i].tolist()))
            stretch = 0 if run >= RUN else self._stretch(w, i, pairs, own)
            if run >= RUN or stretch >= STRETCH:
                exchanged, consistent = self._slots(w, self.texts[i], pairs)
                kind = "verbatim" if run >= RUN else "reparameterised" if exchanged and consistent else "edited"
                found.append((self.ids[i], kind, run, stretch, exchanged))
        return found

    @staticmethod
    def _run(w: list[str], item: list[str], starts: list[int], d: int) -> int:
        """The most words in a row that stand at the same places of one diagonal; placeholders may hide differences."""
        best = here = 0
        for i in range(max(0, d, min(starts) - RUN), min(len(w), len(item) + d)):
            here = here + 1 if w[i] == item[i - d] else 0
            best = max(best, here)
        return best

    def _stretch(self, w: list[str], n: int, pairs: list[tuple[int, int]], own: dict) -> int:
        """The longest stretch with at most one word in six changed, added or left out.

        Thirty words with five edits keep 25 words in at most six runs, so 13
        triples of neighbours, whose diagonals lie close together.
        """
        item, bands = self.texts[n], {}
        for triple, js in self.triples[n].items():
            for i in own.get(triple, ()):
                for j in js:
                    bands[(i - j) // BAND] = bands.get((i - j) // BAND, 0) + 1
        good = {c for b in bands for c in (b, b + 1) if bands.get(b, 0) + bands.get(b + 1, 0) >= MIN_TRIPLES}
        best, done = 0, -1
        for p, q in pairs if good else ():
            d = p - q
            if p <= done or d // BAND not in good:
                continue
            # All of the document that this window may belong to: as far as the item reaches, and a sixth more.
            a, b = max(0, d - q // (ONE_IN - 1) - 6), min(len(w), d + len(item) + (len(item) - q) // (ONE_IN - 1) + 6)
            done = b - WINDOW
            steps = []
            for op, i, j, k, m in SequenceMatcher(None, item, w[a:b], autojunk=False).get_opcodes():
                steps += [1] * (j - i) if op == "equal" else [1 - ONE_IN] * max(j - i, m - k)
            best = max(best, _longest(steps))
        return best

    def _retold(self, w: list[str], item: list[str], p: np.ndarray, q: np.ndarray) -> tuple[int, int] | None:
        """Canonical words and slots exchanged, where most of a stretch's words are slots' or the same and each slot went to one value."""
        if len(q) < (STRETCH - WINDOW) // 2:
            return None
        d = p - q
        near = np.abs(d - int(np.median(d))) <= STRAY
        covered = np.unique((q[near][:, None] + np.arange(WINDOW)).ravel())
        if len(covered) < STRETCH:
            return None
        exchanged, consistent = self._slots(w, item, list(zip(p[near].tolist(), q[near].tolist())))
        same = sum(item[k + j] == w[i + j] for i, k in zip(p[near].tolist(), q[near].tolist()) for j in range(WINDOW))
        # Texts that follow the item word by word are judged by their words.
        return (len(covered), exchanged) if consistent and exchanged > len(covered) // ONE_IN and same < WINDOW * int(near.sum()) else None

    @staticmethod
    def _slots(w: list[str], item: list[str], pairs: list[tuple[int, int]]) -> tuple[int, bool]:
        """How many slot values were exchanged, and whether each value went to one other value throughout."""
        to: dict[str, set[str]] = {}
        for p, q in pairs:
            for j in range(WINDOW):
                to.setdefault(item[q + j], set()).add(w[p + j])
        changed = {k: v for k, v in to.items() if v != {k}}
        return len(changed), all(len(v) == 1 for v in changed.values())


def _triples(w: list[str]) -> dict[tuple[str, str, str], list[int]]:
    at: dict[tuple[str, str, str], list[int]] = {}
    for i, triple in enumerate(zip(w, w[1:], w[2:])):
        at.setdefault(triple, []).append(i)
    return at


def _longest(steps: list[int]) -> int:
    """The length of the longest part with a sum of zero or more."""
    sums = [0]
    for s in steps:
        sums.append(sums[-1] + s)
    # Only starts with a smaller sum than all before can begin the longest part.
    starts = [0]
    for i, s in enumerate(sums):
        if s < sums[starts[-1]]:
            starts.append(i)
    best = 0
    for k in range(len(sums) - 1, 0, -1):
        while starts and (starts[-1] >= k or sums[starts[-1]] <= sums[k]):
            best = max(best, k - starts.pop())
    return best


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """``(doc_id, item_id, kind, run, stretch, slots)`` for each item that a document holds.

    ``kind`` is ``verbatim`` (at least 12 words in a row), ``reparameterised``
    or ``edited`` (at least 30 words with at most one in six changed), or
    ``template`` (more is changed, but only names, numbers and units, and each
    of them to one value throughout).  Null or
    blank texts on either side hold nothing; repeated rows are reported for
    each row; of items with the same text each is reported.  Empty tables give
    an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"{key} {kind}, {item_key} {item_kind}, kind string, run int, stretch int, slots int"
    docs = documents.select(F.col(key), F.col(text).alias("_t")).where("_t is not null")
    def search(shared):
        def batches(rows):
            index = received(shared)
            for batch in rows:
                out = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out += [(k, *m) for m in index.matches(t)]
                columns = list(zip(*out)) if out else [[]] * 6
                types = [batch.schema.field(0).type, pa.type_for_alias(_ARROW.get(item_kind, "int64")), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, item_key, "kind", "run", "stretch", "slots"])

        return docs.mapInArrow(batches, schema)

    # One block is held at a time: what it finds is written before the next one is built.
    found, block, size = [], [], 0

    def passed(block, last: bool) -> None:
        shared = share(spark, Index(block))
        found.append(search(shared) if last and not found else cut(search(shared), "leaks"))
        if not last or len(found) > 1:
            shared.destroy()

    for row in items.select(item_key, item_text).where(F.col(item_text).isNotNull()).toLocalIterator():
        if size >= BLOCK_CHARS:
            passed(block, False)
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    passed(block, True)
    return functools.reduce(DataFrame.unionByName, found)


_ARROW = {"bigint": "int64", "int": "int32", "string": "string"}


def clean(documents: DataFrame, items: DataFrame, key: str = "doc_id", **columns: str) -> DataFrame:
    """The documents that hold no item."""
    return documents.join(leaks(documents, items, key, **columns).select(key).distinct(), key, "left_anti")
