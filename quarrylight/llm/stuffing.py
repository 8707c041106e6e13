"""Keyword-stuffed and link-list pages (problem 10).

A text becomes a sequence of classes: function words stand for themselves,
other words for their shape and ending, or for being repeated all over the
text, and punctuation, numbers, links and tags for their kind.  A trigram
model over these classes is trained on prose.  Every stretch of a text is then
scored: where its perplexity under the model is far above that of prose, or
far below it, the stretch is no prose.  A text of mostly such stretches is
spam, even if a sentence stands among them.

The trigrams are counted over all texts that look like prose, and the limits
are quantiles of the scores of all their stretches; both tables have a fixed
size, whatever the corpus.  Texts are read once, into a byte or two for each
token; counting, scoring and judging read these codes.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.runtime import bound_batches, cut, received, share

#: Tokens of a stretch.
STRETCH = 24
#: A text is spam from this share of tokens in stretches that are no prose.
MOSTLY = 0.6
#: Tokens from which a line counts as a sentence.  A text below it, whose score says little, is spam only if this share
#: of its words besides are links, tags or words said before or again.
LEAST, LISTED = 12, 0.5
#: Quantiles of the stretches of prose that bound it, and the margins beyond them in nats for each token.
LOW, HIGH, LOW_MARGIN, HIGH_MARGIN = 0.001, 0.998, 0.2, 0.35
#: A word is repeated all over a text from this count and share of its words, and rules it from the second share.
REPEATED, REPEATED_SHARE, RULING_SHARE = 4, 0.02, 0.05

#: Function words of the four languages.
FUNCTION_WORDS = (
    "the a an of in to and for on with is are was were be been we our us you your at by from that as it its or not but they their who which when if than so this these those has have had will would can may do does no there what how all more most some many each other into about after before without he his she her i my me them "
    "der die das den dem des ein eine einen einem einer und oder mit von zu zum zur im in ist sind war wird werden nicht auf für als auch an bei nach aus wir sie ihr ihre unser es sich dass wenn damit "
    "le la les un une des du de et ou à au aux en dans pour par sur avec est sont ne pas que qui ce cette ces il elle nous vous leur son sa ses car "
    "el los las una unos y o del al con por para se su sus lo que es son no como más este esta pero sin"
).split()

_FUNCTION = frozenset(FUNCTION_WORDS)
_TOKEN = re.compile(r"https?://\S+|www\.\S+|#\w+|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d[\d.,:]*|\n+|[^\w\s]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_KINDS = ["<s>", "url", "tag", "number", "line", ".", ",", "?", ":", "(", "|", "-", "£", "sign", "upper", "Title", "title-s", "-ing", "-ed", "-ly", "-s", "-er", "-tion", "short", "long", "repeated", "ruling"]
_ENDINGS = (("ing", "-ing"), ("ed", "-ed"), ("ly", "-ly"), ("tion", "-tion"), ("er", "-er"), ("s", "-s"))
_SIGNS = {".": ".", "!": "?", "?": "?", ",": ",", ";": ":", ":": ":", "(": "(", ")": "(", "[": "(", "]": "(", "“": "(", "”": "(", '"': "(", "|": "|", ">": "|", "»": "|", "•": "-", "–": "-", "-": "-", "*": "-", "£": "£", "$": "£", "€": "£"}


class Coder:
    """Texts to sequences of class numbers."""

    def __init__(self):
        self.names = _KINDS + list(dict.fromkeys(FUNCTION_WORDS))
        self.number = {x: i for i, x in enumerate(self.names)}
        self.function = {x: self.number[x] for x in FUNCTION_WORDS}
        self.first_function = len(_KINDS)
        self.known: dict[str, int] = {}

    def kind(self, token: str) -> int:
        low = token.lower()
        if low in self.function:
            return self.function[low]
        c = token[0]
        if c == "\n":
            return self.number["line"]
        if c == "#" and len(token) > 1:
            return self.number["tag"]
        if low.startswith(("http://", "https://", "www.")):
            return self.number["url"]
        if c.isdigit():
            return self.number["number"]
        if not c.isalpha():
            return self.number[_SIGNS.get(token, "sign")]
        if len(token) > 1 and token.isupper():
            return self.number["upper"]
        if c.isupper():
            return self.number["title-s" if low.endswith("s") else "Title"]
        for end, name in _ENDINGS:
            if low.endswith(end) and len(low) > len(end) + 2:
                return self.number[name]
        return self.number["short" if len(low) < 6 else "long"]

    def code(self, text: str) -> np.ndarray:
        if "<" in text:
            text = _TAG.sub("", text)
        if "&" in text:
            text = html.unescape(text)
        tokens = _TOKEN.findall(text if text.isascii() else _HIDDEN.sub("", text))
        if len(self.known) > 500_000:
            self.known.clear()
        known, kind = self.known, self.kind
        out = []
        for t in tokens:
            k = known.get(t)
            if k is None:
                k = known[t] = kind(t)
            out.append(k)
        # Content words that stand all over the text.
        low = self.number["Title"] - 1
        n = sum(1 for k in out if k >= low)
        least = max(REPEATED, REPEATED_SHARE * n)
        often = {w: m for w, m in Counter(tokens).items() if m >= least and low <= known[w] < self.first_function}
        if often:
            rule = max(REPEATED, RULING_SHARE * n)
            often = {w: self.number["ruling" if m >= rule else "repeated"] for w, m in often.items()}
            out = [often.get(t, k) for t, k in zip(tokens, out)]
        return np.array(out, np.int64)


def listed(text: str) -> float:
    """The share of a text's words that are links, tags or words which occur more than once, function words aside."""
    words = [w.lower() for w in _TOKEN.findall(_HIDDEN.sub("", html.unescape(_TAG.sub("", text)))) if w[0].isalnum() or w[0] == "#"]
    count = Counter(words)
    return sum(w.startswith(("#", "http", "www.")) or count[w] > 1 and w not in _FUNCTION for w in words) / max(1, len(words))


def looks_like_prose(codes: np.ndarray, coder: Coder) -> bool:
    """Texts for the sample: a good share of function words, sentence marks, and few repeated words."""
    n = len(codes)
    if n < 3 * LEAST:
        return False
    count = np.bincount(codes, minlength=len(coder.names))
    content = count[coder.number["upper"] : coder.first_function].sum()
    words = content + count[coder.first_function :].sum()
    return bool(words and count[coder.first_function :].sum() / words >= 0.25 and count[coder.number["."]] >= words / 60 and count[coder.number["repeated"]] + 3 * count[coder.number["ruling"]] < 0.3 * content and count[coder.number["url"]] + count[coder.number["tag"]] < 0.02 * n)


class Model:
    """Trigrams over classes, smoothed by bigrams and unigrams (Witten-Bell)."""

    def __init__(self, counts: list[tuple[int, int]] = (), coder: Coder | None = None):
        self.coder = coder or Coder()
        v = len(self.coder.names)
        tri = np.zeros(v * v * v, np.float32)
        if len(counts):
            at, n = np.array(counts, np.int64).T
            tri[at] = n
        tri = tri.reshape(v, v, v)
        bi, uni = tri.sum(0), np.ones(v, np.float32) + tri.sum((0, 1))
        uni = uni / uni.sum()
        kinds = (bi > 0).sum(-1, keepdims=True)
        bi = (bi + (kinds + 1) * uni) / (bi.sum(-1, keepdims=True) + kinds + 1)
        kinds = (tri > 0).sum(-1, keepdims=True)
        tri = (tri + (kinds + 1) * bi[None]) / (tri.sum(-1, keepdims=True) + kinds + 1)
        self.cost = -np.log(tri).astype(np.float32)
        self.low, self.high = -LOW_MARGIN, 20.0

    def bound(self, bins: list[tuple[int, int]]) -> None:
        """Set the limits from the histogram of the scores of prose, in bins of ``BIN`` nats."""
        if bins:
            at, n = np.array(sorted(bins), np.int64).T
            share = np.cumsum(n) / n.sum()
            limit = lambda q: float(at[np.searchsorted(share, q)]) * BIN
            self.low, self.high = limit(LOW) - LOW_MARGIN, limit(HIGH) + BIN + HIGH_MARGIN

    def _sentences(self, codes: np.ndarray) -> np.ndarray:
        """The lines that run as sentences; lists of links or labels must teach nothing."""
        line = self.coder.number["line"]
        parts = np.split(codes, np.flatnonzero(codes == line))
        return np.concatenate([np.zeros(0, np.int64), *(p for p in parts if len(p) >= LEAST and (p >= self.coder.first_function).mean() >= 0.15)])

    def stretches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean cost of each stretch of tokens, and its number of tokens."""
        p = np.concatenate(([0, 0], codes))
        cost = self.cost[p[:-2], p[1:-1], p[2:]]
        starts = np.arange(0, len(codes), STRETCH)
        sizes = np.diff(np.append(starts, len(codes)))
        # A short rest belongs to the stretch before it.
        if len(starts) > 1 and sizes[-1] < STRETCH // 2:
            starts, sizes = starts[:-1], np.append(sizes[:-2], sizes[-2] + sizes[-1])
        return np.add.reduceat(cost, starts) / sizes, sizes

    def judge(self, codes: np.ndarray) -> tuple[float, float, float] | None:
        """Mean cost, and the shares of tokens in stretches far above and far below prose; None without a token."""
        if not len(codes):
            return None
        score, size = self.stretches(codes)
        total = size.sum()
        return float((score * size).sum() / total), float(size[score > self.high].sum() / total), float(size[score < self.low].sum() / total)


#: Width of a bin of scores, in nats for each token.
BIN = 0.005


def scores(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, perplexity, high_share, low_share, spam)`` for each text with a token.

    Null and blank texts give no row; a text of fewer than ``LEAST`` tokens is
    one stretch and must be a list by its words as well.  Repeated rows are
    judged one by one and alike; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    kind = documents.schema[key].dataType.simpleString()

    def coded(rows):
        coder = Coder()
        for batch in rows:
            texts = batch.column(1).to_pylist()
            codes = [coder.code(t) for t in texts]
            lists = [len(c) >= LEAST or listed(t) >= LISTED for c, t in zip(codes, texts)]
            prose = [looks_like_prose(c, coder) for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.astype(np.uint16).tobytes() for c in codes], pa.binary()), pa.array(prose, pa.bool_()), pa.array(lists, pa.bool_())], names=["_k", "_codes", "_prose", "_lists"])

    docs = cut(documents.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t is not null").mapInArrow(coded, f"_k {kind}, _codes binary, _prose boolean, _lists boolean"), "codes")
    read = lambda batch, i: [np.frombuffer(c, np.uint16).astype(np.int64) for c in batch.column(i).to_pylist()]
    prose = docs.where("_prose").select("_codes")

    def trigrams(rows):
        own = Model.__new__(Model)
        own.coder = Coder()
        v = len(own.coder.names)
        for batch in rows:
            parts = [np.concatenate(([0, 0], own._sentences(c))) for c in read(batch, 0)]
            at = np.concatenate([np.zeros(0, np.int64), *((p[:-2] * v + p[1:-1]) * v + p[2:] for p in parts)])
            ids, n = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["at", "n"])

    # As many rows as there are trigrams of classes at most.
    model = Model([(r["at"], r["n"]) for r in prose.mapInArrow(trigrams, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()])
    first = share(spark, model)

    def spread(rows):
        own = received(first)
        for batch in rows:
            found = [own.stretches(p)[0] for c in read(batch, 0) if len(p := own._sentences(c)) >= LEAST]
            ids, n = np.unique((np.concatenate([np.zeros(0), *found]) / BIN).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["at", "n"])

    model.bound([(r["at"], r["n"]) for r in prose.mapInArrow(spread, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()])
    low, high = model.low, model.high

    def batches(rows):
        own = received(first)
        own.low, own.high = low, high
        for batch in rows:
            out = [(k, one, *j) for k, c, one in zip(batch.column(0).to_pylist(), read(batch, 1), batch.column(2).to_pylist()) if (j := own.judge(c))]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.bool_()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=["_k", "_lists", "cost", "high_share", "low_share"])

    judged = docs.select("_k", "_codes", "_lists").mapInArrow(batches, f"_k {kind}, _lists boolean, cost double, high_share double, low_share double")
    return judged.select(F.col("_k").alias(key), F.exp("cost").alias("perplexity"), "high_share", "low_share", (F.col("_lists") & (F.col("high_share") + F.col("low_share") > MOSTLY)).alias("spam"))
