"""Main content of pages without site furniture (problem 3).

A page is a sequence of blocks, its non-blank lines.  A block is a vector:
the mean of learned vectors of its hashed words, and its path, which for text
without tags is what the layout still tells: markers, bars, blank lines around
it, length, ending, place, and whether the title repeats it.  A bidirectional
LSTM in numpy reads the whole page and labels every block.

It is trained here, on a bounded sample of sites whose pages are labelled by
rules that the network never sees in use: how many pages of the site share the
line, and wordings of menus, notices and footers.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import residue
from quarrylight.llm.sampling import smallest_hashes
from quarrylight.runtime import bound_batches

#: The bounded sample: sites, and the pages that one of them may have.
SITES, FEWEST, MOST = 48, 6, 60
#: Buckets of hashed words, dimensions of a word, hidden units in each direction, passes over the sample.
BUCKETS, WORD, HIDDEN, EPOCHS = 4096, 16, 20, 10
#: Share of the pages in a pass whose words are exchanged, so that the network does not lean on wordings alone.
FORGET = 0.4
#: Pages that are read side by side.
BATCH = 256

_LEAD = re.compile(r"^[\s»⚠•·*–\-›]+")
_COUNTER = re.compile(r"\s*\(\d+\)\s*$")
#: Wordings of furniture, for the labels of the sample only.
_FURNITURE = re.compile(
    r"(?iu)cookie|essential cookies|small files on your device|^skip to (?:main )?content|^(?:close )?menu$|^share (?:this|on)|^print this|email a friend|tell your friends|copy link|was this (?:page|article) helpful|newsletter|^subscribe|in your inbox|press register|no spam"
    r"|^read more|– read more|^load more|^back to top|^see all|^more from|©|all rights reserved|^company number|vat no|registered office|authorised and regulated|accepts no liability|no part of this website|calls may be recorded|^privacy policy|^terms (?:&|and) conditions|^sitemap$|^accessibility$|^modern slavery|^complaints procedure|^fees sheet|^client money"
    r"|^data protection contact|part of a family of|^(?:site|website) by|^(?:phone|tel|t|call us|e-?mail|e|write to|fax): |^(?:datenschutz|impressum|agb|mentions légales|politique de|aviso legal|política de)"
)
_HEADS = re.compile(r"(?iu)^(?:popular|related|latest|recent|similar|recommended)\b.{0,20}$|^you may also like|^in this section|^see also|^more (?:articles|news|stories)|^(?:das könnte|beliebte|verwandte|articles liés|à lire aussi|le puede interesar|artículos relacionados)")
_CONTACT = re.compile(r"(?iu)^(?:phone|tel|t|call us|telefon|téléphone|teléfono): ")
_TRAIL = re.compile(r"^[^>›]{1,40} [>›] [^>›]+(?: [>›] [^>›]+)*$")
_SENTENCE = re.compile(r"[.!?:”\"]\s*$")


def _norm(line: str) -> str:
    return re.sub(r"\s+", " ", _COUNTER.sub("", _LEAD.sub("", line.replace(" ", " ")))).strip().lower()


def blocks(text: str) -> list[tuple[int, str]]:
    """The non-blank lines with their numbers from 1."""
    return [(i, x) for i, x in enumerate(text.split("\n"), 1) if x and not x.isspace() and x.strip("  \t\r")]


def teach(pages: list[tuple[str, str, str]]) -> list[list[int]]:
    """Labels of ``(domain, title, text)`` pages of whole sites: 1 for body, 0 for furniture."""
    shared: dict[str, Counter] = {}
    number = Counter(d for d, _, _ in pages)
    sites: dict[str, set[str]] = {}
    for d, _, t in pages:
        lines = {_norm(x) for _, x in blocks(t)}
        shared.setdefault(d, Counter()).update(lines)
        for n in lines:
            if len(n) < 40:
                sites.setdefault(n, set()).add(d)
    out = []
    for d, title, t in pages:
        labels, teasers, begun = [], False, False
        normal = [_norm(x) for _, x in blocks(t)]
        for j, (_, x) in enumerate(blocks(t)):
            n = normal[j]
            share = shared[d][n] / number[d]
            parts = re.split(r" \| | {2,}", x.strip())
            long = len(n) > 90 and bool(_SENTENCE.search(n))
            known = bool(_FURNITURE.search(n)) and (len(n) < 200 or share >= 0.3) or share >= 0.6 and number[d] >= FEWEST or len(parts) >= 3 and len(n) < 200 or bool(_TRAIL.match(x.strip())) and len(n) < 100
            if _HEADS.search(n) and len(n) < 40:
                teasers, known = True, True
            elif long or n.startswith(("by ", "posted by", "written by", "reviewed by")):
                teasers = False
            elif teasers and not known and begun:
                # A heading that many sites use, before a paragraph, ends the teasers.
                heading = len(sites.get(n, ())) >= 3 and j + 1 < len(normal) and len(normal[j + 1]) > 90
                teasers = not heading
                known = len(n) < 90 and not heading
            if not known:
                begun = True
            labels.append(0 if known else 1)
        # The lines of name and address above a footer's telephone belong to it.
        for j, n in enumerate(normal):
            if _CONTACT.search(n) and j >= 2 and len(normal[j - 1]) < 110 and any(c.isdigit() for c in normal[j - 1]) and not normal[j - 1].endswith((".", "?", "!")):
                labels[j - 1] = 0
                if len(normal[j - 2]) < 140 and not normal[j - 2].endswith((".", "?", "!")):
                    labels[j - 2] = 0
        out.append(labels)
    return out


_SHAPES = 17


class Reader:
    """Pages to block vectors: word buckets and layout."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.lines: dict[str, tuple] = {}

    def line(self, x: str) -> tuple[list[int], list[float]]:
        short = len(x) < 160
        found = self.lines.get(x) if short else None
        if found is None:
            tokens, known, ids = x.lower().split(), self.words, []
            for w in tokens:
                i = known.get(w)
                if i is None:
                    if len(known) > 300_000:
                        known.clear()
                    i = known[w] = zlib.crc32(w.strip(".,;:!?()[]“”\"'»›…").encode()) % BUCKETS
                ids.append(i)
            s = x.strip()
            n, k = len(s), len(tokens) or 1
            end = s[-1:] if s else ""
            shape = [
                min(n, 400) / 400, min(k, 60) / 60, float(n < 30), float(end in ".!?"), float(end in ":…›"), float(s[:1] in "•-–*·"), float(s[:1] in "»⚠©"),
                float(" | " in s), float(" > " in s or " › " in s), float("  " in s), float("@" in s), float(s[-1:] == ")"), sum(c.isdigit() for c in s) / max(n, 1), float(s[:1].isupper()), float(s.isupper()),
            ]
            found = (ids, shape)
            if short:
                if len(self.lines) > 100_000:
                    self.lines.clear()
                self.lines[x] = found
        return found

    def page(self, title: str | None, text: str) -> tuple[list[int], list[list[int]], np.ndarray]:
        """Line numbers, word buckets and layout of each block; the last two columns are the blank lines before and the title."""
        numbers, ids, shapes = [], [], []
        title = (title or "").lower()
        before = 0
        for i, x in blocks(text):
            w, s = self.line(x)
            low = x.strip().lower()
            numbers.append(i)
            ids.append(w)
            shapes.append([*s, min(i - before - 1, 3) / 3, float(len(low) > 3 and low in title or len(title) > 3 and title in low)])
            before = i
        return numbers, ids, np.array(shapes, np.float32).reshape(-1, _SHAPES)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def forgotten(page, rng):
    """The page with a share of its words exchanged for any others, the same ones throughout: what is left is the layout and the context."""
    other = np.arange(BUCKETS)
    gone = rng.random(BUCKETS) < rng.random()
    other[gone] = rng.integers(0, BUCKETS, int(gone.sum()))
    return page[0], [[int(other[i]) for i in w] for w in page[1]], page[2]


class Labeller:
    """A bidirectional LSTM over the blocks of a page with one output for each."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.d = WORD + _SHAPES + 2
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": (rng.standard_normal((BUCKETS, WORD)) * 0.3).astype(np.float32), "o": r(2 * HIDDEN, 1)[:, 0], "c": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": r(self.d, 4 * HIDDEN), f"h{way}": r(HIDDEN, 4 * HIDDEN), f"b{way}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1

    def inputs(self, pages) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Padded block vectors ``(steps, pages, d)``, the mask, and what the way back needs."""
        t, n = max(len(p[1]) for p in pages), len(pages)
        sizes = np.array([len(w) for p in pages for w in p[1]])
        flat = np.fromiter((i for p in pages for w in p[1] for i in w), np.int64, int(sizes.sum()))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        mean = np.zeros((len(sizes), WORD), np.float32)
        some = sizes > 0
        if some.any():
            mean[some] = np.add.reduceat(self.p["e"][flat], starts[some], axis=0) / sizes[some, None]
        x, mask = np.zeros((t, n, self.d), np.float32), np.zeros((t, n), np.float32)
        steps = np.concatenate([np.arange(len(p[1])) for p in pages])
        cols = np.repeat(np.arange(n), [len(p[1]) for p in pages])
        length = np.repeat([len(p[1]) for p in pages], [len(p[1]) for p in pages])
        x[steps, cols, :WORD] = mean
        x[steps, cols, WORD : WORD + _SHAPES] = np.concatenate([p[2] for p in pages])
        x[steps, cols, -2], x[steps, cols, -1] = np.minimum(steps, 20) / 20, np.minimum(length - 1 - steps, 20) / 20
        mask[steps, cols] = 1
        return x, mask, (flat, sizes, steps, cols)

    def _run(self, x, mask, way, keep):
        h, g = np.zeros((x.shape[1], HIDDEN), np.float32), self.p
        c, out, saved = np.zeros_like(h), np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        z0 = x.reshape(-1, self.d) @ g["x" + way] + g["b" + way]
        z0 = z0.reshape(*x.shape[:2], -1)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = z0[t] + h @ g["h" + way]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = (f * c + i * u) * m
            tc = np.tanh(c2)
            h2 = o * tc * m
            if keep:
                saved.append((t, i, f, o, u, c, tc, h, m))
            h, c = h2, c2
            out[t] = h
        return out, saved

    def forward(self, x, mask, keep=False):
        f, sf = self._run(x, mask, "f", keep)
        b, sb = self._run(x, mask, "b", keep)
        h = np.concatenate([f, b], 2)
        return _sigmoid(h @ self.p["o"] + self.p["c"]), h, sf, sb

    def gradient(self, pages, labels):
        x, mask, (flat, sizes, steps, cols) = self.inputs(pages)
        y, h, sf, sb = self.forward(x, mask, True)
        target = np.zeros_like(mask)
        target[steps, cols] = np.concatenate(labels)
        d = (y - target) * mask / mask.sum()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"], g["c"] = np.einsum("tnh,tn->h", h, d).astype(np.float32), np.array([d.sum()], np.float32)
        dh = d[:, :, None] * self.p["o"]
        dx = np.zeros_like(x)
        for way, saved, part in (("f", sf, dh[:, :, :HIDDEN]), ("b", sb, dh[:, :, HIDDEN:])):
            back, cell = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, i, f, o, u, c, tc, hp, m in reversed(saved):
                a = (part[t] + back) * m
                cell = (cell + a * o * (1 - tc * tc)) * m
                dz = np.concatenate([cell * u * i * (1 - i), cell * c * f * (1 - f), a * tc * o * (1 - o), cell * i * (1 - u * u)], 1)
                g["x" + way] += x[t].T @ dz
                g["h" + way] += hp.T @ dz
                g["b" + way] += dz.sum(0)
                dx[t] += dz @ self.p["x" + way].T
                back, cell = dz @ self.p["h" + way].T, cell * f
        rows = dx[steps, cols, :WORD] / np.maximum(sizes, 1)[:, None]
        np.add.at(g["e"], flat, np.repeat(rows, sizes, axis=0))
        loss = -np.log(np.clip(np.where(target > 0.5, y, 1 - y), 1e-7, 1))
        return g, float((loss * mask).sum() / mask.sum())

    def fit(self, pages, labels, epochs: int = EPOCHS, rate: float = 0.01, size: int = 32, seed: int = 3) -> float:
        """Adam over the sample; returns the last mean loss."""
        rng, m, v, step, loss = np.random.default_rng(seed), {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0, 0.0
        for epoch in range(epochs):
            losses = []
            # Pages of like length together, in another order each time.
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i][1]) // 6, rng.random()))
            groups = [order[a : a + size] for a in range(0, len(order), size)]
            for k in rng.permutation(len(groups)):
                g, one = self.gradient([forgotten(pages[i], rng) if rng.random() < FORGET else pages[i] for i in groups[k]], [labels[i] for i in groups[k]])
                losses.append(one)
                step += 1
                for name, grad in g.items():
                    grad = np.clip(grad, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    v[name] = 0.999 * v[name] + 0.001 * grad * grad
                    self.p[name] -= (rate * 0.85**epoch * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss

    def label(self, pages) -> list[np.ndarray]:
        """For each page the probability of each block to be body."""
        out: list = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i][1]), key=lambda i: len(pages[i][1]))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            x, mask, _ = self.inputs([pages[i] for i in part])
            y = self.forward(x, mask)[0]
            for j, i in enumerate(part):
                out[i] = y[: len(pages[i][1]), j]
        return out


def train(pages: DataFrame, domain: str = "domain", title: str = "title", text: str = "text", key: str = "page_id") -> Labeller:
    """A labeller fitted on a sample of at most ``SITES`` sites with at most ``MOST`` pages each."""
    some = pages.where(F.col(text).isNotNull() & F.col(domain).isNotNull()).groupBy(domain).count()
    picked = [r[0] for r in some.where(F.col("count").between(FEWEST, MOST)).orderBy(F.xxhash64(domain), domain).limit(SITES).collect()]
    rows = pages.where(F.col(text).isNotNull())
    rows = rows.where(F.col(domain).isin(picked)) if picked else smallest_hashes(rows, key, SITES * FEWEST)
    sample = [(r[1] or "", r[2], r[3]) for r in rows.select(key, domain, title, text).collect() if r[3].strip()]
    sample.sort(key=lambda r: (r[0], r[2], r[1] or ""))
    judge = residue.Judge()
    labels = teach(sample)
    reader, model = Reader(), Labeller()
    read, known = [], []
    for (_, t, x), y in zip(sample, labels):
        if y and judge(t, x) is None:
            read.append(reader.page(t, x))
            known.append(np.array(y, np.float32))
    if read:
        model.fit(read, known)
    return model


def save(spark: SparkSession, model: Labeller, path: str) -> None:
    """Write a fitted labeller, a row for each of its arrays."""
    rows = [(name, list(v.shape), v.astype(np.float32).tobytes()) for name, v in model.p.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, bytes binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Labeller:
    model = Labeller()
    model.p = {r["name"]: np.frombuffer(bytes(r["bytes"]), np.float32).reshape(r["shape"]).copy() for r in spark.read.parquet(path).collect()}
    return model


def label(pages: DataFrame, model: Labeller, key: str = "page_id", title: str = "title", text: str = "text") -> DataFrame:
    """``(key, furniture, body)``: line numbers of furniture, and the text that is left.

    Null and blank texts give no row, nor do pages that hold template residue
    or, furniture aside, only a notice.  Repeated rows are labelled one by one;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model.p)
    kind = pages.schema[key].dataType.simpleString()

    def batches(rows):
        own = Labeller()
        own.p = shared.value
        reader, judge = Reader(), residue.Judge()
        for batch in rows:
            keys, titles, texts = (c.to_pylist() for c in batch.columns)
            kept = [(k, t, x) for k, t, x in zip(keys, titles, texts) if x.strip("  \t\r\n")]
            read = [reader.page(t, x) for _, t, x in kept]
            out = []
            for (k, t, x), page, y in zip(kept, read, own.label(read)):
                lines = x.split("\n")
                drop = {n for n, p in zip(page[0], y) if p < 0.5}
                found = judge(t, x)
                if found and (found[0] or found[1]):
                    continue
                if found:
                    # A notice, unless a line of the body is content.
                    content = set(found[2])
                    if not any(lines[n - 1].replace("\u00a0", " ") in content for n in page[0] if n not in drop):
                        continue
                out.append((k, sorted(drop), "\n".join(z for n, z in enumerate(lines, 1) if n not in drop)))
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.string())], names=[key, "furniture", "body"])

    return pages.where(F.col(text).isNotNull()).select(key, title, text).mapInArrow(batches, f"{key} {kind}, furniture array<int>, body string")
