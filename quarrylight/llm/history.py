"""Deduplicating new batches against all history (problem 4).

History is a stored index of generations, each cut into segments by the hash
of what repeats of a ruling share: source, date and laws.  A segment is a shard
with a navigable small-world graph: every vector is linked with its nearest,
with those that name it, and with a few far ones.  A new row enters the shards
of its segment at the hubs closest to it and walks the graph with a beam; how
wide the beam must be is tuned for each shard against exhaustive search.  A new
batch becomes shards of its own and opens only the folders of its segments;
nothing of the history is built again until a scheduled compaction makes one
generation of the newest ones.  Every row that a walk meets and that has the
same date and laws is a candidate, and an exact comparison of firm, penalty,
number and wording decides.

Walks are approximate, so equality helps where it can: numbers of rulings, and
checksums in place of missing wordings, are joined exactly besides.

Rows that the exact comparison cannot tell apart are one profile, however many
there are, and profiles of one firm and wording one spot of the graph.  Shards
are bounded in rows, and so are the blocks of rows that ask one.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
import unicodedata
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import names
from quarrylight.runtime import bound_batches, cut, place

#: Dimensions of a vector: the bits of one hash for each feature.
DIMS = 64
#: Vectors of a shard, rows of a block that asks one, nearest and far links of a node.
SHARD_ROWS, BLOCK_ROWS, NEAREST, FAR = 8_192, 40_000, 16, 4
#: Generations that are kept before the newest are made one, and the most folders of one as a power of two.
FANOUT, SLICES_LEVEL = 6, 12
#: One row in so many is a hub, where a walk may begin.
HUB_OF = 8
#: Rows of a beam whose links are followed at once.
PICK = 4
#: Beams tried in turn until the nearest row of a sample is found as often as wanted.
BEAMS, SAMPLE, WANTED = (24, 48, 96, 192), 256, 0.99
#: The least similarity of a row that is compared exactly.
LEAST = 0.55
#: Shares of firm, date, laws with source, and wording in a vector.
WEIGHTS = (0.42, 0.2, 0.1, 0.28)
#: Similarity of two wordings of one ruling.
SAME_WORDING = 0.7

_CODE = re.compile(r"[a-z]\d\d-(\d{5,10})(?!\d)|[?&](?:id|ref|case|no|nr)=(?:[a-z]\d\d-)?(\d{5,10})(?!\d)", re.I)


def reference(url: str | None) -> str:
    """The ruling's number in an address; empty where an address names none, as lists, archives and mirrors do."""
    m = _CODE.search(url or "")
    return (m[1] or m[2]) if m else ""


def _plain_words(s: str | None) -> list[str]:
    s = "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).lower()
    return re.findall(r"[^\W_]+", s)


def _signs(feature: str, cache: dict) -> np.ndarray:
    v = cache.get(feature)
    if v is None:
        if len(cache) > 200_000:
            cache.clear()
        bits = np.unpackbits(np.frombuffer(hashlib.blake2b(feature.encode(), digest_size=DIMS // 8).digest(), np.uint8))
        v = cache[feature] = bits.astype(np.float32) * 2 - 1
    return v


def vector(core: str, date, laws, source: str, words: str, cache: dict) -> np.ndarray:
    """A unit vector in which the same ruling, however typed, comes out close."""
    # Letters in threes, bounded by none, so that exchanged or joined words change little.
    groups = [
        ["n" + core[i : i + 3] for i in range(max(1, len(core) - 2))],
        [f"d{date}"] if date is not None else [],
        [f"l{x}" for x in (laws if laws is not None else ())] + [f"s{source}"],
        ["q" + w for w in words.split()],
    ]
    out = np.zeros(DIMS, np.float32)
    for weight, features in zip(WEIGHTS, groups):
        if features:
            part = np.sum([_signs(f, cache) for f in features], axis=0)
            out += np.sqrt(weight) * part / max(1e-6, float(np.linalg.norm(part)))
    return out / max(1e-6, float(np.linalg.norm(out)))


class Graph:
    """One shard: vectors, links, hubs and the beam that its search needs."""

    def __init__(self, vectors: np.ndarray, seed: int = 7, tune: bool = True):
        self.v = vectors.astype(np.float32)
        n, rng = len(vectors), np.random.default_rng(seed)
        k = min(NEAREST, n - 1)
        near = np.zeros((n, max(k, 1)), np.int32)
        for a in range(0, n, 256) if k > 0 else ():
            s = self.v @ self.v[a : a + 256].T
            s[np.arange(a, a + s.shape[1]), np.arange(s.shape[1])] = -2
            near[a : a + 256] = np.argpartition(s.T, n - k, axis=1)[:, n - k :]
        # Links back: of those that name a node, as many again are kept.
        back = np.full((n, max(k, 1)), -1, np.int32)
        if k > 0:
            to, frm = near.ravel(), np.repeat(np.arange(n, dtype=np.int32), k)
            order = np.argsort(to, kind="stable")
            to, frm = to[order], frm[order]
            place = np.arange(len(to)) - np.searchsorted(to, to)
            keep = place < k
            back[to[keep], place[keep]] = frm[keep]
        far = rng.integers(0, n, (n, FAR), dtype=np.int32)
        self.links = np.concatenate([near, np.where(back < 0, near, back), far], axis=1)
        self.hubs = rng.choice(n, n // HUB_OF + 1, replace=False)
        self.beam, self.recall = BEAMS[0], 1.0
        if tune and n > 64:
            self._tune(rng)

    def _tune(self, rng) -> None:
        """Widen the beam until rows that are slightly changed find what exhaustive search finds."""
        at = rng.choice(len(self.v), min(SAMPLE, len(self.v)), replace=False)
        q = self.v[at] + rng.normal(0, 0.35 / np.sqrt(DIMS), (len(at), DIMS)).astype(np.float32)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        best = (q @ self.v.T).max(1)
        for beam in BEAMS:
            self.beam = beam
            found = self.search(q, 1)[1][:, 0]
            self.recall = float((found >= best - 1e-5).mean())
            if self.recall >= WANTED:
                break

    def search(self, q: np.ndarray, top: int, meet=None) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` rows closest to each query, by beams that all queries walk together.

        ``meet(queries, rows, similarities)`` is told of every row that a walk compares, whether or not it stays in the beam.
        """
        n, m, beam = len(self.v), len(q), min(max(self.beam, top), len(self.v))
        if n <= 256:
            s = q @ self.v.T
            if meet:
                meet(np.arange(m)[:, None], np.arange(n)[None], s)
            ids = np.argsort(-s, axis=1)[:, :top]
            return ids, np.take_along_axis(s, ids, 1)
        hub = q @ self.v[self.hubs].T
        if meet:
            meet(np.arange(m)[:, None], self.hubs[None], hub)
        first = np.argpartition(-hub, min(beam, hub.shape[1]) - 1, axis=1)[:, :beam]
        ids = self.hubs[first].astype(np.int32)
        sim = np.take_along_axis(hub, first, 1)
        if ids.shape[1] < beam:
            ids = np.pad(ids, ((0, 0), (0, beam - ids.shape[1])), constant_values=-1)
            sim = np.pad(sim, ((0, 0), (0, beam - sim.shape[1])), constant_values=-9)
        done = np.zeros(ids.shape, bool)
        active = np.arange(m)
        for _ in range(4 * beam):
            # The best rows of each beam that have not been visited, a few at a time.
            open_sim = np.where(done[active], -9, sim[active])
            pick = np.argpartition(-open_sim, PICK - 1, axis=1)[:, :PICK]
            worth = np.take_along_axis(open_sim, pick, 1) > -9
            going = worth.any(1)
            if not going.any():
                break
            active, pick, worth = active[going], pick[going], worth[going]
            rows = np.take_along_axis(ids[active], pick, 1)
            d = done[active]
            np.put_along_axis(d, pick, True, 1)
            done[active] = d
            new = np.where(worth[:, :, None], self.links[np.maximum(rows, 0)], -1).reshape(len(active), -1)
            s = np.einsum("id,ijd->ij", q[active], self.v[np.maximum(new, 0)])
            s[new < 0] = -9
            if meet:
                meet(active[:, None], new, s)
            ids_all = np.concatenate([ids[active], new], 1)
            sim_all = np.concatenate([sim[active], s], 1)
            done_all = np.concatenate([d, np.zeros(new.shape, bool)], 1)
            # Each row once: equal ids lie together after sorting, visited ones first.
            order = np.argsort(ids_all * 2 + ~done_all, axis=1, kind="stable")
            ids_all, sim_all, done_all = (np.take_along_axis(x, order, 1) for x in (ids_all, sim_all, done_all))
            sim_all[:, 1:][ids_all[:, 1:] == ids_all[:, :-1]] = -9
            keep = np.argpartition(-sim_all, beam - 1, axis=1)[:, :beam]
            ids[active], sim[active] = np.take_along_axis(ids_all, keep, 1), np.take_along_axis(sim_all, keep, 1)
            done[active] = np.take_along_axis(done_all, keep, 1) | (sim[active] <= -9)
        order = np.argsort(-sim, axis=1)[:, :top]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)


def _same_firm(a: tuple, b: tuple) -> bool:
    """Of two firms as ``(kind, core, other order, trade, given names)``; nameless rows agree with each other."""
    if not (a[0] and b[0]):
        return a == b
    if a[0] != b[0] or (a[3] and b[3] and a[3] != b[3]):
        return False
    k = 2 * max(names.edits(len(a[1])), names.edits(len(b[1])))
    if not any(x and y and names._near(x, y, k) for x in a[1:3] for y in b[1:3]):
        return False
    if a[0] == "p":
        x, y = set(a[4].split("|")), set(b[4].split("|"))
        return bool(x & y) or any(len(p) == 1 and any(q.startswith(p) for q in t) for p, t in ((a[4], y), (b[4], x)))
    return True


def _wording(a: list[str], b: list[str]) -> float:
    """The shared part of the shorter wording: passages may be left out, words changed."""
    if not a or not b:
        return -1.0
    ca, cb = {}, {}
    for w in a:
        ca[w] = ca.get(w, 0) + 1
    for w in b:
        cb[w] = cb.get(w, 0) + 1
    return sum(min(n, cb.get(w, 0)) for w, n in ca.items()) / min(len(a), len(b))


#: What a ruling is told by, once row and batch are set aside.
_PROFILE = ("key", "guard", "kind", "core", "other", "trade", "given", "words", "quoted", "penalty", "ref", "seal")
_FIRM = ("kind", "core", "other", "trade", "given")


def _hashed(*columns: str):
    return F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns))


def shaped(actions: DataFrame) -> DataFrame:
    """Each row as ``(row_id, order, batch, key, guard, firm, words, quoted, penalty, ref, mark, seal)``.

    ``key`` and ``guard`` are hashes of source, date and laws, which repeats of
    a ruling share.  The firm is read once here, and a wording becomes its
    sorted words.  ``seal`` is the checksum where nothing else tells rows apart.
    """
    mark = F.lower(F.regexp_extract(F.coalesce("sha256", F.lit("")), "([0-9a-fA-F]{64})", 1))
    code = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)[a-z]\d\d-(\d{5,10})(?!\d)", 1), F.lit("")), F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)[?&](?:id|ref|case|no|nr)=(?:[a-z]\d\d-)?(\d{5,10})(?!\d)", 1))
    laws = F.array_sort(F.array_distinct(F.coalesce("law_ids", F.array().cast("array<string>"))))
    case = F.struct(F.coalesce("source", F.lit("")), F.coalesce(F.col("decision_date").cast("string"), F.lit("\u0000")), F.array_join(laws, "\u0001", "\u0000"))
    rows = actions.select(
        "row_id", (F.col("batch_no").cast("long") * F.lit(1 << 44) + F.col("row_id")).alias("order"), F.col("batch_no").cast("int").alias("batch"), F.xxhash64(case).alias("key"), F.hash(case).alias("guard"),
        F.col("decision_date").cast("string").alias("date"), F.coalesce("source", F.lit("")).alias("source"), laws.alias("laws"), "entity_name", "offending_quote", F.when(~F.isnan(F.col("penalty_amount").cast("double")), F.col("penalty_amount").cast("double")).alias("penalty"), code.alias("ref"), mark.alias("mark"),
    )

    def batches(parts):
        parsed: dict = {}
        for batch in parts:
            firms = [names.parse(n or "", parsed) or ("", (n or "").lower(), "", "", "", "") for n in batch.column("entity_name").to_pylist()]
            quotes = batch.column("offending_quote").to_pylist()
            if len(parsed) > 200_000:
                parsed.clear()
            made = {
                "kind": [f[0] for f in firms], "core": [f[1] for f in firms], "other": [f[2] for f in firms], "trade": [f[3] for f in firms], "given": [f[5] for f in firms],
                "words": [" ".join(sorted(_plain_words(q))) for q in quotes], "quoted": [bool(q) for q in quotes],
            }
            kept = [c for c in batch.schema.names if c not in ("entity_name", "offending_quote")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v, pa.bool_() if k == "quoted" else pa.string()) for k, v in made.items())], names=[*kept, *made])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("entity_name", "offending_quote"))
    made = rows.mapInArrow(batches, f"{kept}, kind string, core string, other string, trade string, given string, words string, quoted boolean")
    return made.withColumn("seal", F.when((F.col("words") == "") & F.col("quoted") & (F.col("ref") == ""), F.col("mark")).otherwise(""))


def _vectors(spots: DataFrame) -> DataFrame:
    def made(batches):
        cache: dict = {}
        for batch in batches:
            of = (batch.column(c).to_pylist() for c in ("core", "date", "laws", "source", "words"))
            v = [np.clip(np.rint(vector(*x, cache) * 254), -127, 127).astype(np.int8).tobytes() for x in zip(*of)]
            yield pa.RecordBatch.from_arrays([batch.column("spot"), batch.column("key"), pa.array(v, pa.binary())], names=["spot", "key", "vector"])

    return spots.mapInArrow(made, "spot long, key long, vector binary")


def _pack(v) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.int8) for x in v]).astype(np.float32) / 254


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("spot")
    g = Graph(_pack(pdf["vector"]))
    return pd.DataFrame([{
        "segment": pdf["segment"].iloc[0], "part": pdf["part"].iloc[0], "beam": g.beam, "recall": g.recall, "ids": pdf["spot"].to_numpy(np.int64).tobytes(), "keys": pdf["key"].to_numpy(np.int64).tobytes(),
        "vectors": b"".join(pdf["vector"]), "links": g.links.astype(np.uint16 if len(pdf) <= 65_536 else np.int32).tobytes(), "hubs": g.hubs.astype(np.int32).tobytes(),
    }])


_GRAPH = "segment long, part int, beam int, recall double, ids binary, keys binary, vectors binary, links binary, hubs binary"


def _search(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    none = pd.DataFrame({"asked": np.zeros(0, np.int64), "met": np.zeros(0, np.int64)})
    if not len(asked) or not len(shard):
        return none
    row = shard.iloc[0]
    ids = np.frombuffer(row["ids"], np.int64)
    g = Graph.__new__(Graph)
    g.v = np.frombuffer(row["vectors"], np.int8).reshape(len(ids), DIMS).astype(np.float32) / 254
    g.links = np.frombuffer(row["links"], np.uint16 if len(ids) <= 65_536 else np.int32).reshape(len(ids), -1).astype(np.int32)
    g.hubs, g.beam = np.frombuffer(row["hubs"], np.int32), int(row["beam"])
    keys, out = np.frombuffer(row["keys"], np.int64), []
    for a in range(0, len(asked), 1024):
        part = asked.iloc[a : a + 1024]
        own, spots, met = part["key"].to_numpy(np.int64), part["spot"].to_numpy(np.int64), []

        def meet(queries, rows, sim):
            i, j = np.nonzero((sim >= LEAST) & (own[queries] == keys[rows]))
            met.append(pd.DataFrame({"asked": spots[np.broadcast_to(queries, sim.shape)[i, j]], "met": ids[np.broadcast_to(rows, sim.shape)[i, j]]}))

        g.search(_pack(part["vector"]), 1, meet)
        found = pd.concat(met)
        out.append(found[found["asked"] != found["met"]].drop_duplicates())
    return pd.concat(out) if out else none


def _fits(known, value, left: bool):
    """Codes of which two sides share exactly one if their values are equal or one is unknown, and none otherwise."""
    code = F.concat(F.lit("K"), value.cast("string"))
    return F.when(known, F.array(code, F.lit("R" if left else "N"))).otherwise(F.array(F.lit("N")) if left else F.array(F.lit("N"), F.lit("R")))


def _sided(df: DataFrame, left: bool) -> DataFrame:
    """Rows with the codes ``_p`` of penalty and ``_r`` of ruling number, to be joined with the other side's."""
    df = df.withColumn("_p", F.explode(_fits(F.col("penalty").isNotNull(), F.col("penalty"), left)))
    return df.withColumn("_r", F.explode(_fits(F.col("ref") != "", F.col("ref"), left)))


def same_ruling(pairs: DataFrame) -> DataFrame:
    """``(a, b)`` of ``pairs(a, b, marked, _a, _b)`` that are one ruling on one firm: the exact comparison.

    Source, date, laws, penalties and numbers are joined on before; here firms
    must agree, and wordings unless both have the same number.  Where a wording
    is missing on one side only, the checksum must agree (``marked``).
    """

    def exact(batches):
        firms: dict = {}
        for batch in batches:
            a, b = batch.column("_a").to_pylist(), batch.column("_b").to_pylist()
            keep = []
            for x, y, marked in zip(a, b, batch.column("marked").to_pylist()):
                k = (*(x[c] for c in _FIRM), *(y[c] for c in _FIRM))
                one = firms.get(k)
                if one is None:
                    if len(firms) > 300_000:
                        firms.clear()
                    one = firms[k] = _same_firm(*((f["kind"], f["core"], f["other"], f["trade"], f["given"]) for f in (x, y)))
                if one and not (x["ref"] and y["ref"]):
                    p, q = x["words"].split(), y["words"].split()
                    one = _wording(p, q) >= SAME_WORDING if p and q else marked or not (x["quoted"] or y["quoted"])
                keep.append(one)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return pairs.mapInArrow(exact, "a long, b long")


class History:
    """The stored index over everything accepted so far, in a folder that all executors share.

    A generation is what one call of ``add`` brought, or what a compaction made
    of several: its profiles, checksums, vectors and graphs, cut by the hash of
    source, date and laws into 2 ** level segments of about ``shard_rows``
    vectors.  A new row asks, in each generation, the one segment that its key
    falls into; folders of other segments are not opened.  So a batch costs by
    its own size and the number of generations, not by the rows of the history.
    A key with more vectors than a shard holds has several parts.

    The manifest has one line for each generation and is replaced last: a call
    that fails leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, folder: str, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, fanout: int = FANOUT):
        self.spark, self.folder, self.shard_rows, self.block_rows, self.fanout = spark, folder, shard_rows, block_rows, fanout
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        done = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop.Path(f"{folder}/manifest-*/_SUCCESS"))
        versions = sorted(int(x.getPath().getParent().getName().rsplit("-", 1)[1]) for x in done or [])
        self.version = versions[-1] if versions else 0
        self.generations = [json.loads(r["value"]) for r in spark.read.text(f"{folder}/manifest-{self.version}").collect()] if versions else []
        self.near: DataFrame | None = None

    def _commit(self, generations: list[dict]) -> None:
        self.spark.createDataFrame([(json.dumps(g),) for g in generations], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.version + 1}")
        self.generations, self.version = generations, self.version + 1

    def _read(self, generation: dict, what: str, schema: str, slices: list[int] | None = None) -> DataFrame:
        df = self.spark.read.schema(f"{schema}, slice int").parquet(f"{self.folder}/{generation['name']}/{what}")
        return (df.where(F.col("slice").isin(slices)) if slices is not None else df).drop("slice")

    def _write(self, name: str, what: str, df: DataFrame, slices: int, key: str = "key") -> None:
        df = df.withColumn("slice", F.pmod(F.col(key), F.lit(slices)).cast("int"))
        df.repartition(min(slices, 400), "slice").write.partitionBy("slice").option("compression", "zstd").parquet(f"{self.folder}/{name}/{what}")

    def _level(self, spots: DataFrame) -> tuple[int, int]:
        n = spots.count()
        level = max(0, math.ceil(math.log2(max(1.0, n / self.shard_rows))))
        return level, n

    def _store(self, name: str, profiles: DataFrame, marks: DataFrame, spots: DataFrame, links: list[str], members: list[str]) -> dict:
        """Write a generation's tables and graphs; every row of it is indexed."""
        level, n = self._level(spots)
        slices = 1 << min(level, SLICES_LEVEL)
        self._write(name, "profiles", profiles.select("node", "digest", "digest2", *_PROFILE, "spot"), slices)
        self._write(name, "marks", marks.select("node", "key", "mark"), slices)
        self._write(name, "spots", spots.select("spot", "key", "vector"), slices)
        cut_up = self._read({"name": name}, "spots", "spot long, key long, vector binary").withColumn("segment", F.pmod(F.col("key"), F.lit(1 << level)))
        # A segment outgrows a shard where many vectors share a key; it is parted by the vector.
        parts = cut_up.groupBy("segment").agg(F.ceil(F.count("*") / (2 * self.shard_rows)).cast("int").alias("_parts"))
        cut_up = cut_up.join(parts, "segment").withColumn("part", F.pmod(F.col("spot"), F.col("_parts")).cast("int")).select("segment", "part", "spot", "key", "vector")
        tasks = max(12, min(4000, 2 * (n // self.shard_rows + 1)))
        graphs = cut_up.repartition(tasks, "segment", "part").groupBy("segment", "part").applyInPandas(_build, _GRAPH)
        graphs.withColumn("slice", F.pmod(F.col("segment"), F.lit(slices)).cast("int")).write.partitionBy("slice").option("compression", "zstd").parquet(f"{self.folder}/{name}/graphs")
        return {"name": name, "level": level, "slices": slices, "spots": n, "links": links, "members": members}

    def _touched(self, spots: DataFrame) -> dict[str, list[int]]:
        """The folders of each generation that the keys fall into; at most ``2 ** SLICES_LEVEL`` numbers."""
        finest = max((g["slices"] for g in self.generations), default=1)
        mine = [r[0] for r in spots.select(F.pmod(F.col("key"), F.lit(finest)).cast("int")).distinct().collect()]
        return {g["name"]: sorted({x % g["slices"] for x in mine}) for g in self.generations}

    def _meetings(self, spots: DataFrame, fresh: dict, touched: dict[str, list[int]]) -> DataFrame:
        """``(asked, met)``: spots of one key that a walk compares, in the shards of all generations."""
        asked, sides, shards = [], [], 0
        for i, g in enumerate([*self.generations, fresh]):
            asked.append(F.struct(F.lit(i).alias("gen"), F.pmod(F.col("key"), F.lit(1 << g["level"])).alias("segment")))
            sides.append(self._read(g, "graphs", _GRAPH, touched.get(g["name"])).withColumn("gen", F.lit(i)))
            shards += g["spots"] // self.shard_rows + 1
        sides = functools.reduce(DataFrame.unionByName, sides)
        questions = spots.select("spot", "key", "vector", F.explode(F.array(*asked)).alias("_a")).select("spot", "key", "vector", "_a.*")
        # Questions of one segment go in blocks of bounded size, each to every part of it.
        blocks = questions.groupBy("gen", "segment").agg(F.ceil(F.count("*") / self.block_rows).cast("int").alias("_blocks"))
        questions = questions.join(blocks, ["gen", "segment"]).join(sides.select("gen", "segment", (F.col("part") + 0).alias("part")), ["gen", "segment"]).withColumn("block", F.pmod(F.col("spot"), F.col("_blocks")).cast("int")).drop("_blocks")
        sides = sides.join(blocks, ["gen", "segment"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
        # Little to read but much to compute: the tasks are not left to their sizes in bytes.
        at, tasks = ["gen", "segment", "part", "block"], max(12, min(4000, 2 * shards))
        return questions.repartition(tasks, *at).groupBy(*at).cogroup(sides.repartition(tasks, *at).groupBy(*at)).applyInPandas(_search, "asked long, met long")

    def add(self, rows: DataFrame) -> dict:
        """Check a batch against the history and itself, and make it part of the history; returns its line of the manifest."""
        bound_batches(self.spark)
        name = f"g{self.version:06d}-{uuid.uuid4().hex[:8]}"
        rows = cut(shaped(rows), "rows")
        rows = rows.withColumn("digest", F.xxhash64(_hashed(*_PROFILE))).withColumn("digest2", F.hash(_hashed(*_PROFILE)))
        spot = F.xxhash64("key", "core", "words")
        profiles = cut(rows.groupBy("digest", "digest2").agg(F.min("order").alias("node"), *(F.first(c).alias(c) for c in (*_PROFILE, "date", "laws", "source"))).withColumn("spot", spot), "profiles")
        of = profiles.select("digest", "digest2", "node")
        members = rows.select("digest", "digest2", "order", "row_id").join(of, ["digest", "digest2"]).select("node", "order", "row_id")
        members.write.option("compression", "zstd").parquet(f"{self.folder}/{name}/members")
        marks = rows.where("mark <> ''").select("digest", "digest2", "key", "mark").distinct().join(of, ["digest", "digest2"]).select("node", "key", "mark")
        spots = cut(_vectors(profiles.groupBy("spot", "key").agg(*(F.first(c).alias(c) for c in ("core", "date", "laws", "source", "words")))), "spots")
        fresh = self._store(name, profiles, marks, spots, [f"{name}/links"], [f"{name}/members"])
        touched = self._touched(spots)
        self.near = cut(self._meetings(spots, fresh, touched), "near")
        self._links(fresh, touched).write.option("compression", "zstd").parquet(f"{self.folder}/{name}/links")
        self._commit([*self.generations, fresh])
        if len(self.generations) > self.fanout:
            self.compact()
        return fresh

    def _links(self, fresh: dict, touched: dict[str, list[int]]) -> DataFrame:
        """``(a, b)``: profiles of the batch with those of the history or of the batch that are the same ruling."""
        mine = self._read(fresh, "profiles", _STORED)
        old = [self._read(g, "profiles", _STORED, touched[g["name"]]) for g in self.generations]
        every = functools.reduce(DataFrame.unionByName, old, mine)
        # Along the walks: spots that met, and each with itself.  Only numbers move here; what is compared is fetched for the pairs that are left.
        met = self.near.select(F.col("asked").alias("s"), F.col("met").alias("t")).unionByName(mine.select(F.col("spot").alias("s"), F.col("spot").alias("t"))).distinct()
        left = _sided(mine.select(F.col("spot").alias("s"), F.col("node").alias("a"), "guard", "penalty", "ref"), True).select("s", "a", "guard", "_p", "_r")
        right = _sided(every.select(F.col("spot").alias("t"), F.col("node").alias("b"), "guard", "penalty", "ref"), False).select("t", "b", "guard", "_p", "_r")
        walked = met.join(left, "s").join(right, ["t", "guard", "_p", "_r"]).where("a <> b").select("a", "b", F.lit(False).alias("marked"))
        # What equality can settle no walk may miss: numbers of rulings, each spelling of a firm once.
        group = ["key", "guard", "ref", *_FIRM, "penalty"]
        numbered = every.where("ref <> ''").groupBy(*group).agg(F.min("node").alias("b"))
        asking = _sided(mine.where("ref <> ''").groupBy(*group).agg(F.min("node").alias("a")), True).where("startswith(_r, 'K')").select("key", "guard", "_r", "_p", "a")
        numbers = asking.join(_sided(numbered, False).where("startswith(_r, 'K')").select("key", "guard", "_r", "_p", "b"), ["key", "guard", "_r", "_p"]).where("a <> b").select("a", "b", F.lit(False).alias("marked"))
        # And checksums, where one side has no wording.
        own_marks = self._read(fresh, "marks", "node long, key long, mark string")
        marks = functools.reduce(DataFrame.unionByName, [self._read(g, "marks", "node long, key long, mark string", touched[g["name"]]) for g in self.generations], own_marks)
        side = lambda df, m, left, p: _sided(m.join(df.select("node", "guard", "penalty", "ref"), "node"), left).select("key", "mark", "guard", "_p", "_r", F.col("node").alias(p))
        silent = lambda df: df.where("words = ''")
        on = ["key", "mark", "guard", "_p", "_r"]
        sealed = side(silent(mine), own_marks, True, "a").join(side(every, marks, False, "b"), on).unionByName(side(mine, own_marks, True, "a").join(side(silent(every), marks, False, "b"), on)).where("a <> b").select("a", "b", F.lit(True).alias("marked"))
        # Walks of both ends and the three channels may name a pair more than once; it is compared once.
        named = walked.unionByName(numbers).unionByName(sealed).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("marked").alias("marked"))
        pairs = self._held(named, every)
        # Profiles that the comparison cannot tell apart hang on the first of them, however many there are.
        told = lambda df: df.where("ref <> ''").select("node", F.xxhash64(_hashed(*group)).alias("_h"), F.hash(_hashed(*group)).alias("_g"))
        first = lambda df, *on: df.groupBy(*on).agg(F.min("node").alias("a"))
        star = told(mine).join(first(told(every), "_h", "_g"), ["_h", "_g"]).select("a", F.col("node").alias("b"))
        if old:
            again = first(functools.reduce(DataFrame.unionByName, old), "digest", "digest2")
            star = star.unionByName(mine.select("digest", "digest2", F.col("node").alias("b")).join(again, ["digest", "digest2"]).select("a", "b"))
        return same_ruling(pairs).unionByName(star.where("a <> b")).distinct()

    @staticmethod
    def _held(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
        """The pairs ``(a, b, marked)`` with what is compared of each end; written first, so that its size is known to the joins."""
        named = cut(pairs, "pairs")
        held = profiles.select("node", F.struct(*_FIRM, "words", "quoted", "ref").alias("_x"))
        one = named.join(held.withColumnRenamed("node", "a").withColumnRenamed("_x", "_a"), "a")
        return one.join(held.withColumnRenamed("node", "b").withColumnRenamed("_x", "_b"), "b").select("a", "b", "marked", "_a", "_b")

    def compact(self) -> None:
        """Make one generation of the newest ones, as many as are together no larger than twice the one before them.

        The rows move and their graphs are built again; older, larger
        generations stay as they are, so each row is moved about as often as
        the history doubles.
        """
        some = [self.generations[-1]]
        for g in reversed(self.generations[:-1]):
            if len(some) > 1 and g["spots"] > 2 * sum(x["spots"] for x in some):
                break
            some.insert(0, g)
        if len(some) < 2:
            return
        name = f"g{self.version:06d}-{uuid.uuid4().hex[:8]}"
        union = lambda what, schema: functools.reduce(DataFrame.unionByName, [self._read(g, what, schema) for g in some])
        spots = cut(union("spots", "spot long, key long, vector binary").dropDuplicates(["spot", "key"]), "spots")
        made = self._store(name, union("profiles", _STORED), union("marks", "node long, key long, mark string"), spots, [x for g in some for x in g["links"]], [x for g in some for x in g["members"]])
        self._commit([*(g for g in self.generations if g not in some), made])

    def links(self) -> DataFrame:
        return self.spark.read.schema("a long, b long").parquet(*(f"{self.folder}/{x}" for g in self.generations for x in g["links"]))

    def members(self) -> DataFrame:
        return self.spark.read.schema("node long, order long, row_id long").parquet(*(f"{self.folder}/{x}" for g in self.generations for x in g["members"]))

    def repeats(self) -> DataFrame:
        """``(first_row_id, row_id)`` of every row so far that reports a decision again."""
        groups = names.components(self.links())
        whole = self.members().join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("_first", F.coalesce("component", "node"))
        return whole.where("order <> _first").select((F.col("_first").bitwiseAND(F.lit((1 << 44) - 1))).alias("first_row_id"), "row_id")


_STORED = "node long, digest long, digest2 int, key long, guard int, kind string, core string, other string, trade string, given string, words string, quoted boolean, penalty double, ref string, seal string, spot long"


def _new_history(spark: SparkSession, **k) -> History:
    return History(spark, place(spark, "history"), **k)


def repeats(actions: DataFrame, **k) -> DataFrame:
    """``(first_row_id, row_id)``: each row that reports a decision again, with the earliest row of that decision.

    The batches before the newest are loaded as history, then the newest is
    checked against it.  Rows are ordered by batch and row id.  Null names,
    dates, quotes, laws or sources agree with nothing but nulls, null penalties
    with any; exact copies are always repeats; an empty table gives an empty
    result; other columns are ignored.
    """
    index = _new_history(actions.sparkSession, **k)
    newest = actions.agg(F.max("batch_no")).first()[0]
    index.add(actions.where(F.col("batch_no") < F.lit(newest)) if newest is not None else actions)
    if newest is not None:
        index.add(actions.where(F.col("batch_no") == F.lit(newest)))
    return index.repeats()


def accepted(actions: DataFrame) -> DataFrame:
    """The rows that report a new decision, batch by batch."""
    return actions.join(repeats(actions).select("row_id"), "row_id", "left_anti")


def measured_recall(actions: DataFrame, every: int = 20) -> DataFrame:
    """Recall of the graphs on true repeats: rows whose id is divisible by ``every`` ask all rows.

    The truth is every pair of profiles of one source, date and laws that the
    exact comparison accepts by its wording, looked for without any graph.
    ``walked`` counts those that the walks met; ``linked`` those that the index
    links, numbers and checksums included.
    """
    index = _new_history(actions.sparkSession)
    made = index.add(actions)
    profiles = index._read(made, "profiles", _STORED)
    asked = index.members().where(F.col("row_id") % every == 0).select("node").distinct()
    held = F.struct(*_FIRM, "words", "quoted", F.lit("").alias("ref"))
    left = _sided(profiles.join(asked, "node").where("words <> ''").select("key", "guard", F.col("node").alias("a"), "penalty", "ref", held.alias("_a")), True).select("key", "guard", "_p", "_r", "a", "_a")
    right = _sided(profiles.where("words <> ''").select("key", "guard", F.col("node").alias("b"), "penalty", "ref", held.alias("_b")), False).select("key", "guard", "_p", "_r", "b", "_b")
    # A stated query set against all rows, joined on the key.
    truth = same_ruling(left.join(right, ["key", "guard", "_p", "_r"]).where("a <> b").select("a", "b", F.lit(False).alias("marked"), "_a", "_b")).distinct()
    spots = profiles.select("node", "spot")
    both = truth.join(spots.toDF("a", "s"), "a").join(spots.toDF("b", "t"), "b")
    met = index.near.select("asked", "met").unionByName(index.near.select(F.col("met").alias("asked"), F.col("asked").alias("met"))).distinct()
    met = met.toDF("s", "t").withColumn("_met", F.lit(True))
    groups = names.components(index.links())
    g = lambda p, q: groups.select(F.col("id").alias(p), F.col("component").alias(q))
    whole = both.join(met, ["s", "t"], "left").join(g("a", "_ca"), "a", "left").join(g("b", "_cb"), "b", "left")
    hit = (F.col("s") == F.col("t")) | F.coalesce("_met", F.lit(False))
    other = F.col("s") != F.col("t")
    return whole.agg(F.count("*").alias("pairs"), F.count_if(hit).alias("walked"), F.count_if(F.col("_ca") == F.col("_cb")).alias("linked"), F.count_if(other).alias("differing"), (F.try_divide(F.count_if(hit & other), F.count_if(other))).alias("recall"))
