"""Variant spellings of names typed by people (problem 1).

A stored name is read as a firm or a person: titles, legal forms and additions
of web pages go, words of the trade are brought to their roots, given names to
their full forms.  What is left is the core, the letters that only this entity
has.  Cores are compared by a pigeonhole segment join: a core that may have k
edits is cut into k + 1 segments, of which at least one survives; substrings of
the other cores are looked up, shifted by as many places as the edits allow, in
the inverted index of segments; pairs that meet are verified with an edit
distance banded by k.  An exchange of neighbours is one edit, but may hurt two
segments where it lies across a cut; so each core is cut in k + 1 ways whose
cuts differ, and in one of them no exchange lies across.  Linked cores form
components that no chain may stretch: what is too far from a component's hub
starts one of its own.  Within one, persons part by given name.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.runtime import bound_batches, cut

#: Legal forms, as letters only.
LEGAL = {
    "ltd": "limited", "limited": "limited", "ld": "limited", "lim": "limited", "plc": "plc", "publiclimitedcompany": "plc", "llp": "llp", "limitedliabilitypartnership": "llp", "llc": "llc",
    "inc": "incorporated", "incorporated": "incorporated", "incorp": "incorporated", "corp": "corporation", "corporation": "corporation", "co": "company", "company": "company",
    "gmbh": "gmbh", "ag": "ag", "kg": "kg", "ug": "ug", "sarl": "sarl", "sas": "sas", "sa": "sa", "sl": "sl", "srl": "srl", "bv": "bv", "nv": "nv", "ab": "ab", "oy": "oy", "as": "as", "lp": "lp", "cic": "cic",
}
#: Words of trades, with short forms that no rule derives.
TRADE = (
    "wealth advisers estate agents care homes dental practice pharmacy group skin clinic medical centre solicitors technologies retail international immigration services property management "
    "consulting consultants holdings partners associates systems solutions insurance finance financial investment investments bank banking law legal lawyers chambers surgery hospital health healthcare veterinary opticians "
    "lettings letting sales marketing media digital design studio engineering construction builders building logistics transport travel hotel hotels restaurant catering foods energy electrical plumbing motors garage school college academy training education recruitment"
).split()
SHORT = {"tech": "technologies", "techs": "technologies", "sols": "solicitors", "solrs": "solicitors", "solr": "solicitors", "med": "medical", "intl": "international", "mgt": "management", "mgmt": "management", "mngmt": "management", "svcs": "services", "ctr": "centre", "center": "centre", "advisors": "advisers", "gp": "group", "grp": "group", "hms": "homes", "carehomes": "care homes", "carehome": "care homes", "pharmacies": "pharmacy", "technologys": "technologies"}
#: Given names and their short forms.
GIVEN = (
    "anthony tony ant;christopher chris kit topher kris;edward ed eddie ted teddy ned;michael mike mick mickey micky mikey;william bill billy will willie liam;richard rick dick richie rich ricky dickie;"
    "robert rob bob bobby robbie bert;jonathan jon johnny jonny jonty;theodore theo ted teddy;deborah deb debbie debs;frederick fred freddie freddy;alexander alex alec sandy xander;andrew andy drew;benjamin ben benny benji;"
    "catherine cathy kate katie cat;charles charlie chuck chas;daniel dan danny;david dave davey;dorothy dot dotty dolly;elizabeth liz lizzie beth betty eliza betsy;eleanor ellie nell nora;francis frank frankie;"
    "gregory greg;henry harry hal hank;isabella bella izzy;jacob jake;james jim jimmy jamie;jennifer jen jenny;john jack johnny;joseph joe joey;joshua josh;katherine kathy kate katie kit kitty;kenneth ken kenny;"
    "lawrence larry laurie;leonard len lenny leo;margaret maggie meg peggy marge;matthew matt matty;nathaniel nat nate;nicholas nick nicky;patricia pat patty tricia;patrick pat paddy;peter pete;philip phil pip;"
    "rebecca becky becca;ronald ron ronnie;samuel sam sammy;samantha sam;sarah sally;stephen steve steven stevie;susan sue susie;thomas tom tommy;timothy tim timmy;victoria vicky tori;walter walt wally;zachary zach zack"
)
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame rev lord lady hon".split())
#: What pages add to a name, before it and after it.
_LEAD = re.compile(r"^\s*(?:welcome to|home\s*[-|–:]|about|official site of|contact)\s+", re.I)
_TAIL = re.compile(r"\s*(?:\||–|—|»|::| - )\s*[^|–—»]*$")
_BRACKET_PLACE = re.compile(r"\((?:uk|gb|us|usa|eu|de|fr|es|ie|europe|england|london|international|holdings)\)", re.I)

FULL = [g.split() for g in GIVEN.split(";")]
FULL_NAMES = frozenset(g[0] for g in FULL)


def _short_given() -> dict[str, tuple[str, ...]]:
    table: dict[str, list[str]] = {}
    for full, *shorts in FULL:
        for x in (full, *shorts):
            table.setdefault(x, []).append(full)
    return {k: (k,) if k in FULL_NAMES else tuple(v) for k, v in table.items()}


SHORT_GIVEN = _short_given()
_TRADE_SET = frozenset(TRADE)


def edits(length: int) -> int:
    """The edits that a core of this length may have, an exchange of neighbours being one."""
    return 3 if length >= 30 else 2 if length >= 9 else 1 if length >= 3 else 0


#: Cores below this length may differ by an exchange or a letter doubled or left out, not by another letter.
STRICT_BELOW = 5
#: Index entries of one segment key that a task takes; hotter keys are split.
HOT = 4000
#: A core must lie within so many links' edits of its component's hub; one more allows for exchanges, which count as two here.
RADIUS = 2


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("œ", "oe")


def _near(a: str, b: str, k: int) -> bool:
    """Edit distance of at most k, with neighbours exchanged as one edit; for short words."""
    if abs(len(a) - len(b)) > k:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before2, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2[j - 2] + 1)
            row.append(d)
        if min(row) > k:
            return False
    return row[-1] <= k


def _trade(w: str, dotted: bool, cache: dict) -> str | None:
    """The word of a trade that ``w`` stands for: itself, a short form of it, or mistyped."""
    key = (w, dotted)
    if key in cache:
        return cache[key]
    found = w if w in _TRADE_SET else SHORT.get(w)
    if not found and len(w) >= 2:
        for t in TRADE:
            if w[0] != t[0] and not (len(w) > 5 and len(t) > 5):
                continue
            if len(w) >= 3 and t.startswith(w) and (dotted or len(w) >= 4 or len(t) <= len(w) + 3):
                found = t
            elif w + "s" == t or t + "s" == w:
                found = t
            elif len(w) >= 4 and _near(w, t, 2 if len(t) >= 8 else 1):
                found = t
            elif 3 <= len(w) <= len(t) - 2 and w[0] == t[0] and not set(w[1:]) & set("aeiou") and _within(w, t):
                found = t
            if found:
                break
    cache[key] = found
    return found


def _within(w: str, t: str) -> bool:
    it = iter(t)
    return all(c in it for c in w)


def parse(name: str, cache: dict) -> tuple[str, str, str, str, str, str] | None:
    """``(kind, core, other order, first word of the trade, legal form, given name)``; None without a letter."""
    s = _fold(name)
    s = _LEAD.sub("", s)
    s = _BRACKET_PLACE.sub(" ", s)
    if _TAIL.search(s) and len(_TAIL.sub("", s).split()) >= 2:
        s = _TAIL.sub("", s)
    # Dotted letters are one word: "s.a r.l." and "g.m.b.h.".
    s = re.sub(r"\b(s)\.? ?(?:a|à)\.? ?(r)\.? ?(l)\b\.?", "sarl", s)
    s = re.sub(r"\b((?:[a-z]\.){2,}[a-z]?)\.*(?=\W|$)", lambda m: m[1].replace(".", ""), s)
    s = re.sub(r"\bpublic limi?t?[a-z]* compan?y\b", "plc", s).replace("int'l", "intl").replace("’", "'")
    comma = "," in s
    raw = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*\.?|\d+|,", s)
    words, trade, legal, given = [], [], "", ()
    for i, w in enumerate(raw):
        dotted, w = w.endswith("."), w.rstrip(".").replace("'", "")
        if w in ("the", "and", "n", "und", "et", "y", "of", ",", "") or w in TITLES:
            continue
        if w in LEGAL or (len(w) >= 5 and not dotted and any(len(x) > 5 and _near(w, x, 2) for x in ("limited", "incorporated"))):
            legal = LEGAL.get(w) or ("limited" if w[0] == "l" else "incorporated")
            continue
        t = _trade(w, dotted, cache)
        if t:
            trade += t.split()
            continue
        words.append(w)
    if not words:
        words, trade = trade, []
    if not words:
        return None
    firm = bool(trade or legal)
    if not firm:
        at = [i for i, w in enumerate(words) if w in SHORT_GIVEN or len(w) == 1]
        if not at and len(words) >= 2:
            # A mistyped given name stands first or, after a comma, last; of two words it must be close.
            at = [i for i in (0, len(words) - 1) if len(words[i]) > 4 and any(_near(words[i], g, 1 if len(g) < 7 or len(words) == 2 else 2) for g in FULL_NAMES)]
        if at and len(words) > 1:
            w = words.pop(at[0])
            given = SHORT_GIVEN.get(w) or ((w,) if len(w) == 1 else tuple(g for g in FULL_NAMES if _near(w, g, 1 if len(g) < 7 else 2)))
            # Middle initials part nobody.
            words = [x for x in words if len(x) > 1] or words
    kind = "p" if given else "f"
    core = "".join(words)
    other = "".join(words[1:] + words[:1]) if len(words) == 2 else ""
    return kind, core, other, trade[0] if firm and trade else "", legal, "|".join(given)


def _parse_batches(batches):
    cache: dict = {}
    for batch in batches:
        rows = [(n, *p) for n in batch.column(0).to_pylist() if (p := parse(n, cache))]
        if len(cache) > 200_000:
            cache.clear()
        cols = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["name", "kind", "core", "other", "trade", "legal", "given"])


_EDITS = "CASE WHEN {0} >= 30 THEN 3 WHEN {0} >= 9 THEN 2 WHEN {0} >= 3 THEN 1 ELSE 0 END"
#: The ways of cutting: by how many places the cuts are moved; the first k + 1 are used.
_WAYS = "slice(array(0, 1, -1, 2), 1, _k + 1)"
#: Where segment _i of a form of length _l begins that is cut into _k + 1 segments, and where the next one does.
_CUT = "IF({0} <= 1, 1, IF({0} > _k + 1, _l + 1, 1 + ({0} - 1) * (_l DIV (_k + 1)) + greatest(0, {0} - 1 - (_k + 1 - _l % (_k + 1))) + _w))"


def _segments(df: DataFrame) -> DataFrame:
    """Every segment of lengths ``_l``, in every way of cutting: its place ``_p`` and length ``_z``."""
    cut_up = df.withColumn("_w", F.explode(F.expr(_WAYS))).withColumn("_i", F.explode(F.expr("sequence(1, _k + 1)")))
    return cut_up.withColumn("_p", F.expr(_CUT.format("_i"))).withColumn("_z", F.expr(_CUT.format("(_i + 1)")) - F.col("_p")).where("_z > 0")


def _verified(pairs: DataFrame) -> DataFrame:
    """The pairs ``(id, id2, form, core, k)`` that are within k edits; most are settled by the banded distance without exchanges."""
    sure, open_ = pairs.where("levenshtein(form, core, k) >= 0"), pairs.where("levenshtein(form, core, k) < 0 and levenshtein(form, core, 2 * k) >= 0")

    def batches(parts):
        for batch in parts:
            keep = [_near(a, b, k) for a, b, k in zip(*(batch.column(c).to_pylist() for c in ("form", "core", "k")))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return sure.unionByName(open_.mapInArrow(batches, open_.schema))


def _merged(df: DataFrame) -> DataFrame:
    """Joined by a shuffle whatever the planner makes of its size: it takes an exploded table to be as small as the file that it comes from, and would send all of it through the driver."""
    return df.hint("merge")


def links(cores: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``cores(id, kind, core, other, trade)`` that are few edits apart, in either order of two words.

    Names without a trade are compared with all, others with those of their
    trade and those without one.
    """
    # The inverted index: every segment of every form, by length, place and trade.
    forms = cores.select("id", "kind", "trade", F.explode(F.array_distinct(F.filter(F.array("core", "other"), lambda x: x != ""))).alias("form"))
    groups = F.when(F.col("trade") == "", F.array(F.lit(""))).otherwise(F.array("trade", F.lit("*")))
    index = (
        _segments(forms.withColumn("_l", F.length("form")).withColumn("_k", F.expr(_EDITS.format("_l")))).withColumn("_g", F.explode(groups))
        .select("id", "form", F.col("_k"), F.expr("xxhash64(kind, _g, _l, _w, _i, substring(form, _p, _z))").alias("_key"))
    )
    # The probes: for each length and segment, the substrings that can be that segment after k edits.
    asked = F.when(F.col("trade") == "", F.array(F.lit(""), F.lit("*"))).otherwise(F.array("trade", F.lit("")))
    lengths = cores.select("id", "kind", "trade", "core").withColumn("_n", F.length("core")).withColumn("_e", F.expr(_EDITS.format("_n"))).withColumn("_l", F.explode(F.expr("sequence(greatest(1, _n - _e), _n + _e)"))).withColumn("_k", F.expr(_EDITS.format("_l")))
    probes = (
        _segments(lengths).withColumn("_d", F.expr("_n - _l"))
        .withColumn("_from", F.expr("greatest(1, _p - (_i - 1), _p + _d - (_k + 1 - _i))")).withColumn("_to", F.expr("least(_n - _z + 1, _p + (_i - 1), _p + _d + (_k + 1 - _i))"))
        .where("_from <= _to").withColumn("_at", F.explode(F.expr("sequence(_from, _to)"))).withColumn("_g", F.explode(asked))
        .select(F.col("id").alias("id2"), "core", F.col("_e"), F.expr("xxhash64(kind, _g, _l, _w, _i, substring(core, _at, _z))").alias("_key"))
    ).distinct()
    # A segment that very many cores share is split: its index entries by id, and its probes go to every part.
    index = cut(index, "segments")
    hot = index.groupBy("_key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("_parts")).where("_parts > 1")
    hot = F.broadcast(hot) if hot.limit(10_001).count() <= 10_000 else _merged(hot)
    index = index.join(hot, "_key", "left").withColumn("_part", F.pmod("id", F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    probes = probes.join(hot, "_key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    met = index.join(_merged(probes), ["_key", "_part"]).where("id <> id2").select("id", "id2", "form", "core", F.least("_k", "_e").alias("k"))
    # Short ones must have the same letters; all must share enough of them, which is cheaper to see than the distance.
    same = "IF(least(length(form), length(core)) >= {0}, true, array_sort(array_distinct(split(form, ''))) = array_sort(array_distinct(split(core, ''))))"
    met = _verified(met.where("levenshtein(form, core, 2 * k) >= 0").where(same.format(STRICT_BELOW)))
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def balls(cores: DataFrame, edges: DataFrame, most_rounds: int = 12) -> DataFrame:
    """``(id, component)`` of all ends of ``edges``, without chains.

    The hub of a component is its core with the most links, the lower id on
    ties.  Cores further from it than ``RADIUS`` links may reach are taken out
    and form components among themselves, and so on until all are near a hub.
    """
    done, left = None, cut(edges, "links")
    near = lambda a, b: F.expr(f"levenshtein({a}, {b}, {RADIUS + 1} * CASE WHEN length({a}) >= 30 THEN 3 WHEN length({a}) >= 9 THEN 2 ELSE 1 END) >= 0")
    for _ in range(most_rounds):
        found = components(left)
        degree = left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("_n"))
        hubs = found.join(_merged(degree), "id").groupBy("component").agg(F.max_by("id", F.struct("_n", -F.col("id"))).alias("_hub"))
        side = lambda p: cores.select(F.col("id").alias(f"_{p}"), F.col("core").alias(f"{p}_core"), F.col("other").alias(f"{p}_other"))
        whole = found.join(_merged(hubs), "component").join(_merged(side("hub")), "_hub").join(_merged(side("own").withColumnRenamed("_own", "id")), "id")
        whole = cut(whole.select("id", F.col("_hub").alias("component"), (near("hub_core", "own_core") | near("hub_core", "own_other") | near("hub_other", "own_core")).alias("_near")), "balls")
        kept = whole.where("_near").select("id", "component")
        done = kept if done is None else done.unionByName(kept)
        far = whole.where("not _near").select("id")
        if far.isEmpty():
            return done
        # Ends without a partner among the far ones stand alone, under their own id.
        rest = left.join(_merged(far.withColumnRenamed("id", "a")), "a", "left_semi").join(_merged(far.withColumnRenamed("id", "b")), "b", "left_semi").select("a", "b")
        done = done.unionByName(far.join(_merged(rest.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id", "left_anti").select("id", F.col("id").alias("component")))
        left = cut(rest, "links")
    raise RuntimeError(f"components did not settle around hubs within {most_rounds} rounds")


def components(edges: DataFrame, most_rounds: int = 30) -> DataFrame:
    """``(id, component)`` of all ends of ``edges(a, b)``: the least id that can be reached.

    Each round takes the least label of the neighbours and then the label's own
    label, so that a chain of n edges takes about log n rounds.
    """
    both = cut(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))), "edges")
    labels = cut(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(_merged(labels.select(F.col("id").alias("to"), "component")), "to").groupBy("id").agg(F.min("component").alias("_near"))
        less = labels.join(_merged(near), "id", "left").select("id", F.col("component").alias("_was"), F.least("component", F.coalesce("_near", "component")).alias("_c"))
        own = labels.select(F.col("id").alias("_c"), F.col("component").alias("_own"))
        new = cut(less.join(_merged(own), "_c", "left").select("id", "_was", F.least("_c", F.coalesce("_own", "_c")).alias("component")), "labels")
        labels = new.select("id", "component")
        if new.where("component <> _was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")


def entities(names: DataFrame) -> DataFrame:
    """``(name, kind, trade, entity, given)`` of the distinct names in the column ``name``.

    Names with equal ``entity`` and ``given`` belong together if their trades
    agree or one is unknown.  Nulls, and names without any letter, are left
    out; blanks at the ends make different stored names of one entity; an empty
    table gives an empty result.
    """
    bound_batches(names.sparkSession)
    spark = names.sparkSession
    # Little to read but much to compute: the tasks are not left to their sizes in bytes.
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = names.select("name").where("name is not null").distinct().repartition(tasks)
    parsed = cut(distinct.mapInArrow(_parse_batches, "name string, kind string, core string, other string, trade string, legal string, given string"), "names")
    key = F.xxhash64("kind", "core", "other", "trade")
    cores = cut(parsed.select(key.alias("id"), "kind", "core", "other", "trade").distinct().repartition(tasks), "cores")
    found = balls(cores, links(cores))
    whole = parsed.withColumn("id", key).join(_merged(found), "id", "left").withColumn("entity", F.coalesce("component", "id"))
    # Initials and shared short forms take the one full given name of their component that they fit.
    full = whole.where("kind = 'p' and length(given) > 1 and instr(given, '|') = 0").groupBy("entity").agg(F.collect_set("given").alias("_full"))
    fits = F.expr("filter(_full, x -> IF(length(given) = 1, startswith(x, given), array_contains(split(given, '[|]'), x)))")
    given = F.when((F.length("given") == 1) | (F.instr("given", "|") > 0), F.when(F.size(fits) == 1, fits[0]).otherwise(F.col("given"))).otherwise(F.col("given"))
    return whole.join(_merged(full), "entity", "left").select("name", "kind", "trade", "entity", given.alias("given"))


def members(names: DataFrame) -> DataFrame:
    """``(name, entity, given, representative)``: every stored name with one spelling that stands for its entity, the longest and then the first.

    The compact form of the result: as many rows as names, however many spellings an entity has.
    """
    e = cut(entities(names), "entities")
    chosen = e.groupBy("entity", "given").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("representative"))
    return e.join(_merged(chosen), ["entity", "given"]).select("name", "entity", "given", "representative")


def pairs(names: DataFrame) -> DataFrame:
    """``(name_a, name_b)``: every pair of different stored names of one entity, the smaller one first by code point."""
    e = cut(entities(names), "entities")
    other = e.select(F.col("name").alias("name_b"), "entity", "given", F.col("trade").alias("_trade"))
    met = e.withColumnRenamed("name", "name_a").join(_merged(other), ["entity", "given"]).where("name_a < name_b and (trade = _trade or trade = '' or _trade = '')")
    return met.select("name_a", "name_b").distinct()
