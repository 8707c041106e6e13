"""Operators that join, mix and score: names, history, leakage, mixing, stuffing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import history, leakage, mixing, names, stuffing

# -- names


def found_pairs(spark, values):
    df = spark.createDataFrame([(v, "clash") for v in values], "name string, core string")
    return {tuple(r) for r in names.pairs(df).collect()}


SAME = ["Balvuxtus-Keddatlut Solicitors PLC", "BALVUXTUS & KEDDATLUT SOLRS", "Balvuxtuskeddatlut Solicitors P.L.C.", "Keddatlut Balvuxtus Solicitors plc", "Solicitors, Balvuxtus Kedatlut (PLC)", "Bálvuxtus-Keddatlut Solicitors PLC | Duncombe", " Balvuxtus-Keddatlut Solicitors PLC"]


def test_spellings_of_one_firm(spark):
    other = ["Balvuxtus-Wankofris Property Management", "Pizgitger Wemnovjag Retail International", None, "", "123"]
    want = {(a, b) for a in SAME for b in SAME if a < b}
    assert found_pairs(spark, SAME + other + SAME) == want


def test_persons_and_their_relatives(spark):
    got = found_pairs(spark, ["Michael Kednovkam-Suzkedbal", "KEDNOVKAM SUZKEDBAL Mick", "M. Kednovkam-Suzkedbal", "Deborah Kednovkam-Suzkedbal", "Debbie Kednovkam Suzkedbal"])
    assert got == {tuple(sorted(p)) for p in [("Michael Kednovkam-Suzkedbal", "KEDNOVKAM SUZKEDBAL Mick"), ("Michael Kednovkam-Suzkedbal", "M. Kednovkam-Suzkedbal"), ("KEDNOVKAM SUZKEDBAL Mick", "M. Kednovkam-Suzkedbal"), ("Deborah Kednovkam-Suzkedbal", "Debbie Kednovkam Suzkedbal")]}


def edit(a, b):
    """Edit distance with an exchange of neighbours as one edit, each letter touched once."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_segment_join_finds_every_close_pair(spark, monkeypatch):
    rnd = random.Random(3)
    cores = []
    for _ in range(60):
        base = "".join(rnd.choices("abcd", k=rnd.choice((3, 6, 10, 18, 32))))
        for _ in range(3):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                k, op = rnd.randrange(len(w)), rnd.randrange(4)
                w[k : k + 1] = [[], [rnd.choice("abcd")], [w[k], rnd.choice("abcd")], [w[k]]][op]
                if op == 3 and k + 1 < len(w):
                    w[k], w[k + 1] = w[k + 1], w[k]
                w = w or ["a"]
            cores.append("".join(w))
    data = spark.createDataFrame([(i, "f", c, "", "") for i, c in enumerate(cores)], "id long, kind string, core string, other string, trade string")
    close = lambda a, b: edit(a, b) <= min(names.edits(len(a)), names.edits(len(b))) and (min(len(a), len(b)) >= names.STRICT_BELOW or set(a) == set(b))
    want = {(i, j) for i, a in enumerate(cores) for j, b in enumerate(cores) if i < j and close(a, b)}
    assert {tuple(r) for r in names.links(data).collect()} == want
    # Hot segments that are split find the same.
    monkeypatch.setattr(names, "HOT", 2)
    assert {tuple(r) for r in names.links(data).collect()} == want


def test_typing_slips(spark):
    pairs = [("Smith Dental", "Smtih Dental"), ("Lee Dental", "Leee Dental"), ("Michael Brown", "Micheal Brown")]
    assert found_pairs(spark, [x for p in pairs for x in p] + ["Leo Dental", "Smythe Dental", "Michelle Green"]) == set(pairs)


def test_recall_on_names_that_no_list_holds(spark):
    """Firms of made-up trades and persons of made-up surnames, each mistyped in one place."""
    rnd = random.Random(11)
    syllable = lambda: rnd.choice("bcdfghjklmnprstvw") + rnd.choice("aeiou")
    word = lambda n: "".join(syllable() for _ in range(n)).title()

    def slip(x):
        k = rnd.randrange(1, len(x) - 2)
        return [x[:k] + x[k + 1 :], x[:k] + x[k] + x[k:], x[:k] + x[k + 1] + x[k] + x[k + 2 :], x[:k] + rnd.choice("aeiou") + x[k + 1 :]][rnd.randrange(4)]

    want = set()
    for i in range(120):
        name = f"{word(3)} {word(2)} Kontor" if i % 2 else f"{rnd.choice(['Michael', 'Deborah', 'Edward'])} {word(4)}"
        first, rest = name.split(" ", 1)
        other = f"{slip(first)} {rest}" if i % 3 == 0 else f"{first} {slip(rest)}"
        if other != name:
            want.add(tuple(sorted((name, other))))
    got = found_pairs(spark, [x for p in want for x in p])
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_no_chain_outgrows_its_hub(spark):
    """Each core is one edit from the next; a component reaches no further than two links from its hub."""
    letters = "bcdfghjklmnp"
    cores = ["".join("z" if j < i else c for j, c in enumerate(letters)) for i in range(len(letters) + 1)]
    df = spark.createDataFrame([(i, "f", c, "", "") for i, c in enumerate(cores)], "id long, kind string, core string, other string, trade string")
    got = {r.id: r.component for r in names.balls(df, names.links(df)).collect()}
    assert set(got) == set(range(len(cores))) and len(set(got.values())) > 1
    assert all(edit(cores[i], cores[h]) <= (names.RADIUS + 1) * 2 for i, h in got.items())


def test_members_are_as_many_as_names(spark):
    got = names.members(spark.createDataFrame([(x,) for x in SAME], "name string")).collect()
    assert len(got) == len(SAME) and {r.representative for r in got} == {"Bálvuxtus-Keddatlut Solicitors PLC | Duncombe"}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, names.components(edges).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    assert names.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_names_send_only_the_counted_hot_segments_to_every_executor(spark, monkeypatch):
    """The planner takes exploded tables to be as small as their files, so that each join could pass through the driver."""
    plans, cut = [], names.cut
    monkeypatch.setattr(names, "cut", lambda df, label: (plans.append(df), cut(df, label))[1])
    data = spark.createDataFrame([(x,) for x in SAME], "name string")
    plans += [names.pairs(data), names.members(data)]
    joins = [x.strip() for df in plans for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
    assert any("SortMergeJoin" in x for x in joins)
    assert not [x for x in joins if "BroadcastHashJoin [_key#" not in x and "Broadcast" in x]
    assert not [x for x in joins if "Broadcast" in x and "LeftOuter" not in x]


def test_names_of_empty_table_and_long_name(spark):
    assert found_pairs(spark, []) == set()
    assert found_pairs(spark, ["x" * 20_000 + " Limited", "y Limited"]) == set()


# -- history

ACTIONS = "row_id long, batch_no int, id string, source string, law_ids array<string>, entity_name string, offending_quote string, decision_date string, penalty_amount double, url string, sha256 string, node string"


def action(i, batch, name="Balvux Keddat Solicitors PLC", quote="We never lose a case on lease extensions from just one pound a month", date="2024-01-02", url="https://x/2024/k24-1300001", penalty=5.0, laws=("A", "B"), sha=None, source="S"):
    return (i, batch, f"id{i}", source, list(laws) if laws is not None else None, name, quote, date, penalty, url, sha, "clash")


def repeated(spark, data, **k):
    return sorted(map(tuple, history.repeats(spark.createDataFrame(data, ACTIONS), **k).collect()))


def test_the_same_decision_in_other_shape(spark):
    data = [
        action(1, 1), action(2, 1), action(3, 2, name="BALVUX & KEDDAT SOLRS P.L.C.", url="http://x/decision?id=1300001", quote=None), action(4, 2, url="https://x/archive/item-4", quote="WE NEVER LOSE A CASE […] lease extensions from just one pound a month", penalty=None),
        action(5, 2, url="https://x/2024/k24-1300002", quote="Guaranteed results on holiday lets for everyone"), action(6, 3, date="2024-01-03", url="https://x/latest"), action(7, 3, name="Pizgit Wemnov Retail Limited", url="https://x/latest"),
    ]
    assert repeated(spark, data) == [(1, 2), (1, 3), (1, 4)]
    left = history.accepted(spark.createDataFrame(data, ACTIONS))
    assert sorted(r.row_id for r in left.collect()) == [1, 5, 6, 7]


def test_order_is_batch_then_row_and_nulls_do_not_crash(spark):
    data = [action(9, 1), action(2, 2), (5, 2, None, None, None, None, None, None, None, None, None, None), (6, 2, None, None, None, None, None, None, None, None, None, None), action(11, 3, quote="q " * 20_000, url=None, date="1999-01-01")]
    assert repeated(spark, data) == [(5, 6), (9, 2)]
    assert repeated(spark, []) == []


def test_many_copies_and_small_shards(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") + rnd.choice("dfgklmnprstvxz") for _ in range(3))
    data, want = [], []
    for k in range(60):
        name, quote = f"{word().title()} {word().title()} Clinic", " ".join(word() for _ in range(8))
        first = None
        for b in sorted(rnd.choices(range(1, 6), k=rnd.randrange(1, 4))):
            i = len(data) + 1
            data.append([action(i, b, name, quote, f"2024-02-{k % 28 + 1:02d}", f"https://x/2024/a24-{1300100 + k}"), (b, i), k])
            first = first or i
    data += [[action(i, 6, url="https://x/2024/k24-1399999", sha=f"{i:064x}"), (6, i), "hot"] for i in range(1000, 1200)]
    groups = {}
    for _, at, k in data:
        groups.setdefault(k, []).append(at)
    for g in groups.values():
        g.sort()
        want += [(g[0][1], i) for _, i in g[1:]]
    assert repeated(spark, [d[0] for d in data], shard_rows=50) == sorted(want)


def test_a_first_row_behind_many_copies(spark):
    quote = "The firm published claims about returns that no reasonable reader could check, on its landing page and in two newsletters"
    of = lambda i, batch, name, q, mark: action(i, batch, name, q, url="https://x/latest", sha=f"{mark:064x}")
    right, wrong = "Ashbourne Keddat Lettings Ltd", "Ashborune Keddat Lettings Ltd"
    assert repeated(spark, [of(1, 1, wrong, quote[:60], 1), *(of(i, 1, right, quote, i) for i in range(2, 32))]) == [(1, i) for i in range(2, 32)]
    # With a checksum in place of a missing quote, and the mistyped row last.
    data = [of(1, 1, right, None, 7), *(of(i, 1, right, quote, 7 if i == 20 else 100 + i) for i in range(2, 32)), of(32, 2, wrong, quote[:60], 1)]
    assert repeated(spark, data) == [(1, i) for i in range(2, 33)]


@pytest.mark.parametrize("n", [5, 60])
def test_rulings_of_one_day_that_differ_in_penalty(spark, n):
    quote = "Only ten places left for carers in the new building so everyone can stop worrying"
    data = [action(i, 1, quote=quote, penalty=1000.0 + i, url="https://x/latest", sha=f"{i:064x}") for i in range(n)]
    data += [action(n + i, 2, quote=quote + " today", penalty=1000.0 + i, url="https://x/latest", sha=f"{n + i:064x}") for i in range(n)]
    assert repeated(spark, data) == [(i, n + i) for i in range(n)]


def test_batch_by_batch_with_compaction_equals_one_load(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") + rnd.choice("dfgklmnprstvxz") for _ in range(3))
    cases = [(f"{word().title()} {word().title()} Clinic", " ".join(word() for _ in range(8)), f"2024-03-{k % 28 + 1:02d}") for k in range(40)]
    data = []
    for i in range(140):
        name, quote, date = cases[rnd.randrange(40)]
        data.append(action(i, 1 + i // 28, name, quote + (" more" if i % 3 == 0 else ""), date, "https://x/latest"))
    df = spark.createDataFrame(data, ACTIONS)
    index = history.History(spark, f"file://{tmp_path}/index", shard_rows=8, fanout=2)
    for b in range(1, 6):
        index.add(df.where(F.col("batch_no") == b))
    # The manifest is read again as it was written, and compaction kept it short.
    again = history.History(spark, f"file://{tmp_path}/index", shard_rows=8, fanout=2)
    assert again.generations == index.generations and len(again.generations) <= 3
    first = {}
    for i, (_, _, _, _, _, name, quote, date, *_) in enumerate(data):
        first.setdefault((name, date), i)
    want = sorted((first[(d[5], d[7])], i) for i, d in enumerate(data) if first[(d[5], d[7])] != i)
    assert sorted(map(tuple, again.repeats().collect())) == want == repeated(spark, data)


def test_a_small_batch_opens_only_its_segments(spark, tmp_path):
    data = [action(i, 1, date=f"20{10 + i % 12}-0{1 + i % 9}-1{i % 10}", quote=f"quote {i} of many", url="https://x/latest") for i in range(300)]
    index = history.History(spark, f"file://{tmp_path}/index", shard_rows=8)
    made = index.add(spark.createDataFrame(data, ACTIONS))
    one = history.shaped(spark.createDataFrame([data[7]], ACTIONS)).select("key")
    assert made["slices"] >= 16 and [len(x) for x in index._touched(one).values()] == [1]


def test_graph_recall_against_exhaustive_search():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, history.DIMS)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = history.Graph(v)
    q = v[:400] + rng.normal(0, 0.05, (400, history.DIMS)).astype(np.float32)
    ids, sims = g.search(q / np.linalg.norm(q, axis=1, keepdims=True), 3)
    assert (ids[:, 0] == np.arange(400)).mean() >= 0.97 and (np.diff(sims, axis=1) <= 1e-6).all()


# -- leakage

ITEM = "What was decided here? Whereas the levy had lapsed, the seaweed franchise lay in Ostrava House where an auditor rescinded nine pawn tickets during the ferry strike. Once the bailiff misread the ferry timetable, notice had been waived, yet her deputy overlooked the tramway bylaws that same Michaelmas."
PROSE = "The desk in May had many files open on lease extensions for clients who live nearby. "


def leaked(spark, *docs, items=(ITEM,)):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    return sorted((r.doc_id, r.item_id) for r in leakage.leaks(d, spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, item_text string")).collect())


def disguises():
    part = "the seaweed franchise lay in Ostrava House where an auditor rescinded nine pawn tickets"
    return [
        part.upper(), part.replace("a", "&#97;"), part.replace("auditor", "au​di­tor"), part.replace(" in ", " <b>in</b> ").replace("lay", "lay<br/>"), part.replace("franchise", "fran-\n> chise"), part.replace("seaweed", "ſeaweed"),
        part.replace("lay", "lay,").replace("where", "— where"), part.translate({ord(c): chr(ord(c) + 0xFEE0) for c in "abcdefgh"}),
    ]


@pytest.mark.parametrize("text", disguises())
def test_disguised_passages(spark, text):
    assert leaked(spark, PROSE + text + ". " + PROSE) == [(0, 0)]


def test_runs_of_twelve_and_stretches(spark):
    w = ITEM.split()
    eleven, twelve = " ".join(w[8:19]), " ".join(w[8:20])
    every = lambda n: " ".join(x if (i + 1) % n else "changed" for i, x in enumerate(w))
    assert leaked(spark, PROSE + eleven + " however", PROSE + twelve + " however", every(6), every(4), None, "", "same words " * 30_000) == [(1, 0), (2, 0)]
    assert leaked(spark, items=()) == [] and leaked(spark, ITEM, items=(ITEM, None, "", ITEM)) == [(0, 0), (0, 3)]


def test_longest_part_against_brute_force():
    rnd = random.Random(6)
    for _ in range(200):
        steps = [rnd.choice((1, 1, 1, -5)) for _ in range(rnd.randrange(30))]
        want = max((j - i for i in range(len(steps)) for j in range(i + 1, len(steps) + 1) if sum(steps[i:j]) >= 0), default=0)
        assert leakage._longest(steps) == want


def test_an_item_retold_with_other_names_and_numbers(spark):
    item = "A visitor paid 40 pounds for 3 maps in Ostrava on Monday, and the clerk in Ostrava kept 12 of the coins while the guard counted 7 lamps near the gate of the old mill before Tobias closed it at 9 in the evening for repairs."
    other = item.replace("40", "85").replace("3 maps", "6 maps").replace("Ostrava", "Lisbon").replace("Monday", "Friday").replace("12", "31").replace("7", "5").replace("Tobias", "Edmund").replace("at 9", "at 4")
    torn = item.replace("paid 40", "paid 85").replace("in Ostrava on", "in Lisbon on").replace("in Ostrava kept", "in Geneva kept").replace("3 maps", "6 maps").replace("12", "31").replace("7", "5").replace("Tobias", "Edmund")
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {r.doc_id: r.kind for r in leakage.leaks(df([(0, PROSE + other), (1, PROSE * 9), (2, torn)], "doc_id long, text string"), df([(5, item)], "item_id long, item_text string")).collect()}
    assert 0 in got and 1 not in got and got.get(2) != "template"


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 10)
    other = ITEM.replace("levy", "toll").replace("seaweed", "timber")
    assert leaked(spark, PROSE + ITEM, PROSE + "nothing", items=("x", ITEM, "y " * 30, other))[:1] == [(0, 1)]


def test_reparameterised_items_are_told_apart(spark):
    d = spark.createDataFrame([(0, ITEM.replace("nine", "seven"))], "doc_id long, text string")
    it = spark.createDataFrame([(0, ITEM)], "item_id long, item_text string")
    r = leakage.leaks(d, it).first()
    assert r.kind == "verbatim" or r.slots == 1
    short = spark.createDataFrame([(0, " ".join(x if i % 9 else "nine" for i, x in enumerate(ITEM.split())))], "item_id long, item_text string")
    other = short.select("item_id", F.replace("item_text", F.lit("nine"), F.lit("forty")).alias("text")).withColumnRenamed("item_id", "doc_id")
    assert leakage.leaks(other, short).first().kind == "reparameterised"


# -- mixing


def documents(spark, sizes):
    data = [(i, s, "word " * n if n is not None else None) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    return spark.createDataFrame(data, "doc_id long, source string, text string")


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    docs = documents(spark, {"a": [20] * 300, "b": [20] * 100, "c": [20] * 5, "no target": [50] * 40})
    chosen, report = mixing.mix(docs, targets(spark, ("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 4), ("missing", 0.0, 2)), size="whole")
    r = {x.source: x for x in report.collect()}
    total = sum(x.available for x in r.values())
    assert abs(r["a"].used_tokens - 0.5 * total) <= 11 and abs(r["b"].used_tokens - 0.4 * total) <= 11
    assert r["c"].most_uses == 4 and r["c"].short and r["missing"].used_tokens == 0
    rows = chosen.collect()
    assert max(x.uses for x in rows if x.source == "c") == 4 and not any(x.source == "no target" for x in rows)
    assert sum(x.n_tokens * x.uses for x in rows) == sum(x.used_tokens for x in r.values())


def test_balanced_and_exact_mix(spark):
    docs = documents(spark, {"a": [5, 9, 2] * 900, "b": [7, 3] * 900, "c": [4] * 100, "d": []})
    t = targets(spark, ("a", 0.55, 1), ("b", 0.3, 3), ("c", 0.05, 1), ("d", 0.1, 2))
    for size in ("exact", "balanced"):
        r = {x.source: x for x in mixing.mix(docs, t, size=size)[1].collect()}
        assert abs(r["a"].feasible_share - 0.55 / 0.9) < 1e-9 and r["d"].used_tokens == 0 and r["d"].short
        assert all(abs(r[s].actual_share - r[s].feasible_share) <= mixing.TOLERANCE + 0.001 for s in "ab")
        assert r["c"].used_tokens == r["c"].available
    assert sum(x.used_tokens for x in mixing.mix(docs, t, size="exact")[1].collect()) < sum(x.used_tokens for x in mixing.mix(docs, t)[1].collect())


def test_a_gap_is_filled_by_the_record_that_fits_best(spark):
    docs = documents(spark, {"a": [100] * 20 + [3, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47]})
    for n in (530, 777, 1234):
        used = mixing.mix(docs, targets(spark, ("a", 1.0, 1)), total_tokens=n)[1].first().used_tokens
        assert abs(used - n) <= 50, (n, used)


def test_the_boundary_record_is_the_nearer_one(spark):
    docs = documents(spark, {"a": [100] * 50})
    got = [mixing.mix(docs, targets(spark, ("a", 1.0, 1)), total_tokens=n)[1].first().used_tokens for n in (40, 60, 240, 260)]
    assert [round(x / got[1]) for x in got] == [0, 1, 2, 3]


def test_nested_budgets(spark):
    docs, t = documents(spark, {"a": [10] * 400, "b": [10] * 40}), targets(spark, ("a", 0.6, 1), ("b", 0.4, 2))
    small, large = ({x.doc_id for x in mixing.mix(docs, t, total_tokens=n)[0].where("source = 'a'").collect()} for n in (500, 2000))
    assert len(small - large) <= 1 and len(small) < len(large)


def test_mixing_awkward_rows(spark):
    docs = documents(spark, {"a": [None, 0, 5, 5], "b": []})
    chosen, report = mixing.mix(docs, targets(spark, ("a", 1.0, 2), (None, 0.0, 1)), total_tokens=10**9)
    assert sorted((x.doc_id, x.uses) for x in chosen.collect()) == [(2, 2), (3, 2)]
    assert mixing.mix(documents(spark, {}), targets(spark))[0].count() == 0 and report.count() == 1


def test_token_counts_match_the_tokenizer(spark):
    import tiktoken

    texts = ["It's a test, isn't it?  Yes 123!\n\n", "Grüße an 日本", "<|endoftext|>", None, ""]
    got = {r.doc_id: r.n_tokens for r in mixing.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[3] == got[4] == 0
    import base64

    with open(mixing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("t", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    assert [got[i] for i in range(3)] == [len(plain.encode_ordinary(t)) for t in texts[:3]]


# -- stuffing


def prose(rnd):
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5)))
    forms = ["The {} of the {} is with our {}, and you may {} it at any time.", "We {} a {} for those who {} to the {} in {}.", "If they {} about the {}, it was not because of the {} that {} had.", "Some {} will {} on the {} before it is {} by the {}."]
    return " ".join(f.format(*(word() for _ in range(f.count("{}")))) for f in rnd.choices(forms, k=rnd.randrange(4, 9)))


def test_spam_against_held_out_labels(spark):
    rnd = random.Random(8)
    spam = ["cheap dentist near me best dentist London top dentist free quote dentist " * 12, "\n".join(f"http://x-{i}.example/cheap-dentist" for i in range(60)), "Tags: " + " ".join(f"#dentist{i}" for i in range(80)), "We keep a plain approach. " + ", ".join(f"dentist cheap Town{i}" for i in range(60)), "cheap shoes cheap shoes cheap boots cheap shoes", "#sale #shoes #boots #cheap #deal"]
    kept = [prose(rnd) + prose(rnd) + prose(rnd) + "\n\nSee also\nhttps://a.example/x\nhttps://b.example/y", prose(rnd) + "\nFees: £10, £20, £30.", None, "", "Hi there"]
    data = [prose(rnd) for _ in range(300)] + kept + spam
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(data)], "doc_id long, text string, cost double")
    got = {r.doc_id for r in stuffing.scores(df).where("spam").select("doc_id").collect()}
    assert got >= set(range(305, 311)) and not got & set(range(300, 305))
    assert len(got & set(range(300))) <= 6
    assert stuffing.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
