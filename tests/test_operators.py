"""Operators against brute force and on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import url as U
from quarrylight.functions import values as V
from quarrylight.operators import gates, match, order, quality, rollup
from quarrylight.plans import registry
from quarrylight.sources import files
from tests.conftest import rows


def test_as_of_takes_the_nearest_row_not_after(spark):
    rnd = random.Random(1)
    left = [(rnd.randrange(4), i, rnd.randrange(50)) for i in range(120)]
    right = [(rnd.randrange(4), 1000 + i, t) for i, t in enumerate(rnd.sample(range(60), 40))]
    got = order.as_of(spark.createDataFrame(left, "k int, id int, t int"), spark.createDataFrame(right, "k int, v int, at int"), ["k"], "t", "at", ["v"])
    want = [(k, i, t, max(((at, v) for kk, v, at in right if kk == k and at <= t), default=(0, None))[1]) for k, i, t in left]
    assert rows(got.na.fill(-1)) == sorted((*x[:3], -1 if x[3] is None else x[3]) for x in want)


def test_merged_intervals(spark):
    rnd = random.Random(2)
    data = [(rnd.randrange(3), a, a + rnd.randrange(4)) for a in (rnd.randrange(40) for _ in range(60))]
    want = []
    for k in range(3):
        held = []
        for a, b in sorted((a, b) for kk, a, b in data if kk == k):
            if held and a <= held[-1][1]:
                held[-1] = [held[-1][0], max(b, held[-1][1]), held[-1][2] + 1]
            else:
                held.append([a, b, 1])
        want += [(k, *h) for h in held]
    assert rows(order.merged(spark.createDataFrame(data, "k int, a int, b int"), ["k"], "a", "b")) == sorted(want)


def test_numbering_over_ranges_equals_one_window(spark):
    data = [(k, i * 7 % 1009) for k in "ab" for i in range(300)]
    want = sorted((k, v, n) for k in "ab" for n, v in enumerate(sorted(v for kk, v in data if kk == k), 1))
    assert rows(order.numbered(spark.createDataFrame(data, "k string, v int"), ["k"], "v", 50)) == want


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 1), ("b", 1, 20), ("c", 1, 3)], "k string, i int, size int")
    assert rows(order.within_budget(df, ["k"], [F.col("i")], F.col("size"), 10, 10).select("k", "i")) == [("a", 1), ("c", 1)]


def test_islands_reach(spark):
    df = spark.createDataFrame([("p", 1, 2), ("p", 8, 9), ("p", 16, 17)], "k string, a int, b int")
    assert [r[1] for r in order.islands(df, ["k"], "a", "b", 6).orderBy("a").select("a", "cluster").collect()] == [1, 1, 2]


def test_keep_first_and_ties(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 9), ("a", 1, 3)], "k string, o int, id int")
    assert rows(order.keep_first(df, ["k"], [F.col("o"), F.col("id")])) == [("a", 1, 3)]


def test_gates_name_the_first_failure_and_null_fails(spark):
    df = spark.createDataFrame([(True, False), (None, True), (True, True)], "a boolean, b boolean")
    got = df.select(gates.first_failure((F.col("a"), "a"), (F.col("b"), "b")).alias("r")).collect()
    assert [r[0] for r in got] == ["b", "a", None]


@pytest.mark.parametrize(("tags", "falses", "trues"), [("array()", False, True), ("array('n')", False, False), ("array('f')", True, False), ("array('f', 'n')", False, False), ("array('t')", False, True), ("array('zz')", False, False)])
def test_fail_open_and_fail_closed(spark, tags, falses, trues):
    df = spark.sql(f"select cast({tags} as array<string>) as tags, map('t', true, 'f', false, 'n', cast(null as boolean)) as m")
    assert df.select(gates.all_false(F.col("tags"), F.col("m")), gates.all_true(F.col("tags"), F.col("m"))).first() == (falses, trues)


def test_absence_needs_a_note(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "d string")
    got = gates.proved_absent(asked, spark.createDataFrame([("a",)], "d string"), spark.createDataFrame([("a",), ("b",)], "d string"), ["d"])
    assert rows(got) == [("b",)]


def test_winner_abstains_on_close_rivals(spark):
    df = spark.createDataFrame([("x", "a", 9.0), ("x", "b", 8.0), ("y", "a", 9.0), ("z", "a", 1.0)], "k string, l string, s double")
    assert rows(rollup.winner(df, ["k"], "l", "s", 2, 1.5).select("k", F.coalesce("l", F.lit("-")))) == [("x", "-"), ("y", "a"), ("z", "-")]


def test_rate_without_denominator_is_null(spark):
    assert spark.range(1).select(rollup.rate(F.lit(0), F.lit(0))).first()[0] is None


def test_longest_prefix_and_suffix(spark):
    df = spark.createDataFrame([("4412",), ("4",), ("9",), (None,)], "n string")
    p = spark.createDataFrame([("4", "uk"), ("44", "gb"), ("441", "mid")], "p string, v string")
    assert rows(match.longest_prefix(df.na.fill(""), "n", p, "p", "v", 3).na.fill("-")) == [("", "-"), ("4", "uk"), ("4412", "mid"), ("9", "-")]
    h = spark.createDataFrame([("a.b.test",), ("test",), ("contest",)], "h string")
    assert rows(match.host_suffix(h, "h", spark.createDataFrame([("test",)], "s string"), "s")) == [("a.b.test",), ("test",)]


def test_html_with_unclosed_script_and_entities(spark):
    html = "<title> A &amp; B </title><script>x='</p>'</script><p>one&nbsp;<b>two</b></p><!-- c --><script>never closed <p>gone</p>"
    row = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(T.strip_html("h"), T.html_title("h")).collect()
    assert row[0][0] == "A & B one two" and row[1][0] is None and row[2][0] == ""


def test_urls(spark):
    df = spark.createDataFrame([("HTTPS://user@www.Firm.co.uk:443/A/home-visits/?q#f",), ("not a url",), (None,)], "u string")
    got = df.select(U.host("u"), U.registrable(U.host("u")), U.path("u"), U.key("u"), U.has_run(U.segments("u"), ["home", "visits"])).collect()
    assert tuple(got[0]) == ("www.firm.co.uk", "firm.co.uk", "/A/home-visits/", "firm.co.uk/A/home-visits", True)
    assert got[1][0] == "" and got[2][0] is None


def test_dates_and_contrast(spark):
    d = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("2024-2-1",), (None,)], "d string").select(V.real_date("d")).collect()
    assert [x[0] for x in d] == [True, False, False, False]
    assert abs(spark.range(1).select(V.contrast(F.lit("000000"), F.lit("ffffff"))).first()[0] - 21) < 1e-6


def test_violations_and_difference(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert rows(quality.violations(df, F.col("k"), ("positive", F.col("v") > 0), ("small", F.col("v") < 1))) == [("a", "small"), ("b", "positive"), ("b", "small")]
    other = spark.createDataFrame([("a", 2), ("c", None)], "k string, v int")
    assert {(r.k, r.kind) for r in quality.difference(df, other, ["k"], "v").collect()} == {("a", "changed"), ("b", "removed"), ("c", "added")}


def test_sarif_and_broken_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"runs": [{"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "r", "level": "error", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "f.py"}, "region": {"startLine": 3}}}]}, {"ruleId": "q"}]}]}')
    (tmp_path / "b.json").write_text("{broken")
    got = files.sarif(spark, str(tmp_path)).select("tool", "rule_id", "start_line").collect()
    assert sorted(map(tuple, got)) == [("t", "q", 0), ("t", "r", 3)]
    bad = files.json_documents(spark, str(tmp_path), "runs array<string>").where("_corrupt_record is not null")
    assert [r.file for r in bad.collect()] == ["b.json"]


def test_ndjson_reports_each_bad_line(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": "a", "n": 1}\nnot json\n{"n": 2}\n')
    good, bad = files.ndjson(spark, str(tmp_path), "id string, n int", "id")
    assert rows(good) == [("a", 1)] and sorted(r.problem for r in bad.collect()) == ["missing: id", "not JSON"]


def test_late_events_are_dropped_and_state_survives_disorder(spark, tmp_path):
    from quarrylight.streaming import events as S

    data = [(1, "2024-01-01 00:10:00", 7, "view", 1.0, "{}"), (3, "2024-01-01 09:00:00", 7, "click", 2.0, "{}"), (2, "2024-01-01 00:20:00", 7, "error", 3.0, "{}")]
    df = spark.createDataFrame(data, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    got = S.drained(S.latest_state(S.source(spark, str(tmp_path))), "update")
    assert got.orderBy(F.desc("events")).first()[:3] == (7, 3, "click")


def test_all_windows_of_the_input_come_out_and_append_holds_the_open_ones_back(spark, tmp_path):
    from quarrylight.streaming import events as S

    data = [(i, f"2024-01-01 {h:02d}:10:00", 7, "view", 1.0, "{}") for i, h in enumerate((0, 1, 5, 6))]
    spark.createDataFrame(data, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    of = lambda mode: S.drained(S.tumbling(S.source(spark, str(tmp_path)), "1 hour", "2 hours"), mode).count()
    assert of("complete") == 4 and of("append") < 4


def test_best_name_by_rarest_words_equals_all_pairs(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    make = lambda n, p: [(f"{p}{i}", sorted({"common", *rnd.sample(words, rnd.randrange(1, 4))})) for i in range(n)]
    q, c = make(40, "q"), make(60, "c")
    for least in (0.0, 0.34, 0.5, 0.75, 1.0):
        want = {}
        for k, a in q:
            best = min(((-len(set(a) & set(b)) / len(set(a) | set(b)), n) for n, b in c if set(a) & set(b)), default=None)
            if best and -best[0] >= least:
                want[k] = (best[1], round(-best[0], 9))
        got = match.best_name(spark.createDataFrame(q, "q string, t array<string>"), "q", spark.createDataFrame(c, "c string, t array<string>"), "c", "t", least).collect()
        assert {r.q: (r.c, round(r.score, 9)) for r in got} == want


def test_best_name_of_short_and_long_names_equals_all_pairs(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(16)]
    make = lambda n, p: [(f"{p}{i:02}", rnd.sample(words, rnd.choice((1, 2, 3, 7, 8, 9, 12)))) for i in range(n)] + [(f"{p}-none", [])]
    q, c = make(50, "q"), make(70, "c")
    for least in (0.0, 0.35, 0.6):
        want = {}
        for k, a in q:
            best = min(((-len(set(a) & set(b)) / len(set(a) | set(b)), n) for n, b in c if set(a) & set(b)), default=None)
            if best and -best[0] >= least:
                want[k] = (best[1], round(-best[0], 9))
        got = match.best_name(spark.createDataFrame(q, "q string, t array<string>"), "q", spark.createDataFrame(c, "c string, t array<string>"), "c", "t", least).collect()
        assert {r.q: (r.c, round(r.score, 9)) for r in got} == want


def most_joined(df):
    """The most rows that came out of one join of a table that was collected."""
    joined, plans = [0], [df._jdf.queryExecution().executedPlan()]
    while plans:
        x = plans.pop()
        if "Join" in x.nodeName():
            joined.append(x.metrics().apply("numOutputRows").value())
        plans += [x.executedPlan()] if x.nodeName() == "AdaptiveSparkPlan" else [x.plan()] if "QueryStage" in x.nodeName() else [x.children().apply(i) for i in range(x.children().size())]
    return max(joined)


def test_best_name_moves_no_pairs_of_common_words(spark):
    """300 queries and 300 candidates with the same four words: 90,000 pairs, of which none may come out of a join."""
    make = lambda p: spark.range(300).select(F.concat(F.lit(p), "id").alias(p), F.array(*(F.lit(x) for x in ("and", "dental", "practice", "the")), F.concat(F.lit(p), "id")).alias("t"))
    got = match.best_name(make("q"), "q", make("c"), "c", "t", 0.35)
    assert {tuple(r) for r in got.collect()} == {(f"q{i}", "c0", 4 / 6) for i in range(300)}
    assert 0 < most_joined(got) < 30_000


def test_entity_resolution_moves_no_pairs_of_common_words(spark, tmp_path):
    """150 sites and 300 firms named by the same two words and one of their own: no join gives the pairs, and each score of a half is no conflict."""
    save = lambda name, data, schema: spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    save("site_pages", [(f"d{i}", f"Dental Practice s{i}") for i in range(150)] + [("other", "Quarry")], "domain string, og_site_name string")
    save("enforcement_actions", [(f"Dental Practice f{i}",) for i in range(300)], "entity_name string")
    save("site_bundles", [(f"d{i}", "Company number 01234567") for i in range(150)] + [("other", "Company number 01234567")], "domain string, footer_text string")
    save("register_notes", [("d0", "a", "matched")], "domain string, register string, kind string")
    got = registry.QUERIES["entity_resolution"](spark, str(tmp_path))
    assert {r.domain: r.verdict for r in got.collect()} == {f"d{i}": "UNRESOLVED" for i in range(150)} | {"other": "CONFLICT"}
    assert 0 < most_joined(got) < 15_000


@pytest.mark.parametrize(("rare", "wide", "small"), [(0, 8, 10_000), (0, 3, 10_000), (5, 3, 10_000), (9, 8, 2)])
def test_best_name_by_rare_and_common_words_equals_all_pairs(spark, monkeypatch, rare, wide, small):
    """Words that many hold and words that few hold, names of many common words, and a table of common words that is not broadcast."""
    monkeypatch.setattr(match, "RARE", rare)
    monkeypatch.setattr(match, "WIDE", wide)
    monkeypatch.setattr(match.small, "__defaults__", (small,))
    rnd = random.Random(rare + wide)
    words = [f"w{i}" for i in range(14)]
    some = lambda: sorted(set(rnd.choices(words, [2 ** (-i / 3) for i in range(14)], k=rnd.choice((1, 2, 4, 8, 12)))))
    make = lambda n, p: [(f"{p}{i:02}", some()) for i in range(n)] + [(f"{p}-none", []), (f"{p}-other", [p])]
    q, c = make(40, "q"), make(60, "c")
    for least in (0.0, 0.35, 0.6):
        want = {}
        for k, a in q:
            best = min(((-len(set(a) & set(b)) / len(set(a) | set(b)), n) for n, b in c if set(a) & set(b)), default=None)
            if best and -best[0] >= least:
                want[k] = (best[1], round(-best[0], 9))
        got = match.best_name(spark.createDataFrame(q, "q string, t array<string>"), "q", spark.createDataFrame(c, "c string, t array<string>"), "c", "t", least).collect()
        assert {r.q: (r.c, round(r.score, 9)) for r in got} == want


def most_moved(df):
    """The most rows that one shuffle of a table that was collected took."""
    moved, plans = [0], [df._jdf.queryExecution().executedPlan()]
    while plans:
        x = plans.pop()
        if x.nodeName() == "Exchange":
            moved.append(x.metrics().apply("shuffleRecordsWritten").value())
        plans += [x.executedPlan()] if x.nodeName() == "AdaptiveSparkPlan" else [x.plan()] if "QueryStage" in x.nodeName() else [x.children().apply(i) for i in range(x.children().size())]
    return max(moved)


def test_entity_resolution_moves_no_sets_of_long_names(spark, tmp_path):
    """100 sites and 200 firms named by three words of all and five of their own: each has 219 sets of at least three words, none of which is moved."""
    save = lambda name, data, schema: spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    name = lambda i: " ".join(("Dental Care Practice", *(f"{x}{i}" for x in "abcde")))
    save("site_pages", [(f"d{i}", name(i)) for i in range(100)] + [("other", name("-"))], "domain string, og_site_name string")
    save("enforcement_actions", [(name(2 * i),) for i in range(200)], "entity_name string")
    save("site_bundles", [(f"d{i}", "Company number 01234567") for i in range(100)] + [("other", "Company number 01234567")], "domain string, footer_text string")
    save("register_notes", [("d0", "a", "matched")], "domain string, register string, kind string")
    got = registry.QUERIES["entity_resolution"](spark, str(tmp_path))
    assert {r.domain: r.verdict for r in got.collect()} == {f"d{i}": "CONFLICT" if i % 2 else "CONFIRMED" for i in range(100)} | {"other": "CONFLICT"}
    assert 0 < most_moved(got) < 2_000


def test_islands_across_ranges_equal_one_pass(spark):
    rnd = random.Random(6)
    data = [(rnd.choice("ab"), s, s + rnd.choice((1, 2, 300)), i) for i, s in enumerate(rnd.sample(range(3000), 160))]
    want = []
    for k in "ab":
        far, n = None, 0
        for _, a, b, i in sorted(x for x in data if x[0] == k):
            if far is None or a - 6 > far:
                n += 1
            far = b if far is None else max(far, b)
            want.append((i, n))
    got = order.islands(spark.createDataFrame(data, "k string, a int, b int, i int"), ["k"], "a", "b", 6, width=50)
    assert rows(got.select("i", "cluster")) == sorted(want)


def test_closure_of_a_vocabulary(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "c")], "k string, p string")
    got = {(r.child, r.ancestor): r.depth for r in gates.closure(edges, "k", "p").collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("b", "c"): 1, ("b", "d"): 2, ("c", "d"): 1, ("x", "c"): 1, ("x", "d"): 2}


def test_verdicts_need_a_verbatim_disproof(spark):
    df = spark.createDataFrame([("breach", "x", "x"), ("no_breach", "We show all Fees here", " all fees "), ("no_breach", "We show fees", "fees"), ("no_breach", "We show", "other words"), ("?", "We show all fees", "all fees"), ("no_breach", None, "all fees")], "l string, e string, d string")
    assert [r[0] for r in df.select(gates.verdict(F.col("l"), F.col("e"), F.col("d"), 6)).collect()] == ["violation", "pass", "needs_review", "needs_review", "needs_review", "needs_review"]


def test_quotes_are_looked_up_at_their_address(spark):
    pages = spark.createDataFrame([("u1", "Some  text\nwith many words in it"), ("u1", "Another text"), ("u2", "x")], "url string, text string")
    claims = spark.createDataFrame([(1, "u1", "TEXT with many"), (2, "u1", "no such words"), (3, "u9", "text with many"), (4, "u1", "text"), (5, "u1", None)], "id int, url string, q string")
    assert rows(match.quotes_in_pages(claims, pages, "id", "url", "q", "text", 8)) == [(1, "verified"), (2, "quote not found"), (3, "page not found"), (4, "too short"), (5, "too short")]


def test_robots_files(spark):
    from quarrylight.sources import crawl

    data = [(1, "User-agent: A\nUser-agent: B\nDisallow: /\n\nUser-agent: *\nDisallow: /x"), (2, "user-agent: *\ndisallow: / # all\n\nUser-Agent: a\nDisallow:"), (3, "User-agent: *\nDisallow: /\nAllow: /"), (4, None), (5, "")]
    got = {(r.k, r.bot): r.blocked for r in crawl.blocked_bots(spark.createDataFrame(data, "k int, t string"), "k", "t", ("a", "c")).collect()}
    assert got == {(1, "a"): True, (1, "c"): False, (2, "a"): False, (2, "c"): True, (3, "a"): False, (3, "c"): False, (4, "a"): False, (4, "c"): False, (5, "a"): False, (5, "c"): False}


def test_catalogues_of_two_shapes_and_broken_ones(spark, tmp_path):
    (tmp_path / "a.txt").write_text('[{"id": "a"}, {"id": "b", "name": "n"}]\n{"records": [{"id": "c"}]}\n{oops\n\n[]\n')
    got = files.records(spark, str(tmp_path), "id string, name string").collect()
    assert sorted((r.id or "", r["shape"], r.problem or "") for r in got) == [("", "broken", "not JSON"), ("", "list", ""), ("a", "list", ""), ("b", "list", ""), ("c", "wrapped", "")]


def test_objects_are_put_once(spark, tmp_path):
    path = f"file://{tmp_path}/o"
    df = spark.createDataFrame([("s", "x"), ("s", "x"), ("t", "x"), ("s", None)], "f string, c string")
    files.put_objects(df, path, "f", "c")
    files.put_objects(df, path, "f", "c")
    assert files.objects(spark, path, "f string, object_key string, c string").count() == 3


def test_a_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from quarrylight import runtime

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(far)


def test_cut_tables_are_released(spark):
    import os

    from quarrylight import runtime

    df = runtime.cut(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    path = runtime._written[-1].removeprefix("file://")
    assert df.count() == 10 and os.path.isdir(path)
    runtime.release(spark)
    assert not os.path.exists(path)
