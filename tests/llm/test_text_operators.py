"""Operators on running text: truncation, furniture, personal data, repeated lines, residue."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import boilerplate, personal, repeated_lines, residue, truncation

PAGES = "page_id long, domain string, url string, title string, text string, _k string, _t string"


def pages(spark, data):
    """Pages with columns whose names the operators use within."""
    return spark.createDataFrame([(i, d, u, t, x, "clash", "clash") for i, (d, u, t, x) in enumerate(data)], PAGES)


def ids(df):
    return sorted(r[0] for r in df.collect())


LONG = "We keep a plain approach to wills and the desk checks the file before the first visit. " * 3


# -- truncation


def corpus():
    whole = "The desk checks the file before the first visit. Our desk meets school leavers after the call.\nShare this page\n© 2024 Firm. Site by Barn"
    return [("d", f"u{i}", None, whole) for i in range(12)]


@pytest.mark.parametrize(
    ("ending", "cut"),
    [
        ("Our desk meets school", True), ("Our desk meets scho", True), ("Our desk meets school leavers after the ca...", True), ("Our desk meets school leavers […]", True),
        ("Our desk meets school leavers after the call.", False), ("Share this page", False), ("© 2024 Firm. Site by Barn", False), ("Share this pa", True), ("Our desk meets school leavers after the call.  \n\n", False),
    ],
)
def test_cut_endings(spark, ending, cut):
    data = corpus() + [("d", "x", None, "The desk checks the file before the first visit.\n" + ending)]
    got = truncation.truncated(pages(spark, data)).where("truncated")
    assert ids(got.select("page_id")) == ([12] if cut else [])


def test_truncation_of_nothing(spark):
    data = [("d", "u", None, None), ("d", "u", None, ""), ("d", "u", None, " \n "), ("d", "u", None, "x" * 200_000), ("d", "u", None, " " * 100_000 + "a  " * 50_000)]
    assert {r.page_id for r in truncation.truncated(pages(spark, data)).collect()} == {3, 4}
    assert truncation.truncated(pages(spark, [])).count() == 0


# -- repeated lines


def test_repeated_lines_against_brute_force(spark):
    import random

    rnd = random.Random(4)
    vocabulary = ["Share THIS page!", "share this page 12", "Ünïcode Zeile", "123 --", "", "other", "Only here"]
    data = [(rnd.choice("ab"), f"u{rnd.randrange(9)}", None, "\n".join(rnd.choices(vocabulary, k=rnd.randrange(5)))) for _ in range(80)]
    key = lambda x: "".join(c for c in x if c.isalpha()).lower()
    seen = {}
    for d, u, _, t in data:
        for x in t.split("\n"):
            if key(x):
                seen.setdefault((d, key(x)), set()).add(u)
    want = sorted((i, n) for i, (d, u, _, t) in enumerate(data) for n, x in enumerate(t.split("\n"), 1) if key(x) and len(seen[d, key(x)]) >= 6)
    assert sorted(map(tuple, repeated_lines.repeated_lines(pages(spark, data), 6).collect())) == want


def test_rebuilding_keeps_other_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "x"), (2, None, "y"), (3, "b", "z")], "page_id long, text string, _drop string")
    drop = spark.createDataFrame([(1, 2), (3, 1)], "page_id long, line_no int")
    assert sorted(map(tuple, repeated_lines.without_lines(df, drop).collect())) == [(1, "a\nc", "x"), (2, None, "y"), (3, "", "z")]


def test_repeated_lines_share_nulls_and_empty_table(spark):
    data = [(None, None, None, "same line"), (None, None, None, "same line"), ("d", "u", None, None)]
    assert repeated_lines.repeated_lines(pages(spark, data), 1).count() == 2
    assert repeated_lines.repeated_lines(pages(spark, data), 2).count() == 0
    assert repeated_lines.repeated_lines(pages(spark, [])).count() == 0
    half = [("d", f"u{i}", None, "common" if i < 4 else "rare %s" % "abcdef"[i - 4]) for i in range(10)]
    assert repeated_lines.repeated_lines(pages(spark, half), 2, min_share=0.4).count() == 4
    assert repeated_lines.repeated_lines(pages(spark, half), 2, min_share=0.5).count() == 0


# -- residue


@pytest.mark.parametrize(
    ("title", "text", "kind"),
    [
        ("Ok", "Welcome to {{ site.name }}, all of you.\n" + LONG, "placeholder"), ("%%title%% %%sep%%", LONG, "placeholder"), ("Untitled Document", LONG, "placeholder"), ("Ok", "Lorem ipsum dolor sit amet.\n" + LONG, "placeholder"),
        ("Ok", "The lease used the words “[insert name]” by mistake. " + LONG, None), ("Ok", "If an old leaflet says “page not found”, ring the desk. " + LONG, None), ("Ok", "You need to enable JavaScript to run this app.", "notice"),
        ("Ok", "HTTP ERROR 500\nTrace 4ea19c5afd453e26", "notice"), ("Ok", LONG, None), ("{{ t }}", "   ", None), ("{{ t }}", None, None), ("Ok", "HOME\nAccess Denied\nYou don't have permission to access this resource.", "notice"),
    ],
)
def test_residue(spark, title, text, kind):
    got = residue.evidence(pages(spark, [("d", "u", title, text)])).collect()
    assert [r.kind for r in got] == ([kind] if kind else [])


def examples(pattern):
    """Strings that a pattern matches: every branch, and every optional part both with and without."""
    from re import _constants as c
    from re import _parser

    def of(tree):
        out = [""]
        for op, arg in tree:
            if op is c.LITERAL:
                more = [chr(arg)]
            elif op in (c.AT, c.ASSERT_NOT):
                more = [""]
            elif op is c.BRANCH:
                more = [x for b in arg[1] for x in of(b)]
            elif op is c.SUBPATTERN:
                more = of(arg[3])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                low, high, part = arg
                one = of(part)
                more = [x * n for x in one for n in sorted({low, min(high, low + 1)})] if low else ["", *one]
            elif op is c.IN:
                kinds = {c.CATEGORY_DIGIT: "1", c.CATEGORY_WORD: "a", c.CATEGORY_NOT_WORD: "-"}
                first = arg[0] if arg[0][0] is not c.NEGATE else (c.LITERAL, ord("z"))
                more = [chr(x) for o, x in arg if o is c.LITERAL] if arg[0][0] is c.LITERAL else [chr(first[1][0]) if first[0] is c.RANGE else kinds[first[1]] if first[0] is c.CATEGORY else chr(first[1])]
            else:
                more = [" " if op is c.ANY else "z"]
            out = [x + y for x in out for y in dict.fromkeys(more)]
        return list(dict.fromkeys(out))

    return [x for x in of(_parser.parse(pattern)) if x.strip()]


@pytest.mark.parametrize("patterns", ["PLACEHOLDERS", "FILLER", "NOTICES"])
def test_gates_let_through_what_the_patterns_match(patterns):
    judge = residue.Judge()
    flags = lambda i: 0 if patterns == "PLACEHOLDERS" and i >= 7 else residue.re.IGNORECASE
    lost, seen = [], 0
    for i, p in enumerate(getattr(residue, patterns)):
        made = [x for x in examples(p) if "\n" not in x and residue.re.search(p, x, flags(i))]
        assert made, p
        seen += len(made)
        lost += [x for x in made if judge("", x) is None]
    assert seen > 10 and lost == []


@pytest.mark.parametrize("line", ["Welcome to %SITE_NAME%", "Call %PHONE%!", "%COMPANY_NAME%s file", "Dear %FIRST_NAME%:", "Verify you are human", "504 Gateway Time-out", "401", "The server encountered an unexpected condition", "Site en maintenance", "Erreur 410", "Please turn on cookies", "[Insert practice name] has served [town] since [year].", "{0} offers {1} for every {2}.", "##COMPANY## looks forward to you.", "Click here to add your own text and edit me.", "[vc_row][vc_column_text]Heading[/vc_column_text]"])
def test_evidence_that_stems_once_missed(line):
    assert residue.Judge()("", line) is not None


def test_furniture_does_not_hide_a_notice(spark):
    menu = "\n".join(f"A rather long furniture line number {w} of this website" for w in ("one", "two", "three", "four", "five"))
    data = [("d", f"u{i}", "Ok", menu + "\n" + LONG) for i in range(4)] + [("d", "u9", "Ok", menu + "\nCOMING SOON")]
    assert ids(residue.evidence(pages(spark, data)).select("page_id")) == [4]
    assert ids(residue.usable(pages(spark, data)).select("page_id")) == [0, 1, 2, 3]
    assert residue.evidence(pages(spark, [])).count() == 0


def test_doubtful_titles_and_mentions_do_not_exclude_content(spark):
    data = [
        ("d", "u0", "Index", LONG * 20), ("d", "u1", "Guide", LONG + " Write {{ name }} where the name of the customer belongs. " + LONG), ("d", "u2", "Set", "Set X = {a, b} for both sides and read the “[your name]” of the form. " + LONG),
        ("d", "u3", "Index", "Index of /files\nParent Directory"), ("d", "u4", "Untitled Document", LONG), ("d", "u5", "Hi", LONG + "\nDear {{ name }}, welcome to our site."),
    ]
    assert ids(residue.evidence(pages(spark, data)).select("page_id")) == [3, 4, 5]


def test_a_placeholder_in_a_footer_of_the_whole_host_is_boilerplate(spark):
    data = [("d", f"u{i}", "Ok", f"{LONG} {i}\n© {{{{year}}}} Firm Limited") for i in range(6)] + [("e", "u", "Ok", f"{LONG}\n© {{{{year}}}} Firm Limited")]
    assert ids(residue.evidence(pages(spark, data)).select("page_id")) == [6]


# -- personal data


def texts(spark, *values):
    return spark.createDataFrame([("o", i, v, "clash") for i, v in enumerate(values)], "origin string, row_key long, text string, kind string")


PERSONAL = [
    ("Complaints go to Dr Helena Brackshaw, 92-112 Beacon Rd., Pellminster XQ198HN, or by phone on +1-259-555-0156.", {"name": "Helena Brackshaw", "address": "92-112 Beacon Rd.", "phone": "+1-259-555-0156"}),
    ("Data protection contact: HALLIMOND, Siobhan", {"name": "HALLIMOND, Siobhan"}),
    ("E-mail: info@firm.example", {"email": "info@firm.example"}),
    ("Write to ann.lee [at] firm [dot] test with any doubts.", {"email": "ann.lee [at] firm [dot] test"}),
    ("Quote NHS number: 999 752 4612 whenever you write.", {"id_number": "999 752 4612"}),
    ("The file shows the passport number as ZW3732936; Mrs Yardewold countersigned it.", {"id_number": "ZW3732936", "name": "Yardewold"}),
    ("Company number 30451103. VAT no. GB 487 7951 40", {}),
    ("Order reference 1549-216-4508 covers the sample batch 433 756 2133.", {}),
    ("Contact: Maria del Carmen Lopez Garcia, 3 May", {"name": "Maria del Carmen Lopez Garcia"}),
    ("Posted by Johan van der Berg – Partner", {"name": "Johan van der Berg"}),
    ("Fenwick Vale Hall and the Market Trust met in Copper Vale.", {}),
]


def test_personal_data(spark):
    values = [t for t, _ in PERSONAL]
    # The estimate of reliabilities needs a corpus: each sentence occurs several times.
    got = personal.find(texts(spark, *(values * 20))).where(f"row_key < {len(values)}").collect()
    for i, (text, want) in enumerate(PERSONAL):
        found = {r.kind: r.start_at for r in got if r.row_key == i}
        assert found == {k: text.index(v) + 1 for k, v in want.items()}, text


def test_redaction_keeps_the_rest(spark):
    df = texts(spark, *["Call us: (01632) 960 497 today.\nE-mail: a@b.example"] * 9, None, "", "x" * 100_000, "a" * 50_000 + "@")
    out = personal.redacted(df).orderBy("row_key").collect()
    assert out[0].text == "Call us: [PHONE] today.\nE-mail: [EMAIL]" and out[0].kind == "clash"
    assert out[9].text is None and out[10].text == "" and out[11].text == "x" * 100_000
    assert personal.find(texts(spark)).count() == 0


def test_names_of_many_parts_leave_nothing_in_clear(spark):
    df = texts(spark, *["Signed by Maria del Carmen Lopez Garcia and kept on file."] * 20, *["Ask for Dr Helena Brackshaw, please."] * 20)
    out = {r.text for r in personal.redacted(df).collect()}
    assert "Signed by [NAME] and kept on file." in out


def test_reliabilities_tell_labelers_apart():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    patterns = {}
    for t in truth:
        votes = "".join("+" if (t if rng.random() < p else not t) else "-" for p in (0.95, 0.9, 0.6))
        patterns[votes] = patterns.get(votes, 0) + 1
    p, likelihood = personal.reliabilities(sorted(patterns.items()))
    assert likelihood[0][0] - likelihood[0][1] > likelihood[2][0] - likelihood[2][1]
    assert p["+++"] > 0.9 and p["---"] < 0.1


# -- page furniture


def test_gradient_of_the_labeller():
    reader, model = boilerplate.Reader(), boilerplate.Labeller()
    read = [reader.page("T", "Menu\n\nHello there, this is a sentence.\n© 2024"), reader.page(None, "One line only.")]
    labels = [np.array([0, 1, 0], np.float32), np.array([1], np.float32)]
    grads, _ = model.gradient(read, labels)
    for name, at in (("xf", (3, 5)), ("hb", (2, 7)), ("o", (4,)), ("bf", (21,))):
        eps, value = 1e-2, model.p[name][at]
        losses = []
        for d in (eps, -eps):
            model.p[name][at] = value + d
            losses.append(model.gradient(read, labels)[1])
        model.p[name][at] = value
        assert abs((losses[0] - losses[1]) / (2 * eps) - grads[name][at]) < 2e-3


def site(n):
    menu, foot = "Home  Services  News  Contact", "Phone: 01632 960 001\n© 2024 Firm %d Ltd. All Rights Reserved" % n
    body = [f"Guide to topic number {w}{n}\n\nWe met clients about {w}{n} in May and the desk of {w} checked file {n} before the first visit was over.\n\nAnother sentence about {w} and {n} follows here, and it is long enough to be read by everyone." for w in "abcdefgh"]
    return [(f"s{n}", f"https://s{n}/{i}", f"Guide to topic number {i}", f"{menu}\n\n{b}\n\n{foot}") for i, b in enumerate(body)]


def test_labels_on_sites_not_seen(spark):
    train = [p for n in range(20) for p in site(n)]
    model = boilerplate.train(pages(spark, train))
    got = boilerplate.label(pages(spark, site(99)), model).collect()
    assert len(got) == 8
    for r in got:
        assert {1} | {9, 10} == set(r.furniture) and "We met clients" in r.body


def test_labeller_on_awkward_rows(spark):
    model = boilerplate.train(pages(spark, []))
    data = [("d", "u", None, None), ("d", "u", None, " \n "), (None, None, None, "word " * 60_000), ("d", "u", "Ok", "{{ x }}")]
    assert ids(boilerplate.label(pages(spark, data), model).select("page_id")) == [2]
    assert boilerplate.label(pages(spark, []), model).where(F.col("body").isNotNull()).count() == 0


def test_the_layout_tells_furniture_whose_words_were_never_seen(spark):
    """Held-out sites with every word of their furniture exchanged for another."""
    model = boilerplate.train(pages(spark, [p for n in range(20) for p in site(n)]))
    strange = {"Home": "Vuli", "Services": "Kemarods", "News": "Wofi", "Contact": "Zerupak", "Phone": "Gadok", "Firm": "Hube", "Ltd": "Psi", "Rights": "Mundes", "Reserved": "Lotavind", "All": "Tro"}

    def told(t):
        for a, b in strange.items():
            t = t.replace(a, b)
        return t

    got = boilerplate.label(pages(spark, [(d, u, title, told(t)) for d, u, title, t in site(77)]), model).collect()
    want = {1, 9, 10}
    found = sum(len(want & set(r.furniture)) for r in got)
    assert found >= 0.8 * len(want) * len(got) and all(len(set(r.furniture) - want) <= 1 for r in got)


def test_a_saved_labeller_is_the_same(spark, tmp_path):
    model = boilerplate.train(pages(spark, [p for n in range(3) for p in site(n)]))
    boilerplate.save(spark, model, f"file://{tmp_path}/m")
    again = boilerplate.load(spark, f"file://{tmp_path}/m")
    assert set(again.p) == set(model.p) and all((again.p[k] == model.p[k]).all() for k in model.p)


def test_names_whose_first_name_no_gazetteer_has(spark, monkeypatch):
    """Held out: with the whole gazetteer gone, contexts, titles and roles find the same persons."""
    lines = [
        "Complaints go to Dr Helena Brackshaw, 92-112 Beacon Rd., Pellminster XQ198HN, or by phone.", "By Marek Oskanell, 5 July 2023", "Sofia H. Wrennell – Practice Manager, WRENNELL@firm.test", "In November William T. Hallisby moved to 12 Mulberry Row, Copperham.",
        "The file shows the passport number as ZW3732936; Mrs Yardewold countersigned it.", "Jonathan Tarrowgrave – Head of Care", "Ask for Priya Penrograve, please.", "In February a trainee adviser had files open. By February it was done.",
    ]
    df = texts(spark, *(lines * 15))
    name_starts = lambda: {(r.row_key, r.start_at) for r in personal.find(df).where("kind = 'name'").collect()}
    known = name_starts()
    monkeypatch.setattr(personal, "FIRST_NAMES", frozenset())
    assert len(known) >= 7 * 15
    lost = {lines[k % len(lines)] for k, _ in known - name_starts()}
    assert not lost, lost
