"""Personal information inside free text (problem 5).

Candidate spans of five kinds are proposed generously.  Several labelers vote
on each: patterns of the value itself, gazetteers, and the words on its left
and right; each says yes, no or nothing.  How reliable a labeler is nobody
says: expectation-maximisation estimates it, and each candidate's probability,
from the counts of all vote patterns.  With these probabilities as soft labels
a logistic classifier is trained on votes and shape, and it decides about the
spans.  Votes and shapes are discrete, so both fits work on pattern counts of
the whole corpus, a table whose size does not grow with it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.runtime import bound_batches, cut

KINDS = ("email", "phone", "id_number", "address", "name")
#: The most, in nats, that a labeler's silence may say.
SILENCE = 0.5

#: Common first names and their short forms, of several languages.
FIRST_NAMES = frozenset(
    (
        "adam agnes ahmed alan albert alex alexander alice alicia amara amelia amina amy ana andrea andrew angela anita ann anna anne anthony antonio arthur aisha "
        "barbara beatrix ben benjamin bernard beth brian bruno callum carl carlos carmen caroline catherine charles charlotte chen chloe chris christine christopher claire clara colin "
        "daniel david deborah denise dmitri dominic donald dorothy edward elena eleanor elizabeth emily emma eric eva evelyn fatima felix fiona francesca frank frederick "
        "gareth george gerald grace graham greta hamish hannah harold harriet harry hassan heather helen helena henry hugo ian ibrahim idris imogen ingrid irene isabel ivan "
        "jack jacob james jane jean jennifer jessica joan johan john jonathan jose joseph juan julia karen karl kate katherine kenneth kevin klaus kwame laura lars leila leo linda louis louise lucy luis "
        "marek margaret maria marie mark martha martin mary matthew mei michael miguel mohammed monica nadia natalie nicholas nina noah oliver olivia oluwa oscar owen pablo patricia paul pedro peter philip pierre priya "
        "rachel rafael raj rebecca rhys richard robert rosa ruth samuel sandra sarah siobhan sofia sophie stephen susan tamsin thomas tomasz uwe victor walter wei william yusuf zara"
    ).split()
)
#: Titles, street words, months and words of identity numbers.
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Professor Sir Dame Rev Herr Frau Mme Mlle Sr Sra".split()
STREETS = (
    "Street St Road Rd Lane Ln Avenue Ave Row Way Close Crescent Cres Terrace Ter Boulevard Blvd Drive Court Ct Square Sq Gardens Grove Hill Mews Walk Parade Quay Place Pl Highway Hwy Parkway Pkwy Circle Alley Wharf"
).split()
MONTHS = "January February March April May June July August September October November December".split()
PLACE_ENDS = ("haven", "stead", "minster", "ford", "port", "combe", "mere", "wick", "ley", "ton", "bury", "ham", "chester", "mouth", "bridge", "vale", "heath", "cross", "green", "hall", "trust", "house", "mill", "street", "road", "lane", "row", "way", "terrace", "close", "crescent", "avenue")
FIRM_ENDS = frozenset("limited ltd plc llp llc inc incorporated gmbh sarl group services clinic practice solicitors homes centre center agents technologies advisers management international pharmacy studio policy statement protection sheet".split())
COMMON_CAPITALS = frozenset(
    "the a an our we you your in on at by of for from if when while not most some both nobody expect ask please since there it this that home contact news menu search page back read see share print order reference sample batch company number vat phone tel call write mail email data protection keys complaints quote form file with and or to is are be has have had no yes all any each every after before during within shortly long".split()
    + "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split()
)

_MONTH = "|".join(MONTHS)
_TITLE_BEFORE = re.compile(rf"(?:^|[^\w])(?:{'|'.join(TITLES)})\.? $")
_CAPITAL = re.compile(r"[A-ZÀ-Þ](?:\.|[\w'’]+(?:-[A-ZÀ-Þ][\w'’]+)*)")
_NAME_LEFT = re.compile(r"(?:(?:^|^\W*)By|\b(?:[Pp]osted|[Ww]ritten|[Rr]eviewed|[Ee]dited|[Cc]ompiled|[Pp]repared|[Ss]igned|[Pp]ublished|[Cc]hecked|[Uu]pdated|[Aa]pproved|[Aa]uthored|POSTED|WRITTEN|REVIEWED) (?:by|BY)|contact:|CONTACT:|[Aa]sk for|[Mm]ark it for|opened for|says|said|go to|met|thanks to|thanks go to|signed|[Dd]ear|attention of|care of|c/o|regards,|(?:Author|Name|Contact|Manager|Director|Officer):)(?: (?:" + "|".join(TITLES) + r")\.?)? $")
_NAME_RIGHT = re.compile(rf"^(?:, \d{{1,2}} (?:{_MONTH})|, (?:{_MONTH})| [–-] [A-Z]| moved to| by name| countersigned| and kept|[’']s | \((?:[A-Z]|passport|social|born|aged)|, (?:Flat|Unit|Apt|\d)| signed| wrote| will call| for their help|[,”] who |,” (?:says|said))")
_TITLE_WORDS = frozenset(t.lower() for t in TITLES)
_LEFT_WORDS = frozenset("by contact for says said to met signed dear of c/o regards author name manager director officer".split())
#: Particles within names.
_PARTICLES = re.compile(r" (?:(?:de|del|de la|de las|de los|la|da|das|do|dos|di|du|von|van|van der|van den|von der|zu|zur|ter|ten|bin|ibn|al|el|y|e) )+")
_PERSON_RIGHT = re.compile(r"^(?: moved to| countersigned| and kept| by name| for their help|, who | signed)")
_ROLE_RIGHT = re.compile(r"^ [–-] [A-Z]")
#: What persons of a staff list are.
_ROLE = re.compile(r"^ [–-] (?:[A-Z][\w&]+ (?:of |and |for )?){0,4}(?:Manager|Lead|Head|Director|Partner|Officer|Coordinator|Negotiator|Valuer|Nurse|Dentist|Doctor|Solicitor|Adviser|Advisor|Surveyor|Secretary|Assistant|Associate|Consultant|Therapist|Hygienist|Principal|Founder|Owner|Chair|Trustee|Paralegal|Pharmacist|Technician|Receptionist|Administrator|Accountant|Counsel|Care)\b")
_PLACE_LEFT = re.compile(r"\b(?:in|near|from|around|across|outside|[Tt]he) $")

_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+(?:@| ?[\[(](?:at|AT)[\])] ?)[\w-]+(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[\w-]+)+")
_DIGITS = re.compile(r"(?<![\w.,£$€#-])(?:\+ ?|\()?\d[\d ().\-/]{3,30}\d(?![\w£$€%]|[.,-]\d)")
_LETTERED = re.compile(r"(?<![\w-])(?:[A-Z]{1,3} ?\d[\d ]{4,9}\d(?: ?[A-D](?![\w-]))?|\d{7,8}-?[A-Z])(?![\w-])")
_PHONE_STRICT = re.compile(r"(?:(?:\+|00)\d{1,3}[ .\-]?)?(?:\(0\) ?|\(?0?\d{2,5}\)?[ .\-])?\d{2,6}(?:[ .\-]\d{2,4}){0,4}$|0\d{9,10}$|\+\d{9,14}$")
_PHONE_LEFT = re.compile(r"(?:\b(?:[Pp]hone|[Tt]el|[Tt]elephone|[Cc]all|[Cc]all us|[Tt]ext|[Rr]ing|[Mm]obile|[Ff]ax|[Ff]on|[Hh]otline|[Nn]umber|phone on|[Tt]eléfono|[Tt]éléphone|WhatsApp|T|M)[.:]? ?(?:on |us on |us at |at )?| \| |^)$")
_NOT_PHONE = re.compile(r"(?i:\b(?:vat|company|tax|order|reference|ref|batch|invoice|sample|account|registration|registered|charity|sku|isbn|serial|case|file|claim|policy|licence|form|passport|nhs|ssn|social security|national insurance|ni|nino|emirates|insurance|id)\b[^.;]{0,24}|GB )$")
_ID_LEFT = re.compile(r"(?i:\b(?:passport|nhs|ssn|social security|national insurance|ni|nino|emirates id|identity|identity card|id card|national id|driving licence|driver['’]?s licen[cs]e|medicare|medicaid|patient|health|insurance number|dni|nie|nif personal|sécurité sociale|sozialversicherungs\w*|personalausweis\w*|reisepass\w*|pasaporte|passeport)\b(?: (?:number|no|nr|num|card))?[.:]{0,2}(?: ?(?:as|is|was|:|#))? ?)$")
_NOT_ID = re.compile(r"(?i:\b(?:vat|company|tax|order|reference|batch|invoice|sample|sku|registration|phone|tel|text|ring|call)\b[^.;]{0,24})$")
_ID_STRICT = re.compile(r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d\d ?\d\d ?\d\d ?[A-D]$|\d{3}-\d{2}-\d{4}$|\d{3} \d{3} \d{4}$|784-\d{4}-\d{7}-\d$|[A-Z]{1,2}\d{6,9}$|\d{8}-?[A-Z]$|[12] \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?$")
_ADDRESS = re.compile(
    r"(?<![\w£$€.,-])(?:(?:Flat|Unit|Apartment|Apt\.?|Suite|Studio|Room|FLAT|UNIT|SUITE) \w{1,5},? )?\d{1,5}(?:[-–]\d{1,5})?[A-Za-z]?,? (?:(?:E|W|N|S|East|West|North|South)\.? )?(?:[A-ZÀ-Þ][\w'’]*\.? ){1,4}?(?:"
    + "|".join(STREETS + [s.upper() for s in STREETS])
    + r")\b\.?"
)
_ADDRESS_ELSEWHERE = re.compile(
    r"(?<![\w£$€.,-])\d{1,4}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse) [\w'’ -]{3,40}|\b[A-ZÄÖÜ][\wäöüß-]+(?:straße|strasse|weg|gasse|platz|allee) \d{1,4}[a-z]?\b|\b(?:Calle|Avenida|Plaza|Paseo) [A-ZÁÉÍÓÚÑ][\wáéíóúñ ]{2,30}, ?\d{1,4}"
)
_POSTCODE = re.compile(r"^\.?(?:, ?(?:Suite|Apt|Unit|Floor) \w+)?,? ?[A-ZÀ-Þ][\w'’-]+(?:[ -](?:[A-ZÀ-Þ][\w'’-]*|on|upon|under|le|la|de|sur|am|an|der)){0,4},? ?(?:[A-Z]{1,2}\d[\dA-Z]? ?\d[A-Z]{2}|\d{5}(?:-\d{4})?)\b")
_TOWN = re.compile(r"^\.?(?:, ?(?:Suite|Apt|Unit|Floor) \w+)?, ?[A-ZÀ-Þ][\w'’]{2,}(?: [A-ZÀ-Þ][\w'’]{2,})?")
_ADDRESS_LEFT = re.compile(r"(?:moved to|held at|lives at|living at|address(?: is|:)|based at|visit us at| at|sent to|, |^) ?$")
_DIGIT, _NUMBERED, _LETTER_DIGIT = re.compile(r"\d"), re.compile(r"\d[A-Za-z]?,? [A-ZÀ-Þ]"), re.compile(r"[A-Z] ?\d|\d-?[A-Z]")
_ROMANCE = ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "allée ", "impasse ", "straße ", "strasse ", "weg ", "gasse ", "platz ", "allee ", "Calle ", "Avenida ", "Plaza ", "Paseo ")
_AT = re.compile(r"@| ?[\[(]at[\])]")
_BREAKS = re.compile(r"[^\n]+")


def _signs(*tests) -> str:
    """Votes as text: + for yes, - for no, 0 for nothing."""
    return "".join("+" if t is True or t == 1 else "-" if t == -1 else "0" for t in tests)


def _place(word: str) -> bool:
    low = word.lower()
    return low in FIRM_ENDS or (len(low) > 3 and low.endswith(PLACE_ENDS))


def _names(line: str, local: str):
    caps = [(m.start(), m.end(), m.group()) for m in _CAPITAL.finditer(line)]
    done = -1
    for i, (a, b, w) in enumerate(caps):
        if a < done:
            continue
        first = w.lower() in FIRST_NAMES
        initial = len(w) == 2 and w[1] == "."
        left = line[max(0, a - 40) : a]
        before = left.rsplit(None, 1)[-1].lower().strip(".,;:(“") if left.strip() else ""
        titled = before in _TITLE_WORDS and bool(_TITLE_BEFORE.search(left))
        named = (titled or before in _LEFT_WORDS) and bool(_NAME_LEFT.search(left))
        if not (first or initial or titled or named) or w in TITLES:
            # SURNAME, First
            if i + 1 < len(caps) and len(w) > 2 and caps[i + 1][2].lower() in FIRST_NAMES and line[b : caps[i + 1][0]] == ", ":
                last = i + 1
                follows = caps[i + 2] if i + 2 < len(caps) else None
                full = follows and line[caps[last][1] : follows[0]] == " " and len(follows[2]) > 2 and not w.isupper()
                if full or _place(w) and not w.isupper():
                    continue
                end = caps[last][1]
                if follows and len(follows[2]) == 2 and line[end : follows[0]] == " " and follows[2][1] == ".":
                    end = follows[1]
                right = line[end : end + 30]
                done = end
                yield a, end, _signs(True, titled, named, bool(_NAME_RIGHT.match(right)), w.isupper() or w.lower() not in COMMON_CAPITALS, w.lower() in local), "s"
            elif i + 1 < len(caps) and len(w) > 2 and w not in TITLES and w.lower() not in COMMON_CAPITALS:
                # A first name that no gazetteer has: what persons do, or a role, follows.
                nxt, gap = caps[i + 1][2], line[b : caps[i + 1][0]]
                last, end = (nxt, caps[i + 1][1]) if gap == " " else (w, caps[i + 1][1]) if gap == ", " and w.isupper() else ("", 0)
                if gap == " " and len(nxt) == 2 and nxt[1] == "." and i + 2 < len(caps) and line[end : caps[i + 2][0]] == " ":
                    last, end = caps[i + 2][2], caps[i + 2][1]
                elif len(nxt) <= 2:
                    last = ""
                if len(last) > 2 and not _place(w) and not _place(last) and nxt.lower() not in COMMON_CAPITALS and last.lower() not in COMMON_CAPITALS:
                    right = line[end : end + 40]
                    known, begins = last.lower() in local, not line[:a].strip(" •-–*·|»")
                    if _PERSON_RIGHT.match(right) or known and _ROLE_RIGHT.match(right) or begins and _ROLE.match(right):
                        done = end
                        yield a, end, _signs(0, 0, 0, True, True, known), "2u"
            continue
        # The parts that follow, parted by single blanks.
        parts, end = [w], b
        j, surnames = i, 0
        if not initial and i + 1 < len(caps) and line[b : caps[i + 1][0]] == ", " and caps[i + 1][2].lower() in FIRST_NAMES and (titled or named or w.isupper()) and not first:
            j, end, parts = i + 1, caps[i + 1][1], [w, caps[i + 1][2]]
        linked = False
        while j + 1 < len(caps):
            nxt, gap = caps[j + 1][2], line[end : caps[j + 1][0]]
            # Particles join parts; after one, or after several given names, a second surname may follow.
            particle = bool(_PARTICLES.fullmatch(gap))
            if not particle and gap != " ":
                break
            given = parts[-1].lower() in FIRST_NAMES
            if not particle and len(parts) > 1 and len(parts[-1]) > 2 and not given and not linked:
                break
            if not particle and linked and (nxt.lower() in COMMON_CAPITALS or _place(nxt) or len(parts) > 1 and not given and surnames > 1):
                break
            linked = linked or particle
            surnames = 1 if particle or given or len(parts[-1]) <= 2 else surnames + 1
            if nxt.lower() in FIRM_ENDS or nxt in STREETS:
                parts.append("Limited")
                break
            parts.append(nxt)
            end = caps[j + 1][1]
            j += 1
        if len(parts) == 1 and (initial or not (titled or named)):
            continue
        if initial and len(parts[-1]) == 2:
            continue
        # An initial at the end keeps its full stop only within the name.
        right = line[end : end + 30]
        surname = next((p for p in reversed(parts) if len(p) > 2), "")
        shaped = -1 if any(p.lower() in FIRM_ENDS or p.lower() in COMMON_CAPITALS for p in parts[:2]) or _place(surname) and not (titled or first) else surname[:1].isupper()
        context = True if named else -1 if _PLACE_LEFT.search(left) and not titled else 0
        done = end
        yield a, end, _signs(True if first else 0, titled, context, bool(_NAME_RIGHT.match(right)), shaped, surname.lower() in local), f"{min(len(parts), 3)}{'i' if initial else 'f'}"


def _line_spans(line: str, local: str) -> list[tuple]:
    """Candidates of one line: ``(kind, start, end, votes, shape)``, positions from 0."""
    out, taken = [], []
    digits = _DIGIT.search(line)
    if "@" in line or "at)" in line or "at]" in line or "AT)" in line or "AT]" in line:
        for m in _EMAIL.finditer(line):
            value = m.group().rstrip(".-_")
            plain = "@" in value
            left = line[max(0, m.start() - 24) : m.start()]
            out.append(("email", m.start(), m.start() + len(value), _signs(plain, bool(re.search(r"(?i:e-?mail|mail|write|send|to|at|or|e)[: ]+$|[|(,] ?$", left)), bool(re.search(r"[.\])] ?[A-Za-z]{2,}$", value)), len(value) < 80 or -1), "p" if plain else "o"))
            taken.append((m.start(), m.end()))
    if digits:
        found = list(_ADDRESS.finditer(line)) if _NUMBERED.search(line) else []
        if any(x in line for x in _ROMANCE):
            found += _ADDRESS_ELSEWHERE.finditer(line)
        for m in found:
            left, right = line[max(0, m.start() - 30) : m.start()], line[m.end() : m.end() + 60]
            post = _POSTCODE.match(right)
            town = post or _TOWN.match(right)
            out.append(("address", m.start(), m.end() + (town.end() if town else 0), _signs(True, bool(post), True if town else 0, bool(_ADDRESS_LEFT.search(left)), -1 if re.search(r"(?i:page|chapter|no\.|between \d{4} and|£)\s*$", left) else 0), "f" if m.group()[0].isalpha() else "n"))
            taken.append((m.start(), m.end() + (town.end() if town else 0)))
        for pattern, lettered in ((_DIGITS, False), (_LETTERED, True)) if _LETTER_DIGIT.search(line) else ((_DIGITS, False),):
            for m in pattern.finditer(line):
                a, b = m.start(), m.end()
                value = m.group()
                if not lettered and value.count("(") < value.count(")"):
                    continue
                if any(x < b and a < y for x, y in taken):
                    continue
                n = sum(c.isdigit() for c in value)
                left, right = line[max(0, a - 44) : a], line[b : b + 24]
                id_left, not_id, strict_id = bool(_ID_LEFT.search(left)), bool(_NOT_ID.search(left)), bool(_ID_STRICT.match(value))
                if strict_id or id_left:
                    out.append(("id_number", a, b, _signs(strict_id or -1, id_left, -1 if not_id else 0, -1 if _PHONE_LEFT.search(left) and not id_left else 0), "l" if lettered else "d"))
                if not lettered and n >= (5 if _PHONE_LEFT.search(left) else 7):
                    strict = bool(_PHONE_STRICT.match(value)) and (9 <= n <= 14)
                    lead = value[0] in "+(" or value.startswith("0")
                    out.append(("phone", a, b, _signs(strict or -1, bool(_PHONE_LEFT.search(left)), -1 if _NOT_PHONE.search(left) or id_left else 0, lead or -1, bool(re.match(r",? ?(?:ext|x)\b| \| ", right))), "+" if value[0] == "+" else "(" if value[0] == "(" else "0" if value[0] == "0" else "d"))
    for a, b, votes, shape in _names(line, local):
        if not any(x < b and a < y for x, y in taken):
            out.append(("name", a, b, votes, shape))
    return out


def spans_of(text: str, cache: dict) -> list[tuple]:
    """All candidates of a text, positions from 1 in characters."""
    out = []
    # Local parts of mail addresses are a gazetteer of the text's own.
    mails = _AT.split(text)[:-1] if "@" in text or "at)" in text or "at]" in text else ()
    local = " ".join(x.rsplit(None, 1)[-1] for x in mails if x.strip()).lower()
    for m in _BREAKS.finditer(text):
        line = m.group()
        # Short lines recur all over a site; those without names do not depend on the text.
        found = cache.get(line) if len(line) < 200 else None
        if found is None:
            found = _line_spans(line, local)
            if len(line) < 200 and not any(f[0] == "name" for f in found):
                if len(cache) > 50_000:
                    cache.clear()
                cache[line] = found
        for kind, a, b, votes, shape in found:
            out.append((kind, m.start() + a + 1, m.start() + b + 1, votes, shape))
    return out


def _candidate_batches(batches):
    cache: dict = {}
    for batch in batches:
        origin, key, text = (c.to_pylist() for c in batch.columns)
        rows = [(o, k, *s) for o, k, t in zip(origin, key, text) for s in spans_of(t, cache)]
        cols = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["origin", "row_key", "kind", "start_at", "end_at", "votes", "shape"])


_SCHEMA = "origin string, row_key long, kind string, start_at int, end_at int, votes string, shape string"


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 60) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns each pattern's probability of being real, and for each labeler how
    often it says yes on real and on other candidates.
    """
    votes = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    # The majority of the votes to begin with, softly.
    p = 1 / (1 + np.exp(-(votes.sum(1) - 0.5)))
    likelihood = []
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
        log = np.full(len(n), np.log(prior) - np.log(1 - prior))
        likelihood = []
        for j in range(votes.shape[1]):
            yes, no = [], []
            for v in (1, 0, -1):
                here = votes[:, j] == v
                # A labeler is taken to be better than chance: pseudo-counts lean that way.
                yes.append((n * p)[here].sum() + (2 if v == 1 else 1))
                no.append((n * (1 - p))[here].sum() + (2 if v == -1 else 1))
            yes, no = np.array(yes) / sum(yes), np.array(no) / sum(no)
            likelihood.append((float(yes[0]), float(no[0])))
            # A yes never speaks against a value nor a no for it, and silence says little either way; without that, classes may
            # form around which labelers have anything to say instead of what is real.
            says = np.log(yes / no)
            says = np.array([max(says[0], 0.0), np.clip(says[1], -SILENCE, SILENCE), min(says[2], 0.0)])
            log += says[1 - votes[:, j]]
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return {x: float(y) for (x, _), y in zip(patterns, p)}, likelihood


def _features(votes: str, shape: str, shapes: list[str]) -> list[float]:
    return [1.0, *(float(v == "+") for v in votes), *(float(v == "-") for v in votes), *(float(shape == s) for s in shapes)]


def classifier(rows: list[tuple[str, str, int]], steps: int = 300) -> dict[tuple[str, str], float]:
    """Probability of each ``(votes, shape)``: a logistic classifier trained on the estimated labels."""
    by_votes: dict[str, int] = {}
    for v, _, n in rows:
        by_votes[v] = by_votes.get(v, 0) + n
    soft, _ = reliabilities(sorted(by_votes.items()))
    shapes = sorted({s for _, s, _ in rows})
    x = np.array([_features(v, s, shapes) for v, s, _ in rows])
    y, n = np.array([soft[v] for v, _, _ in rows]), np.array([c for *_, c in rows], float)
    n = n / n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-5 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (p - y)) + 1e-5 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {(v, s): float(q) for (v, s, _), q in zip(rows, p)}


def _table(candidates: DataFrame) -> list[tuple[str, str, str, float]]:
    """The probability of each kind, votes and shape; bounded by the labelers and shapes, not by the corpus."""
    patterns = candidates.groupBy("kind", "votes", "shape").count().collect()
    table = []
    for kind in KINDS:
        own = sorted((r["votes"], r["shape"], r["count"]) for r in patterns if r["kind"] == kind)
        table += [(kind, v, s, p) for (v, s), p in classifier(own).items()] if own else []
    return table


def _candidates(texts: DataFrame) -> DataFrame:
    bound_batches(texts.sparkSession)
    rows = texts.select(F.col("origin").cast("string"), F.col("row_key").cast("long"), "text").where("text is not null")
    return cut(rows.mapInArrow(_candidate_batches, _SCHEMA), "spans")


def find(texts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(origin, row_key, kind, start_at, end_at, probability)`` of each value in ``texts(origin, row_key, text)``.

    Positions count characters from 1; ``end_at`` is the position after the
    last one.  Of values that overlap the more probable one stays.  Null and
    blank texts hold nothing; rows with one key are one text; a value is looked
    for within its line.  An empty table gives an empty result; other columns
    are ignored.
    """
    candidates = _candidates(texts)
    known = texts.sparkSession.createDataFrame(_table(candidates), "kind string, votes string, shape string, probability double")
    judged = candidates.join(F.broadcast(known), ["kind", "votes", "shape"]).where(F.col("probability") >= threshold)
    # Of spans that overlap the more probable one stays; a text's spans are few and lie in order.
    best = Window.partitionBy("origin", "row_key").orderBy("start_at", F.desc("probability"), "kind", "end_at")
    beaten = (F.lag("end_at").over(best) > F.col("start_at")) & (F.lag("probability").over(best) >= F.col("probability")) | (F.lead("start_at").over(best) < F.col("end_at")) & (F.lead("probability").over(best) > F.col("probability"))
    return judged.withColumn("_beaten", F.coalesce(beaten, F.lit(False))).where("not _beaten").select("origin", "row_key", "kind", "start_at", "end_at", "probability")


def redacted(texts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The texts with a typed placeholder such as ``[EMAIL]`` in place of each value; the rest is left as it was.

    Texts do not move: once the small table of probabilities is known, each is
    read again where it lies.  All columns are kept; a null text stays null.
    """
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast({(k, v, s): p for k, v, s, p in _table(_candidates(texts)) if p >= threshold})
    at = texts.columns.index("text")

    def batches(rows):
        cache: dict = {}
        for batch in rows:
            out = [redact(t, spans_of(t, cache), known.value) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return texts.mapInArrow(batches, texts.schema)


def redact(text: str, spans: list[tuple], known: dict) -> str:
    """One text with placeholders; of spans that overlap the more probable one stays."""
    sure = sorted((-known[k, v, s], a, b, k) for k, a, b, v, s in spans if (k, v, s) in known)
    taken: list[tuple[int, int, str]] = []
    for _, a, b, kind in sure:
        if all(b <= x or y <= a for x, y, _ in taken):
            taken.append((a, b, kind))
    out, done = [], 1
    for a, b, kind in sorted(taken):
        out += [text[done - 1 : a - 1], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done - 1 :]])
