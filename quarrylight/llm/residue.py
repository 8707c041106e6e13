"""Template residue and error-page text (problem 7).

Lines are counted by host in their letters-only form, and those that recur over
its addresses are boilerplate.  What is left, the residual, is looked through
for evidence: an unfilled placeholder, a tool's default wording or filler text
excludes a page; an error, blocking, login, maintenance or script notice does
if no sentence of the residual is content.  Evidence that is mentioned, in
quotation marks or by a sentence about templates, is none.
"""

from __future__ import annotations

import bisect
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.lines import exploded, letters
from quarrylight.runtime import bound_batches, cut

#: Unfilled placeholders of template languages and merge tools.
PLACEHOLDERS = (
    r"\{\{[^{}\n]{0,80}\}\}",
    r"\{%[^{}\n]{1,80}%\}",
    r"<%[^%\n]{0,80}%>",
    r"<\?(?:php|=)",
    r"\$\{[\w.\- ]{1,60}\}",
    r"#\{[\w.\- ]{1,60}\}",
    r"%%[a-z_]{2,30}%%",
    r"%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%",
    r"\*\|[A-Z0-9_:]{2,40}\|\*",
    r"\[\[[+*~$!%]?[\w.\-]{2,60}\]\]",
    r"\[(?:[Ii]nsert|[Yy]our|[Ee]nter|[Aa]dd|[Tt]own|[Yy]ear|[Cc]ompany|[Cc]lient|[Cc]ustomer|[Ff]irst|[Ll]ast|[Cc]ity|[Dd]ate|[Nn]ame|[Pp]hone|[Aa]ddress|[Pp]age|[Ss]ite|[Pp]ractice|[Ff]irm|[Tt]itle|[Pp]laceholder|INSERT|YOUR|ENTER|ADD|COMPANY|CLIENT|CITY|DATE|NAME|PHONE|ADDRESS|PAGE|SITE|TITLE|PLACEHOLDER)[ _a-zA-Z]{0,40}\]",
    r"(?:__|@@|##)[A-Z][A-Z_]{2,30}(?:__|@@|##)",
    r"(?<![\w={,])\{\d{1,2}\}",
    r"\{[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\}|\{[a-z]+(?:_[a-z]+)+\}|\{\$[\w.]{1,40}\}",
    r"\[%[^%\n]{1,60}%\]|<<[A-Za-z][A-Za-z_ ]{1,40}>>",
    r"(?<![\w%])%(?:[1-9]\$)?[sd](?![\w%])",
    r"\((?:insert|INSERT|Insert) [A-Za-z _]{2,40}\)|<(?:insert|INSERT|Insert|your|YOUR|Your) [A-Za-z _]{2,40}>",
    r"\[/?(?:vc|et_pb|fusion|av|wp)_[a-z_]+[^\]\n]{0,120}\]|\[/?(?:caption|gallery|contact-form-7|shortcode)\b[^\]\n]{0,120}\]",
    r"\bundefined\b.{0,40}\bNaN\b",
    r"\[object Object\]",
)

#: Filler and default wording of tools.
FILLER = (
    r"lorem ipsum",
    r"\b(?:dolor sit amet|consectetur adipiscing|sed do eiusmod|incididunt ut labore|ut enim ad minim|quis nostrud|duis aute irure|excepteur sint|nullam quis risus|vestibulum id ligula|mollit anim id est)\b",
    r"\byour (?:text|content|headline|title|tagline) (?:goes |comes )?here\b",
    r"double-click (?:here )?to edit",
    r"click (?:here )?to (?:edit this|add your own|change this)",
    r"add your (?:own )?(?:text|content) (?:here|and edit)|\bedit me\b",
    r"\bTODO: ?\w",
    r"\bX{4,} X{4,}\b",
    r"replace this (?:copy|text|content)",
    r"this is (?:a|an|your) (?:sample|example|first|dummy|placeholder) (?:page|post|text|paragraph)",
    r"welcome to your new (?:site|website|blog|page)",
    r"edit or delete it, then start writing",
    r"(?:this is )?(?:dummy|placeholder|sample|filler) (?:text|copy|content)\b",
    r"\bhello world!",
    r"\b(?:text|heading|subheading|caption|description|logo|image) (?:goes|comes) here\b",
    r"\b(?:type|enter) your (?:own )?(?:text|content)\b",
    r"\bthis is (?:a|an|your) (?:heading|headline|subheading|text block|paragraph)\b",
    r"just another (?:\w+ )?(?:site|weblog|blog)",
)

#: Titles that only a tool writes, whole.
DEFAULT_TITLES = (
    r"untitled(?: document| page| \d+)?",
    r"new page(?: \d+)?",
    r"(?:home|homepage|welcome)? ?[-|–] ?just another (?:\w+ )?site",
    r"(?:your )?(?:page|site|company) (?:title|name)(?: goes)? here",
    r"page title",
    r"title(?: here| goes here)",
    r"sample page",
    r"(?:undefined|null|nan)(?: ?[-|–] ?.*)?",
    r"default (?:web site )?(?:page|title)",
)

#: Titles that a tool or a person may have written; they count where there is no content.
DOUBTFUL_TITLES = (r"document", r"index", r"(?:your )?(?:site|company|page) (?:name|title)", r"home ?page", r"title")

#: The sentences of error, blocking, login, maintenance and script notices.
NOTICES = (
    r"^\W*(?:error )?[45]\d\d\W*$",
    r"^\W*(?:http )?error ?:? ?[345]\d\d\b",
    r"^\W*[45]\d\d [-|:]? ?(?:not found|forbidden|unauthori[sz]ed|internal server error|bad gateway|service unavailable|gateway time-?out)",
    r"page (?:you (?:are looking|requested|were looking)[^.]{0,40}|requested )?(?:cannot|could not|can't|couldn't|can not|was not|is not|not) (?:be )?found",
    r"page not found|file not found|\bnot found\W*$",
    r"sorry, (?:the|this|that) (?:page|file|link)",
    r"it may have been (?:moved|deleted|removed)",
    r"^\W*(?:internal server error|bad gateway|service unavailable|bad request|forbidden|unauthori[sz]ed)",
    r"(?:the )?server (?:met|encountered) an (?:unexpected|internal)",
    r"(?:an )?(?:unexpected|internal) error (?:has )?occurred",
    r"something went wrong",
    r"^\W*access (?:is |was )?denied",
    r"you (?:don't|do not) have permission",
    r"your (?:session|login) has (?:expired|timed out)",
    r"please (?:log|sign) ?in (?:again )?(?:to|or)\b",
    r"you (?:must|need to) (?:be logged|log|sign) ?in",
    r"(?:enable|turn on|activate|requires?|needs?) (?:javascript|scripts|cookies)\b",
    r"javascript is (?:switched off|disabled|required|not enabled|turned off)",
    r"turn scripts on",
    r"checking (?:your|the|if the) (?:browser|connection|site)",
    r"(?:verify|confirm|prove)(?: that)? you are (?:a )?human|are you a robot|complete the captcha",
    r"account (?:has been|is|was) suspended",
    r"(?:site|domain|page) (?:has been|is|was) (?:suspended|parked|for sale)",
    r"(?:we'll|we will|we’ll) be (?:right )?back",
    r"(?:under|down for|undergoing|scheduled|planned|essential|routine) (?:(?:planned|scheduled|essential|routine) )?(?:construction|maintenance)",
    r"^\W*coming soon",
    r"index of /",
    r"backend fetch failed|guru meditation",
    r"(?:fatal error|warning|notice|parse error): (?:uncaught|\w+_?\w*\(\)|undefined|call to|syntax)",
    r"error establishing a database connection",
    r"traceback \(most recent call last\)",
    r"browser (?:is )?(?:not supported|out of date|too old)",
    r"(?:the )?requested (?:url|resource|page)",
    r"too many requests|rate limit",
    r"you have been blocked|unable to access|request (?:has been )?blocked",
    r"seite (?:wurde )?(?:leider )?nicht gefunden|angeforderte seite|existiert (?:leider )?nicht",
    r"page (?:introuvable|non trouvée)|n'existe (?:pas|plus)|erreur \d{3}",
    r"p[áa]gina no (?:encontrada|se ha encontrado|existe)|no se ha encontrado",
    r"wartungsarbeiten|en maintenance|en mantenimiento",
    r"zugriff verweigert|accès refusé|acceso denegado",
)

#: Sentences that accompany a notice.
COMPANIONS = (
    r"try again|contact (?:the webmaster|your hosting|the administrator|support|us)|back to (?:the )?(?:homepage|home|start)|go (?:back|home)|return to",
    r"check back|come back (?:soon|later)|please wait|this process is automatic|reload|refresh|will be redirected",
    r"^\W*(?:trace|reference|request id|ray id|incident|error code|xid)\b",
    r"cache server|parent directory|last modified|allow|generated by|apache|nginx|\bport \d+",
    r"thank you for your patience|thanks for your patience|apolog|inconvenience|working on it|as soon as possible",
    r"check the (?:address|url|link|spelling)|mistyped|out of date link|use the (?:menu|search)|search (?:the|our) site",
    r"versuchen sie|später (?:noch einmal|erneut)|zur startseite|überprüfen sie|bitte (?:wenden|laden|prüfen)",
    r"réessayer|plus tard|page d'accueil|retour à|vérifiez|veuillez",
    r"inténtelo|más tarde|página de inicio|volver a|compruebe|por favor",
)

#: Sentences of site furniture, which are no content even where a host has too few pages to show it.
FURNITURE = (
    r"cookie|consent|small files on your device|privacy|your (?:device|choices|settings)|accept all",
    r"©|all rights reserved|registered (?:in|office|with)|company number|vat (?:no|number)|authorised and regulated|regulated by|liability|website may be|calls may be|(?:is|are) not advice|terms (?:and|&) conditions",
    r"newsletter|in your inbox|subscribe|no spam|share this|follow us|print this|email a friend|helpful\?",
    r"\w@\w|\(at\)|\[at\]",
)

#: Each placeholder needs one of these signs, each filler and each notice one of these stems in lower case.
#: They must let through whatever the patterns match, as the tests check for every branch.
SIGNS = ("{", "<%", "<?", "<<", "(insert", "<insert", "<your", "%", "*|", "[", "__", "@@", "##", "undefined")
FILLER_STEMS = (
    "lorem ipsum", "dolor sit", "consectetur", "sed do eiusmod", "incididunt", "ad minim", "quis nostrud", "duis aute", "excepteur", "quis risus", "vestibulum id", "mollit anim",
    "text here", "content here", "headline here", "title here", "tagline here", "goes here", "comes here", "here to", "to edit", "click to", "add your", "edit me", "type your", "enter your", "todo:", "xxxx", "replace this", "this is a", "this is your", "your new", "edit or delete", "dummy", "placeholder", "sample", "filler", "hello world", "just another",
)
NOTICE_STEMS = (
    "error 3", "error 4", "error 5", "error3", "error4", "error5", "error:", "error :", "error  ", "server error", "expected error", "internal error", "fatal error", "error establishing", "error has", "error occurred", "not found", "be found", "t found", "forbidden", "unauthori", "unavailable", "bad gateway", "bad request", "404", "403", "500", "502", "503", "sorry", "may have been", "went wrong", "denied", "permission", "has expired", "timed out", "log in", "login", "sign in", "signin", "log-in", "sign-in", "logged in", "loggedin", "gateway time", "server met", "server encountered",
    "javascript", "scripts", "enable cookies", "require cookies", "requires cookies", "need cookies", "needs cookies", "turn on cookies", "activate cookies", "checking your", "checking the", "checking if", "a human", "you are human", "a robot", "captcha", "suspended", "parked", "for sale", "be back", "be right back", "under construction", "for construction", "under maintenance", "for maintenance", "undergoing", "scheduled", "planned ", "essential maintenance", "essential construction", "essential essential", "essential routine", "routine maintenance", "routine construction", "routine essential", "routine routine", "coming soon", "index of /", "fetch failed", "guru meditation", "uncaught", "warning:", "notice:", "traceback", "not supported", "out of date", "too old", "requested ", "too many requests", "rate limit", "blocked", "unable to",
    "nicht gefunden", "angeforderte", "existiert", "introuvable", "non trouv", "existe", "no encontrada", "ha encontrado", "erreur", "wartung", "en maintenance", "mantenimiento", "verweigert", "refusé", "denegado",
)

#: The one notice without a stem: a status alone on its line.
STATUS_LINE = r"(?m)^[^\w\n]*[45]\d\d[^\w\n]*$"

#: A sentence is content from so many words on if it has an end mark, or from twice as many if it has none but runs in lower case.
CONTENT_WORDS = 6
#: A line on so many addresses of a host is boilerplate for notices; one with a placeholder only if it also stands on this share of them.
RECURRENT, RECURRENT_SHARE = 3, 0.2


def _any(patterns: tuple[str, ...], flags: int = re.IGNORECASE) -> re.Pattern:
    return re.compile("(?:" + "|".join(patterns) + ")", flags)


#: Words of a sentence that speaks about placeholders instead of leaving one.
_ABOUT = r"\b(?:placeholders?|templates?|variables?|syntax|merge (?:tags?|fields?)|shortcodes?|snippets?|mark-?up|curly|braces|brackets|source code|tokens?|write|type|such as|for example|e\.g\.)\b"


class Judge:
    """Reads one page; patterns are compiled once for each worker."""

    def __init__(self):
        self.folded, self.exact, self.filler = _any(PLACEHOLDERS[:7]), _any(PLACEHOLDERS[7:], 0), _any(FILLER)
        self.titles, self.doubtful = (re.compile("^(?:" + "|".join(x) + ")$", re.IGNORECASE) for x in (DEFAULT_TITLES, DOUBTFUL_TITLES))
        self.notices, self.explained = _any(NOTICES), _any(NOTICES + COMPANIONS + FURNITURE)
        self.quoted = re.compile("“[^”\n]{0,120}”|«[^»\n]{0,120}»|„[^“\n]{0,120}“|\"[^\"\n]{0,120}\"|`[^`\n]{0,120}`")
        self.about, self.sentence, self.status = re.compile(_ABOUT, re.IGNORECASE), re.compile(r"(?<=[.!?…])\s+"), re.compile(STATUS_LINE)
        self.word = re.compile(r"[^\W\d_]{2,}")
        kinds: dict[str, int] = {}
        for words, kind in ((SIGNS, 1), (FILLER_STEMS, 1), (NOTICE_STEMS, 2)):
            for w in words:
                kinds[w] = kinds.get(w, 0) | kind
        self.stems = ahocorasick.Automaton()
        for w, kind in kinds.items():
            self.stems.add_word(w, kind)
        self.stems.make_automaton()

    def holding(self, text: str) -> tuple[list[str], list[str]]:
        """The lines that may hold residue, and those that may hold a notice: one pass over the text finds all stems."""
        low = text.lower()
        hits = list(self.stems.iter(low))
        if not hits:
            return [], []
        lines, ends, at = text.split("\n"), [], 0
        for x in low.split("\n"):
            at += len(x) + 1
            ends.append(at)
        found: dict[int, int] = {}
        for end, kind in hits:
            i = bisect.bisect_right(ends, end)
            found[i] = found.get(i, 0) | kind
        return [lines[i] for i, kind in sorted(found.items()) if kind & 1], [lines[i] for i, kind in sorted(found.items()) if kind & 2]

    def left(self, line: str) -> bool:
        """Whether a line holds a placeholder or filler that is left over, not spoken of."""
        line = self.quoted.sub(" ", line)
        low = line.lower()
        if any(x in low for x in SIGNS):
            for s in self.sentence.split(line):
                bare = self.exact.sub(" ", self.folded.sub(" ", s))
                if bare != s and not self.about.search(bare):
                    return True
        return bool(self.filler.search(line))

    def content(self, line: str) -> bool:
        """Whether a sentence of the line is neither a notice, nor what goes with one, nor furniture."""
        return any(self.runs(s.strip()) and not self.explained.search(s) for s in self.sentence.split(line))

    def runs(self, s: str) -> bool:
        """Whether it reads as a sentence; menus, addresses and headings do not."""
        words = self.word.findall(s)
        if s.endswith((".", "!", "?", "…", "”", '"', "»", "…]", ":")):
            return len(words) >= CONTENT_WORDS
        return len(words) >= 2 * CONTENT_WORDS and sum(w[0].islower() for w in words) * 2 > len(words)

    def __call__(self, title: str | None, text: str) -> tuple[bool, list[str], list[str] | None] | None:
        """``(residue in the title, lines with residue, lines with content)``; the last is None without a notice, all is None without evidence."""
        title = (title or "").replace("\u00a0", " ").strip()
        text = text.replace("\u00a0", " ")
        maybe, notes = self.holding(title)
        titled = bool(self.titles.match(title)) or any(self.left(x) for x in maybe)
        noticed = bool(self.doubtful.match(title) or self.status.search(title)) or any(self.notices.search(x) for x in notes)
        maybe, notes = self.holding(text)
        lines = [x for x in dict.fromkeys(maybe) if self.left(x)]
        noticed = noticed or any(self.notices.search(x) for x in notes) or bool(self.status.search(text))
        if not (titled or lines or noticed):
            return None
        return titled, lines, [x for x in text.split("\n") if self.content(x)] if noticed else None


def _evidence_batches(batches):
    judge = Judge()
    for batch in batches:
        keys, hosts, titles, texts = (c.to_pylist() for c in batch.columns)
        out = [(k, h, *f) for k, h, t, x in zip(keys, hosts, titles, texts) if (f := judge(t, x))]
        types = [batch.schema.field(0).type, pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["_k", "_s", "_titled", "_residue", "_content"])


def evidence(pages: DataFrame, key: str = "page_id", host: str = "domain", address: str = "url", title: str = "title", text: str = "text") -> DataFrame:
    """One row per page with evidence: ``key`` and ``kind``.

    ``kind`` is ``placeholder`` (an unfilled placeholder, a tool's default
    wording or filler text in the title, or in a line that is no boilerplate of
    the host) or ``notice`` (the text holds a notice, or the title is one or
    may be a tool's, and no sentence outside the host's recurrent lines is
    content).  A page with null or blank text is never reported, whatever its
    title.  Repeated rows are judged one by one; a null host is a host of its
    own; an empty table gives no rows; other columns are ignored.
    """
    p = pages.select(F.col(key).alias("_k"), F.coalesce(host, F.lit("\u0000")).alias("_s"), F.xxhash64(F.coalesce(F.col(address), F.lit("\u0000"))).alias("_u"), F.col(title).alias("_title"), F.col(text).alias("_t"))
    p = p.where(F.col("_t").rlike(r"[^\s\u00a0]"))
    # Counting covers every line of every page: distinct addresses by host and normal form, summed before they are compared.
    every = exploded(p, "_t", "_s", "_u").select("_s", "_u", letters("line").alias("_n")).where("_n <> ''").select(F.xxhash64("_s", "_n").alias("_h"), F.xxhash64("_s").alias("_d"), "_u")
    counts = every.groupBy("_h", "_u").agg(F.min("_d").alias("_d")).groupBy("_h").agg(F.count("*").alias("_docs"), F.min("_d").alias("_d")).where(F.col("_docs") >= RECURRENT)
    sizes = p.select(F.xxhash64("_s").alias("_d"), "_u").distinct().groupBy("_d").agg(F.count("*").alias("_all"))
    recurrent = counts.join(sizes, "_d").select("_h", (F.col("_docs") >= F.col("_all") * RECURRENT_SHARE).alias("_everywhere"))
    bound_batches(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    # Cut, as both kinds read it: the texts pass through Python once.
    judged = cut(p.select("_k", "_s", "_title", "_t").mapInArrow(_evidence_batches, f"_k {kind}, _s string, _titled boolean, _residue array<string>, _content array<string>").withColumn("_row", F.monotonically_increasing_id()), "residue")
    # A page's identity here is its row, so repeated keys are not merged by chance.
    lines = judged.select("_row", "_s", F.explode(F.concat(F.transform("_residue", lambda x: F.struct(x.alias("line"), F.lit(True).alias("left"))), F.transform(F.coalesce("_content", F.array().cast("array<string>")), lambda x: F.struct(x.alias("line"), F.lit(False).alias("left"))))).alias("_x"))
    lines = lines.select("_row", F.xxhash64("_s", letters("_x.line")).alias("_h"), F.col("_x.left").alias("_left"), (letters("_x.line") == "").alias("_bare"))
    met = lines.join(recurrent, "_h", "left").groupBy("_row").agg(
        F.bool_or(F.col("_left") & (F.col("_bare") | ~F.coalesce("_everywhere", F.lit(False)))).alias("_residual"),
        F.bool_or(~F.col("_left") & F.col("_everywhere").isNull()).alias("_holds"))
    whole = judged.join(met, "_row", "left")
    why = F.when(F.col("_titled") | F.coalesce("_residual", F.lit(False)), "placeholder").when(F.col("_content").isNotNull() & ~F.coalesce("_holds", F.lit(False)), "notice")
    return whole.select(F.col("_k").alias(key), why.alias("kind")).where("kind is not null")


def usable(pages: DataFrame, key: str = "page_id", **columns: str) -> DataFrame:
    """The pages that hold content: those without evidence of residue or a notice."""
    return pages.join(evidence(pages, key, **columns).select(key), key, "left_anti")
