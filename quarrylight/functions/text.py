"""Text expressions: markup, sentences, words, names, amounts.

All are Column expressions inside whole-stage code generation.  Word classes
are written out instead of a word boundary, which differs between engines for
accented letters; the no-break space counts as white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space with the no-break space, and the most common English words.
SPACE = "[ \\t\\n\\r\\f ]+"
STOPWORDS = "the a an of in to and for on with is are was were be you we our your at by from that as or it this not no".split()
NEGATIONS = "not never no without cannot neither nor".split()
#: Legal forms that normal names leave out.
LEGAL_FORMS = "limited ltd llp plc inc incorporated gmbh sarl llc corp company".split()
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def squeeze(c: Column | str) -> Column:
    """White space, no-break spaces included, as single blanks without ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip_html(c: Column | str) -> Column:
    """The visible text: scripts, styles and comments go first, unclosed ones to the end, then tags; entities are read."""
    s = F.regexp_replace(c, r"(?is)<(script|style|noscript)[^>]*>.*?(</(script|style|noscript)>|$)", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?(-->|$)", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for entity, plain in ENTITIES.items():
        s = F.replace(s, F.lit(entity), F.lit(plain))
    return squeeze(s)


def html_title(c: Column | str) -> Column:
    return squeeze(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_lang(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(c, r"(?is)<html[^>]*\slang=[\"']?([a-zA-Z]{2})", 1))


def hrefs(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?i)href=[\"']([^\"'#]+)"), F.lit(1))


def sentences(c: Column | str) -> Column:
    """Sentences in order: split after a closing mark before white space, and at line ends."""
    marked = F.regexp_replace(c, r"([.!?])[ \t]+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n+"), lambda x: F.trim(x)), lambda x: x != "")


def clauses(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(c, "[,;:]"), lambda x: F.trim(x)), lambda x: x != "")


def words(c: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def is_blank(c: Column | str) -> Column:
    """Whether a text holds nothing but white space; null for a null."""
    c = F.col(c) if isinstance(c, str) else c
    return ~c.rlike("[^ \\t\\n\\r\\f ]")


def count_words(c: Column | str) -> Column:
    """How many runs of ASCII letters and digits there are, counted in place."""
    return F.regexp_count(F.lower(c), F.lit("[a-z0-9]+"))


def count_known(c: Column | str, vocabulary: list[str]) -> Column:
    """How many of these runs are in a vocabulary, counted in place."""
    return F.regexp_count(F.lower(c), F.lit("(?<![a-z0-9])(?:" + "|".join(vocabulary) + ")(?![a-z0-9])"))


def each_word(c: Column | str) -> Column:
    """A row for each run, and for each empty string between two; these are left to a filter on rows, which is compiled."""
    return F.explode(F.split(F.lower(c), "[^a-z0-9]+"))


def is_prose(c: Column | str) -> Column:
    """25 characters, four words, no more than 70 % of them capitalised, and a lower-case letter."""
    c = F.col(c) if isinstance(c, str) else c
    words = F.regexp_count(c, F.lit("[^ \\t\\n\\r\\f ]+"))
    capital = F.regexp_count(c, F.lit("(?<![^ \\t\\n\\r\\f ])[A-Z]"))
    return (F.length(c) >= 25) & (words >= 4) & (capital * 10 <= words * 7) & c.rlike("[a-z]")


def holds_word(c: Column | str, *tokens: str) -> Column:
    """Whether any of the words stands whole in the text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(c).rlike("(^|[^a-z0-9_])(" + "|".join(tokens) + ")([^a-z0-9_]|$)")


def normal_name(c: Column | str) -> Column:
    """Lower case, ``and`` for ampersands, no punctuation, no legal form, single blanks."""
    s = F.regexp_replace(F.lower(c), "&", " and ")
    s = F.regexp_replace(s, "[^a-z0-9 ]+", " ")
    s = F.array_join(F.filter(F.split(s, " +"), lambda x: (x != "") & ~x.isin(*LEGAL_FORMS)), " ")
    return s


def slug(c: Column | str) -> Column:
    """Lower-case words of letters and digits joined by hyphens; accents are folded."""
    folded = F.translate(F.lower(c), "àáâäçèéêëìíîïñòóôöùúûü", "aaaaceeeeiiiinoooouuuu")
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def initials(c: Column | str) -> Column:
    return F.array_join(F.transform(F.filter(F.split(c, "[^A-Za-z]+"), lambda x: x != ""), lambda x: F.upper(F.substring(x, 1, 1))), "")


def amounts(c: Column | str) -> Column:
    """Pound amounts as doubles, thousands parted by commas."""
    return F.transform(F.regexp_extract_all(c, F.lit("£([0-9][0-9,]*)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def holds_number(c: Column | str, n: Column) -> Column:
    """Whether a number stands in the text as a whole token."""
    padded = F.concat(F.lit(" "), F.regexp_replace(c, "[^0-9]+", " "), F.lit(" "))
    return F.instr(padded, F.concat(F.lit(" "), n.cast("string"), F.lit(" "))) > 0
