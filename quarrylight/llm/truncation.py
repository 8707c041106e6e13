"""Text cut off by field limits (problem 2), in Spark SQL.

Every line of every text is turned into word trigrams, padded at the start of
the line.  A trigram is *terminal* where a sentence or the line ends with it,
and *internal* where the sentence goes on.  The last trigram of each text is
joined with all trigrams of the same two leading words whose third word begins
with its last word, since a cut may fall within a word.  A text whose ending is
frequent inside texts and almost never terminal was cut.

What follows the statistics is exact: an ending with a sentence mark was not
cut, nor was one whose last line stands as a whole line elsewhere, apart from
its names and numbers; and where the corpus knows nothing of the two words, a
last line that runs like prose decides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from quarrylight.runtime import cut

#: An ending counts as almost never terminal up to this share of its occurrences.
MAX_TERMINAL = 0.2
#: Occurrences that an ending needs to be judged by the statistics.
MIN_SEEN = 2
#: Occurrences from which an ending that never is terminal counts as cut even in a line that looks like a label.
SURE_SEEN = 8
#: A marked or closing line of few words that so many texts end with is a label of its own.
LABEL_LINES = 5
LABEL_WORDS = 6
#: Words from which a last line without known context counts as running prose.
PROSE_WORDS = 12
#: Letters of a last word that are part of its key.
HEAD = 3

#: Marks for omitted text that may follow a cut, at the very end.
OMISSION = r"(?<![\\s\\x{00a0}])[\\s\\x{00a0}]*+(?:\\.\\.\\.|…|\\[\\s*(?:\\.\\.\\.|…|cut|truncated|more)?\\s*\\]?|\\((?:\\.\\.\\.|…|cut|truncated|more)\\)?)[\\s\\x{00a0}]*$"

#: Bits for each ending, and the least and most bits, of the filters that keep work off rows no ending asks for.  They only
#: save work: rows that pass by chance are dropped by the joins.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 26

_SQL = {
    # Blank ends go; a text of blanks has no ending.
    "t_texts": r"""
        SELECT _k, IF(right(_t, 1) IN (' ', '\n', '\t', '\r', ' '), trim(TRAILING ' \n\t\r ' FROM _t), _t) AS _t
        FROM t_input""",
    # The ending of each text: its last line, and the words of it before any mark for omitted text.
    "t_finals": r"""
        SELECT _k, _line, _marked, _w, size(_w) AS _m, coalesce(get(_w, size(_w) - 1), '') AS _word
        FROM (SELECT _k, _line, _marked, {words:trim(IF(_marked, regexp_replace(_line, '{omission}', ''), _line))} AS _w
              FROM (SELECT _k, _line, _line RLIKE '{omission}' AS _marked
                    FROM (SELECT _k, {clean:substring_index(_t, '\n', -1)} AS _line FROM t_texts WHERE _t <> '')))""",
    "t_open": r"""
        SELECT *, NOT (_closed OR _prose AND _m >= {long}) AS _asks,
               IF(_closed OR _prose AND _m >= {long}, NULL, xxhash64({form})) AS _f,
               IF(_closed OR _prose AND _m >= {long}, NULL, {opening}) AS _g
        FROM (SELECT _k, _marked, _m, _line, {bare} AS _bare,
                     xxhash64(coalesce(lower(get(_w, _m - 3)), '<s>'), coalesce(lower(get(_w, _m - 2)), '<s>')) AS _c,
                     lower(trim(TRAILING '{strip}' FROM _word)) AS _x,
                     right(_word, 1) IN ({closers}) AND NOT (_marked AND right(_word, 1) = ')') AS _closed,
                     _line RLIKE '[.!?] \\p{Lu}' AS _prose
              FROM t_finals)""",
    # A last word may be a fragment: its first letters are part of the key that it shares with longer words.
    "t_asked": r"""SELECT DISTINCT _c, _x, left(_x, {head}) AS _h FROM t_open WHERE NOT _closed AND _x <> ''""",
    "t_contexts": r"""SELECT _c & {mask} AS _p FROM t_open WHERE NOT _closed""",
    "t_openings": r"""SELECT _g & {mask} AS _p FROM t_open WHERE _asks""",
    # One bit for each asked value: an array of fixed length.
    "t_contextbits": r"""{bitmap:t_contexts}""",
    "t_openingbits": r"""{bitmap:t_openings}""",
    # Every line of every text; of the last one the last word is the ending itself.
    "t_lines": r"""
        SELECT _line, _i = _n - 1 AS _final
        FROM (SELECT _l, size(_l) AS _n FROM (SELECT split(_t, '\n') AS _l FROM t_texts)) LATERAL VIEW posexplode(_l) AS _i, _line
        WHERE _line <> ''""",
    "t_trigrams": r"""
        SELECT _c, _word, get(_w, _j + 1) AS _next
        FROM (SELECT xxhash64(coalesce(get(_w, _j - 2), '<s>'), coalesce(get(_w, _j - 1), '<s>')) AS _c, _word, _j, _w, _final
              FROM (SELECT {words:lower({clean:_line})} AS _w, _final FROM t_lines) LATERAL VIEW posexplode(_w) AS _j, _word)
        WHERE bit_get((SELECT _bits FROM t_contextbits)[CAST(shiftright(_c & {mask}, 6) AS INT)], CAST(_c & 63L AS INT)) = 1
              AND NOT (_final AND get(_w, _j + 1) IS NULL)""",
    # Third word, and whether the sentence or label ends with it; bars and bullets part labels.
    "t_counts": r"""
        SELECT _c, _x, sum(IF(_end, 0L, 1L)) AS _inner, sum(IF(_end, 1L, 0L)) AS _outer, sum(_trails) AS _trails
        FROM (SELECT _c, IF(_next IS NULL AND right(_word, 1) = '…', 1L, 0L) AS _trails, trim(TRAILING '{strip}' FROM _word) AS _x,
                     right(_word, 1) IN ({closers}) OR _next IS NULL OR _next = '' OR left(_next, 1) IN ('|', '•', '·', '–', '-', '>', '(') AS _end
              FROM t_trigrams)
        WHERE _x <> '' GROUP BY _c, _x""",
    "t_known": r"""
        SELECT a._c, a._x,
               sum(IF(c._x = a._x, c._inner, 0L)) AS _inner, sum(IF(c._x = a._x, c._outer, 0L)) AS _outer,
               sum(IF(c._x = a._x, c._trails, 0L)) AS _trails,
               sum(IF(c._x = a._x, 0L, c._inner + c._outer)) AS _longer
        FROM t_asked a JOIN (SELECT *, explode(transform(sequence(1, least({head}, length(_x))), n -> left(_x, n))) AS _h FROM t_counts) c
             ON a._c = c._c AND a._h = c._h AND startswith(c._x, a._x)
        GROUP BY a._c, a._x""",
    # Whole lines, apart from names and numbers: how often they stand inside texts, and at their ends.
    "t_forms": r"""
        SELECT _f, sum(_inside) AS _inside, count(*) AS _lines
        FROM (SELECT xxhash64({form}) AS _f, 1L AS _inside
              -- Generated columns are computed once; the filter would have them again for each place it names them.
              FROM (SELECT _line AS _raw FROM t_lines WHERE NOT _final) LATERAL VIEW inline(array(named_struct('_line', {clean:_raw}))) AS _line
                   LATERAL VIEW inline(array(named_struct('_bare', {bare}))) AS _bare LATERAL VIEW inline(array(named_struct('_g', {opening}))) AS _g
              WHERE bit_get((SELECT _bits FROM t_openingbits)[CAST(shiftright(_g & {mask}, 6) AS INT)], CAST(_g & 63L AS INT)) = 1
              UNION ALL SELECT _f, 0L AS _inside FROM t_open WHERE _asks)
        GROUP BY _f""",
    "t_judged": r"""
        SELECT o.*, coalesce(k._inner, 0L) AS _inner, coalesce(k._outer, 0L) AS _outer, coalesce(k._longer, 0L) AS _longer, coalesce(k._trails, 0L) AS _trails
        FROM t_open o LEFT JOIN t_known k ON o._c = k._c AND o._x = k._x""",
    "t_cut": r"""
        SELECT j._k, CASE
            WHEN j._closed THEN false
            WHEN j._inner + j._outer = 0 AND j._longer >= {min_seen} THEN true
            WHEN j._outer = 0 AND j._inner + j._longer >= {sure} THEN true
            WHEN f._inside > 0 AND NOT j._marked OR f._lines >= {recurs} AND j._m <= {label_words} THEN false
            WHEN j._marked THEN j._trails < {min_seen}
            WHEN j._m >= {prose_words} AND j._prose THEN true
            WHEN j._inner + j._longer + j._outer >= {min_seen} THEN j._outer <= {max_terminal} * (j._inner + j._longer + j._outer)
            ELSE j._m >= {prose_words}
          END AS truncated
        FROM t_judged j LEFT JOIN t_forms f ON j._f = f._f""",
}

#: A line's form: a counter in brackets at its end goes, e-mail addresses become E, words with digits 9, names after the first word C.
_FORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(_line, '(?<! ) *+\\(\\d+\\)$', ''), '(?<![^ ])[^ ]+@[^ ]+', 'E'), '(?<![\\p{L}\\p{N}])[\\p{L}\\p{N}]*\\p{N}[\\p{L}\\p{N}]*', '9'), '(?<=[^\\p{L}\\p{N}_])\\p{Lu}[\\p{L}\'’]*', 'C')"

#: An array of longs with a bit for every value of a view.
_BITMAP = r"""
    SELECT transform(array_sort(collect_list(struct(_i, _v))), e -> e._v) AS _bits
    FROM (SELECT CAST(r.id AS INT) AS _i, coalesce(g._v, 0L) AS _v
          FROM range({words}) r LEFT JOIN
               (SELECT _p DIV 64 AS _i, bit_or(shiftleft(1L, CAST(_p % 64 AS INT))) AS _v FROM {view} GROUP BY _p DIV 64) g
          ON r.id = g._i)"""

#: What lines of one form share, at little cost: the number of blanks, a first word of letters, and a second and last one in
#: lower case; forms leave these as they are, once the counter at the end is gone.
_OPENING = (
    r"xxhash64(octet_length(_bare) - octet_length(replace(_bare, ' ', '')), IF(substring_index(_bare, ' ', 1) RLIKE '^\\p{L}+$' AND substring_index(_bare, ' ', 1) <> 'E', substring_index(_bare, ' ', 1), ''), "
    r"IF(instr(_bare, ' ') > 0 AND substring_index(substring_index(_bare, ' ', 2), ' ', -1) RLIKE '^\\p{Ll}+$', substring_index(substring_index(_bare, ' ', 2), ' ', -1), ''), "
    r"IF(instr(_bare, ' ') > 0 AND substring_index(_bare, ' ', -1) RLIKE '^\\p{Ll}+$', substring_index(_bare, ' ', -1), ''))"
)
_BARE = r"IF(right(_line, 1) = ')', regexp_replace(_line, '(?<! ) *+\\(\\d+\\)$', ''), _line)"

#: One rule for cleaning and splitting a line, inside texts and at their ends.
_RULES = ((re.compile(r"\{clean:([^{}]*)\}"), lambda m: f"trim(replace({m[1]}, '\u00a0', ' '))"), (re.compile(r"\{words:((?:[^{}]|\{omission\})*)\}"), lambda m: f"split(replace({m[1]}, '  ', ' '), ' ')"))

_VALUES = {
    "{opening}": _OPENING,
    "{bare}": _BARE,
    "{omission}": OMISSION,
    "{form}": _FORM,
    "{strip}": r".,;:!?)”\"»›…\'’",
    "{closers}": r"'.', '!', '?', '»', '”', '\"', '›', ')', '|', '…'",
    "{min_seen}": str(MIN_SEEN),
    "{max_terminal}": str(MAX_TERMINAL),
    "{prose_words}": str(PROSE_WORDS),
    "{long}": str(2 * PROSE_WORDS),
    "{sure}": str(SURE_SEEN),
    "{recurs}": str(LABEL_LINES),
    "{label_words}": str(LABEL_WORDS),
    "{head}": str(HEAD),
}


def truncated(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """``(key, truncated)`` for each row with a text that is neither null nor blank.

    Null, empty and blank texts have no ending and give no row.  Repeated rows
    are judged one by one.  An empty table gives an empty result; columns
    besides ``key`` and ``text`` are ignored.
    """
    spark = pages.sparkSession
    rows = {"t_input": pages.selectExpr(f"`{key}` AS _k", f"`{text}` AS _t").where("_t IS NOT NULL")}
    values = dict(_VALUES)
    for name, sql in _SQL.items():
        for pattern, by in _RULES:
            sql = pattern.sub(by, sql)
        for what, value in values.items():
            sql = sql.replace(what, value)
        used = {x: rows[x] for x in set(re.findall(r"\bt_[a-z]+\b", sql))}
        # spark.sql names DataFrames in braces; all other braces are doubled.
        sql = re.sub(r"\b(t_[a-z]+)\b", r"{\1}", sql.replace("{", "{{").replace("}", "}}"))
        rows[name] = spark.sql(sql, **used)
        if name == "t_open":  # read five times below, and no larger than one line for each text
            rows[name] = cut(rows[name], "endings")
            bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * rows[name].count()).bit_length()))
            values |= {f"{{bitmap:{x}}}": _BITMAP.replace("{words}", str(bits // 64)).replace("{view}", x) for x in ("t_contexts", "t_openings")} | {"{mask}": f"{bits - 1}L"}
    return rows["t_cut"].withColumnRenamed("_k", key)


def rates(pages: DataFrame, bundles: DataFrame) -> DataFrame:
    """How often each ``snapshot_source`` truncates: pages, truncated pages, rate, and what the bundles say."""
    spark = pages.sparkSession
    return spark.sql(
        """
        SELECT b.snapshot_source, count(*) AS pages, count_if(t.truncated) AS truncated_pages,
               count_if(t.truncated) / count(*) AS rate, count_if(t.truncated AND b.truncated) AS declared_too,
               count_if(t.truncated AND b.truncated IS NULL) AS undeclared
        FROM {p} p JOIN {b} b ON p.bundle_id = b.bundle_id JOIN {t} t ON p.page_id = t.page_id
        GROUP BY b.snapshot_source""",
        p=pages.select("page_id", "bundle_id"), b=bundles.select("bundle_id", "snapshot_source", "truncated"), t=truncated(pages),
    )
