"""Text column functions: cleaners, tokenisers, sentence splitting, n-grams.

All are built-in Spark expressions (regexp_replace chains, higher-order array
functions), so they stay inside whole-stage codegen and run on whole texts in
every partition. Each cleaner has a ``*_sql`` twin that renders the same rule list
as DuckDB SQL for the oracle checks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

SENT_SEP = "\u0001"
WORD_CLASS = r"[\p{L}\p{N}_]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- rule rendering ---------------------------------------------------------

def _java_repl(template: str) -> str:
    out = template.replace("\\", "\\\\").replace("$", "\\$")
    return out.replace("{1}", "$1")


def _re2_repl(template: str) -> str:
    return template.replace("\\", "\\\\").replace("{1}", "\\1")


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_META = set(".^$*+?()[]{}|\\")


def literal_of(pattern: str):
    """The plain text a pattern matches when it has no regex operators (escaped
    punctuation counts as its character), else None."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            if i + 1 < len(pattern) and not pattern[i + 1].isalnum():
                out.append(pattern[i + 1])
                i += 2
                continue
            return None
        if ch in _META:
            return None
        out.append(ch)
        i += 1
    return "".join(out)


def apply_rules(col, rules) -> Column:
    """Fold rewrite rules in order. Rules whose pattern is plain text (most of them)
    use literal replacement, which gives the same result without the regex engine."""
    c = _c(col)
    for pattern, repl in rules:
        lit = literal_of(pattern)
        if lit is not None and "{1}" not in repl:
            c = F.replace(c, F.lit(lit), F.lit(repl))
        else:
            c = F.regexp_replace(c, pattern, _java_repl(repl))
    return c


def apply_rules_sql(expr: str, rules) -> str:
    for pattern, repl in rules:
        lit = literal_of(pattern)
        if lit is not None and "{1}" not in repl:
            expr = f"replace({expr}, {sql_str(lit)}, {sql_str(repl)})"
        else:
            expr = f"regexp_replace({expr}, {sql_str(pattern)}, {sql_str(_re2_repl(repl))}, 'g')"
    return expr


def strip_ws(col) -> Column:
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def strip_ws_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


# -- cleaners ---------------------------------------------------------------

def clean_str(col) -> Column:
    """13 ordered rewrites, strip, lower-case. The backslash written before ( ) ? stays."""
    return F.lower(strip_ws(apply_rules(col, R.CLEAN_STR_RULES)))


def clean_str_sql(expr: str) -> str:
    return f"lower({strip_ws_sql(apply_rules_sql(expr, R.CLEAN_STR_RULES))})"


_SIMPLE_RULES = [(r"\\", ""), (r"'", ""), (r"\"", "")]


def clean_simple(col, collapse_whitespace: bool = True) -> Column:
    """Collapse whitespace (news-group corpora), drop backslash and quotes, strip, lower."""
    c = _c(col)
    if collapse_whitespace:
        c = F.regexp_replace(c, r"\s+", " ")
    return F.lower(strip_ws(apply_rules(c, _SIMPLE_RULES)))


def clean_simple_sql(expr: str, collapse_whitespace: bool = True) -> str:
    if collapse_whitespace:
        expr = f"regexp_replace({expr}, '\\s+', ' ', 'g')"
    return f"lower({strip_ws_sql(apply_rules_sql(expr, _SIMPLE_RULES))})"


def clean_text(col) -> Column:
    """96 ordered rewrites then whitespace collapse (single spaces, stripped)."""
    c = apply_rules(col, R.CLEAN_TEXT_RULES)
    return strip_ws(F.regexp_replace(c, r"\s+", " "))


def clean_text_sql(expr: str) -> str:
    e = apply_rules_sql(expr, R.CLEAN_TEXT_RULES)
    return strip_ws_sql(f"regexp_replace({e}, '\\s+', ' ', 'g')")


_EMAIL_RULES = [(r"\S*@\S*\s?", ""), (r"\s+", " "), (r"'", "")]


def clean_email(col) -> Column:
    return apply_rules(col, _EMAIL_RULES)


def clean_email_sql(expr: str) -> str:
    return apply_rules_sql(expr, _EMAIL_RULES)


# -- tokenisers -------------------------------------------------------------

def tokenize_en(col) -> Column:
    """Lower-case word tokens of two or more word characters (Unicode letters/digits/_)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_CLASS + "{2,}"), 0)


def tokenize_en_sql(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{WORD_CLASS}{{2,}}')"


def split_ws(col) -> Column:
    """Whitespace split without empty tokens (like Python's ``str.split()``)."""
    return F.filter(F.split(_c(col), r"\s+"), lambda t: t != F.lit(""))


def split_ws_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda t: t <> '')"


def tokenize_preproc(col) -> Column:
    """Whitespace tokens without digits and that are not a piece of the punctuation
    string (substring test), each stripped of non-word characters."""
    toks = F.filter(split_ws(col), lambda t: ~t.rlike(r"\p{Nd}") &
                    (F.instr(F.lit(R.PUNCTUATION), t) == 0))
    return F.transform(toks, lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_]+", ""))


def tokenize_preproc_sql(expr: str) -> str:
    punct = sql_str(R.PUNCTUATION)
    toks = (f"list_filter({split_ws_sql(expr)}, lambda t: NOT regexp_matches(t, '\\p{{Nd}}') "
            f"AND instr({punct}, t) = 0)")
    return f"list_transform({toks}, lambda t: regexp_replace(t, '[^\\p{{L}}\\p{{N}}_]+', '', 'g'))"


def split_sentences(col) -> Column:
    """Sentences end at . ! ? followed by whitespace, or at a line break."""
    marked = F.regexp_replace(F.regexp_replace(_c(col), r"([.!?])\s+", "$1" + SENT_SEP), r"\n", SENT_SEP)
    return F.filter(F.transform(F.split(marked, SENT_SEP), lambda s: strip_ws(s)),
                    lambda s: s != F.lit(""))


def split_sentences_sql(expr: str) -> str:
    marked = (f"regexp_replace(regexp_replace({expr}, '([.!?])\\s+', '\\1' || chr(1), 'g'), "
              f"'\\n', chr(1), 'g')")
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: "
            f"{strip_ws_sql('s')}), lambda s: s <> '')")


def remove_words(tokens, words) -> Column:
    """Drop tokens found in a fixed word list (array-local anti join)."""
    stop = F.array(*[F.lit(w) for w in words])
    return F.filter(_c(tokens), lambda t: ~F.array_contains(stop, t))


def remove_words_sql(tokens_sql: str, words) -> str:
    lst = "[" + ", ".join(sql_str(w) for w in words) + "]"
    return f"list_filter({tokens_sql}, lambda t: NOT list_contains({lst}, t))"


def remove_stopwords(col, method: str = "nltk") -> Column:
    words = R.ENGLISH_STOP_WORDS if method == "nltk" else R.SHORT_STOP_WORDS
    return F.array_join(remove_words(split_ws(col), words), " ")


def remove_stopwords_sql(expr: str, method: str = "nltk") -> str:
    words = R.ENGLISH_STOP_WORDS if method == "nltk" else R.SHORT_STOP_WORDS
    return f"array_to_string({remove_words_sql(split_ws_sql(expr), words)}, ' ')"


# -- n-grams and n-terms ------------------------------------------------------

def _grams(t: Column, n: int, join: str, skip: int) -> Column:
    """Contiguous (skip=0) or skip-grams of exactly n words, in position order."""
    L = F.size(t)
    if n == 1:
        return t
    if n == 2:
        def at(i):
            ks = F.sequence(F.lit(1), F.lit(skip + 1))
            g = F.transform(ks, lambda k: F.when(i + k < L, F.concat_ws(join, t[i], t[i + k])))
            return F.filter(g, lambda x: x.isNotNull())
        return F.flatten(F.transform(F.sequence(F.lit(0), L - 2), at))
    if n == 3:
        ks = F.sequence(F.lit(1), F.lit(skip + 1))

        def at(i):
            g = F.flatten(F.transform(ks, lambda k1: F.transform(
                ks, lambda k2: F.when((i + k1 < L) & (i + k1 + k2 < L),
                                      F.concat_ws(join, t[i], t[i + k1], t[i + k1 + k2])))))
            return F.filter(g, lambda x: x.isNotNull())
        return F.flatten(F.transform(F.sequence(F.lit(0), L - 3), at))
    if n == 4:
        return F.transform(F.sequence(F.lit(0), L - 4),
                           lambda i: F.concat_ws(join, t[i], t[i + 1], t[i + 2], t[i + 3]))
    raise ValueError(n)


def ngrams(tokens, n: int, join: str = "_", skip: int = 0) -> Column:
    """1- to 4-grams; a list shorter than n falls back to the next lower order
    (4 -> 3 -> 2 -> 1), as the original helpers do. Skip only for 2 and 3."""
    t = _c(tokens)
    L = F.size(t)
    if n == 4:
        skip = 0
    out = t
    for k in range(2, n + 1):
        out = F.when(L > k - 1, _grams(t, k, join, skip)).otherwise(out)
    return out


def ngrams_multi(tokens, code: int, join: str = " ") -> Column:
    """Codes 1, 2, 3, 4 as :func:`ngrams`; 12 and 123 concatenate the orders and
    drop fall-back items (those with the wrong number of words)."""
    t = _c(tokens)
    if code in (1, 2, 3, 4):
        return ngrams(t, code, join)
    L = F.size(t)
    parts = [t, F.when(L > 1, _grams(t, 2, join, 0)).otherwise(F.array().cast("array<string>"))]
    if code == 123:
        parts.append(F.when(L > 2, _grams(t, 3, join, 0)).otherwise(F.array().cast("array<string>")))
    elif code != 12:
        raise ValueError(code)
    return F.concat(*parts)


def _terms(t: Column, n: int, join: str) -> Column:
    """All ordered combinations of n positions i<j<k<l, in lexicographic position order."""
    L = F.size(t)
    if n == 2:
        return F.flatten(F.transform(F.sequence(F.lit(0), L - 2), lambda i: F.transform(
            F.sequence(i + 1, L - 1), lambda j: F.concat_ws(join, t[i], t[j]))))
    if n == 3:
        return F.flatten(F.transform(F.sequence(F.lit(0), L - 3), lambda i: F.flatten(F.transform(
            F.sequence(i + 1, L - 2), lambda j: F.transform(
                F.sequence(j + 1, L - 1), lambda k: F.concat_ws(join, t[i], t[j], t[k]))))))
    if n == 4:
        return F.flatten(F.transform(F.sequence(F.lit(0), L - 4), lambda i: F.flatten(F.transform(
            F.sequence(i + 1, L - 3), lambda j: F.flatten(F.transform(
                F.sequence(j + 1, L - 2), lambda k: F.transform(
                    F.sequence(k + 1, L - 1), lambda m: F.concat_ws(join, t[i], t[j], t[k], t[m]))))))))
    raise ValueError(n)


def nterms(tokens, n: int, join: str = "_") -> Column:
    """Ordered word combinations of size n (2..4) with fall-back to lower orders.

    The output has C(L, n) items, so apply it to short texts (names, titles);
    it is an array-local expression and never pairs rows."""
    t = _c(tokens)
    L = F.size(t)
    out = t
    for k in range(2, n + 1):
        out = F.when(L > k - 1, _terms(t, k, join)).otherwise(out)
    return out


# -- SQL twins of the n-gram builders (DuckDB lists are 1-based) ---------------

def _cat(parts, join):
    j = sql_str(join)
    return f" || {j} || ".join(parts)


def _grams_sql(t: str, n: int, join: str) -> str:
    if n == 1:
        return t
    parts = [f"{t}[i + {k + 1}]" for k in range(n)]
    return f"list_transform(range(0, len({t}) - {n - 1}), lambda i: {_cat(parts, join)})"


def ngrams_sql(t: str, n: int, join: str = "_") -> str:
    out = t
    for k in range(2, n + 1):
        out = f"(CASE WHEN len({t}) > {k - 1} THEN {_grams_sql(t, k, join)} ELSE {out} END)"
    return out


def ngrams_multi_sql(t: str, code: int, join: str = " ") -> str:
    if code in (1, 2, 3, 4):
        return ngrams_sql(t, code, join)
    empty = "CAST([] AS VARCHAR[])"
    parts = [t, f"(CASE WHEN len({t}) > 1 THEN {_grams_sql(t, 2, join)} ELSE {empty} END)"]
    if code == 123:
        parts.append(f"(CASE WHEN len({t}) > 2 THEN {_grams_sql(t, 3, join)} ELSE {empty} END)")
    return "list_concat(" + ", ".join(parts) + ")" if len(parts) == 2 else \
        f"list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]})"


def _terms_sql(t: str, n: int, join: str) -> str:
    j = sql_str(join)
    if n == 2:
        return (f"flatten(list_transform(range(0, len({t}) - 1), lambda a: list_transform("
                f"range(a + 1, len({t})), lambda b: {t}[a + 1] || {j} || {t}[b + 1])))")
    if n == 3:
        return (f"flatten(list_transform(range(0, len({t}) - 2), lambda a: flatten(list_transform("
                f"range(a + 1, len({t}) - 1), lambda b: list_transform(range(b + 1, len({t})), "
                f"lambda c: {t}[a + 1] || {j} || {t}[b + 1] || {j} || {t}[c + 1])))))")
    if n == 4:
        return (f"flatten(list_transform(range(0, len({t}) - 3), lambda a: flatten(list_transform("
                f"range(a + 1, len({t}) - 2), lambda b: flatten(list_transform(range(b + 1, len({t}) - 1), "
                f"lambda c: list_transform(range(c + 1, len({t})), lambda d: {t}[a + 1] || {j} || "
                f"{t}[b + 1] || {j} || {t}[c + 1] || {j} || {t}[d + 1])))))))")
    raise ValueError(n)


def nterms_sql(t: str, n: int, join: str = "_") -> str:
    out = t
    for k in range(2, n + 1):
        out = f"(CASE WHEN len({t}) > {k - 1} THEN {_terms_sql(t, k, join)} ELSE {out} END)"
    return out
