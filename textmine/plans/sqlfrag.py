"""SQL fragments for the DuckDB twins of the registered queries.

They restate each operator's definition in plain SQL over the same parquet
views, independently of the Spark plan (long forms, joins and windows).
"""

from __future__ import annotations

from textmine.functions.text import WORD_TOKEN_RE, drop_token_regex, sql_str
from textmine.sources.testdata import INJECT_SQL, LABEL_SQL


def token_filter(var="x", numbers=False, punct=False, symbols=False, url=False) -> str:
    rx = drop_token_regex(numbers, punct, symbols, url)
    cond = f"{var} <> ''"
    return cond if rx is None else f"{cond} AND NOT regexp_matches({var}, {sql_str(rx)})"


def word_tokens(text="text", **flags) -> str:
    return (f"list_filter(regexp_extract_all({text}, {sql_str(WORD_TOKEN_RE)}, 0), "
            f"lambda x: {token_filter('x', **flags)})")


def ws_tokens(text="text", punct=False, numbers=False) -> str:
    return f"list_filter(string_split(coalesce({text}, ''), ' '), lambda x: {token_filter('x', numbers=numbers, punct=punct)})"


def ngram_list(toks: str, n: int) -> str:
    if n == 1:
        return toks
    return (f"CASE WHEN len({toks}) >= {n} THEN list_transform(range(1, len({toks}) - {n - 2}), "
            f"lambda i: array_to_string({toks}[i:i + {n - 1}], '_')) ELSE []::VARCHAR[] END")


def ngrams_1_3(toks: str) -> str:
    return f"list_concat({ngram_list(toks, 1)}, {ngram_list(toks, 2)}, {ngram_list(toks, 3)})"


DOCS = "SELECT doc_id, text FROM documents"
LABELLED = f"SELECT d.doc_id, d.text, {LABEL_SQL} AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
MARKED = f"SELECT doc_id, {INJECT_SQL} AS text FROM documents"
MARKED_LABELLED = (f"SELECT d.doc_id, {INJECT_SQL.replace('text', 'd.text')} AS text, {LABEL_SQL} AS label "
                   f"FROM documents d JOIN labels l ON d.doc_id = l.doc_id")


def explode(src: str, arr: str, keep="doc_id") -> str:
    """Long form with 1-based positions."""
    return (f"SELECT {keep}, unnest(_a) AS term, CAST(generate_subscripts(_a, 1) AS INTEGER) AS pos "
            f"FROM (SELECT {keep}, {arr} AS _a FROM ({src}))")


# ------------------------------------------------------------ markers (C)
def c1(text: str, target="CIT", other="OTH", markup="bare") -> str:
    from textmine.operators.markers import _q
    for m in (target, other):
        rx = f"(?i)<({_q(m)})>.+?</({_q(m)})>" if markup == "tags" else f"(?i)<({_q(m)})>"
        text = f"regexp_replace({text}, {sql_str(rx)}, {sql_str(m)}, 'g')"
    return text


def c2(text: str, target="CIT", other="OTH") -> str:
    from textmine.operators.markers import group_rules
    for rx, rep in group_rules(target, other):
        text = f"regexp_replace({text}, {sql_str(rx)}, {sql_str(rep)}, 'g')"
    return text


def c3(text: str, target="CIT", other="OTH") -> str:
    """Look-around replaced by capture groups (RE2 has no look-around)."""
    from textmine.operators.markers import _q, marker_order
    for m in marker_order(target, other):
        rx = f"(^|[,;'\".] ){_q(m)}(SYN)*( [[:alnum:]])"
        text = f"regexp_replace({text}, {sql_str(rx)}, {sql_str(chr(92) + '1' + m + 'SYN' + chr(92) + '3')}, 'g')"
    return text


def c4(text: str, preps, target="CIT", other="OTH") -> str:
    from textmine.operators.markers import _q, marker_order, prep_lookbehind
    alt = prep_lookbehind(preps)
    for m in marker_order(target, other):
        rx = f"({alt}) {_q(m)}"
        text = f"regexp_replace({text}, {sql_str(rx)}, {sql_str(chr(92) + '1 ' + m + 'SYN')}, 'g')"
    return text


def c5(text: str, target="CIT", other="OTH", glue=True) -> str:
    from textmine.operators.markers import _q, marker_order
    for m in marker_order(target, other):
        text = f"regexp_replace({text}, {sql_str(f' ({_q(m)})([^A-z]|$)')}, {sql_str('' if glue else ' ')}, 'g')"
    return text


def clean_text(text: str, preps) -> str:
    return c5(c4(c3(c2(c1(text))), preps))


def values(rows, cols) -> str:
    """VALUES table literal."""
    body = ", ".join("(" + ", ".join(sql_str(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(cols)}))"
