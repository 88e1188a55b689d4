"""Token operators.

Narrow form: ``(doc_id, ..., tokens ARRAY<STRING>)``; all array work is done
with higher-order functions inside one projection (no shuffle).
Long form: ``(doc_id, pos INT, term STRING)`` with 1-based positions,
produced by ``explode_tokens`` as late as possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmine.functions.text import (
    WORD_TOKEN_RE, drop_token_filter, glob_to_regex, is_glob,
)
from textmine.functions.lexicons import NEGATION_PATTERNS, NEGATION_WINDOW
from textmine.operators.util import broadcast_if_small

def _empty():
    return F.array().cast("array<string>")


# --------------------------------------------------------------- tokenizers
def word_tokens(text: Column, remove_numbers=False, remove_punct=False, remove_symbols=False,
                remove_url=False, split_hyphens=False) -> Column:
    """B1 word tokenizer as a column expression."""
    pattern = WORD_TOKEN_RE
    if split_hyphens:
        pattern = pattern.replace("[-'’]", "['’]")
    raw = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.filter(raw, drop_token_filter(remove_numbers, remove_punct, remove_symbols, remove_url))


def tokenize_words(df: DataFrame, text_col="text", out="tokens", **flags) -> DataFrame:
    """B1: word tokens with removal switches (numbers, punct, symbols, url, split_hyphens)."""
    return df.withColumn(out, word_tokens(F.col(text_col), **flags))


def ws_tokens(text: Column, remove_punct=False, remove_numbers=False) -> Column:
    """B2 whitespace tokenizer: split on single spaces, drop empties."""
    raw = F.split(F.coalesce(text, F.lit("")), " ")
    return F.filter(raw, drop_token_filter(remove_numbers, remove_punct, False, False))


def tokenize_ws(df: DataFrame, text_col="text", out="tokens", remove_punct=False,
                remove_numbers=False) -> DataFrame:
    return df.withColumn(out, ws_tokens(F.col(text_col), remove_punct, remove_numbers))


def posexplode1(df: DataFrame, array: Column, keep, pos="pos", value="term") -> DataFrame:
    """1-based posexplode.  ``posexplode_outer`` + a null filter keeps Spark
    from inferring a ``size(array) > 0`` filter that would be pushed below
    the projection and evaluate the array expression twice."""
    return (df.select(*keep, F.posexplode_outer(array).alias(pos, value))
            .filter(F.col(pos).isNotNull())
            .withColumn(pos, F.col(pos) + 1))


def explode_tokens(df: DataFrame, id_col="doc_id", tokens_col="tokens", term_col="term",
                   keep=()) -> DataFrame:
    """Narrow -> long form ``(doc_id, pos, term)`` with 1-based positions."""
    return posexplode1(df, F.col(tokens_col), [id_col, *keep], "pos", term_col)


def collect_tokens(long: DataFrame, id_col="doc_id", term_col="term", out="tokens") -> DataFrame:
    """Long -> narrow form, tokens in position order (one group per document)."""
    return (long.groupBy(id_col)
            .agg(F.sort_array(F.collect_list(F.struct("pos", term_col))).alias("_t"))
            .select(id_col, F.transform("_t", lambda s: s[term_col]).alias(out)))


# ------------------------------------------------------------------- n-grams
def ngram_array(tokens: Column, n: int, sep="_") -> Column:
    """n-grams as a zip of n shifted slices (no per-position lookup inside a
    lambda, so the work stays linear whatever the optimizer inlines)."""
    if n == 1:
        return tokens
    k = F.size(tokens) - n + 1
    grams = F.slice(tokens, 1, k)
    for j in range(1, n):
        grams = F.zip_with(grams, F.slice(tokens, j + 1, k), lambda a, b: F.concat(a, F.lit(sep), b))
    return F.when(k > 0, grams).otherwise(_empty())


def ngrams(df: DataFrame, tokens_col="tokens", ns=(1, 2, 3), sep="_", out=None) -> DataFrame:
    """All n-grams for n in ``ns`` (unigrams first), joined with ``sep``."""
    out = out or tokens_col
    parts = [ngram_array(F.col(tokens_col), n, sep) for n in ns]
    col = parts[0] if len(parts) == 1 else F.concat(*parts)
    return df.withColumn(out, col)


def ngrams_long(df: DataFrame, id_col="doc_id", tokens_col="tokens", ns=(1, 2, 3), sep="_") -> DataFrame:
    """Long n-grams ``(doc_id, n, pos, term)``."""
    outs = []
    for n in ns:
        outs.append(posexplode1(df.withColumn("n", F.lit(n)), ngram_array(F.col(tokens_col), n, sep),
                                [id_col, "n"]))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


# --------------------------------------------------------------- selections
def keep_tokens(long: DataFrame, vocab: DataFrame, term_col="term", vocab_col="feature",
                case_insensitive=True) -> DataFrame:
    """Keep long-form tokens whose (lower-cased) term is in ``vocab``."""
    key = F.lower(F.col(term_col)) if case_insensitive else F.col(term_col)
    v = vocab.select(F.col(vocab_col).alias("_v")).distinct()
    return long.join(v, key == F.col("_v"), "left_semi")


def keep_tokens_glob(long: DataFrame, patterns: list[str], term_col="term") -> DataFrame:
    """Keep tokens matching glob patterns (case-insensitive).

    Plain words are matched by a hash semi join; only real globs become one
    alternation regex evaluated inline (the pattern list is a parameter,
    so its size is bounded by the caller).
    """
    spark = long.sparkSession
    words = sorted({p.lower() for p in patterns if not is_glob(p)})
    globs = [glob_to_regex(p.lower()) for p in patterns if is_glob(p)]
    low = F.lower(F.col(term_col))
    parts = []
    if words:
        wdf = spark.createDataFrame([(w,) for w in words], "_w string")
        parts.append(long.join(F.broadcast(wdf), low == F.col("_w"), "left_semi"))
    if globs:
        rx = "|".join(f"(?:{g})" for g in globs)
        cond = low.rlike(rx)
        if words:
            cond = cond & ~low.isin(words)
        parts.append(long.filter(cond))
    if not parts:
        return long.limit(0)
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def filter_tokens(long: DataFrame, regex: str, keep=True, case_insensitive=True, term_col="term") -> DataFrame:
    """Keep or remove tokens matching a regex (find semantics)."""
    rx = ("(?i)" + regex) if case_insensitive else regex
    cond = F.col(term_col).rlike(rx)
    return long.filter(cond if keep else ~cond)


def filter_tokens_array(tokens: Column, regex: str, keep=True, case_insensitive=True) -> Column:
    rx = ("(?i)" + regex) if case_insensitive else regex
    return F.filter(tokens, (lambda x: x.rlike(rx)) if keep else (lambda x: ~x.rlike(rx)))


def min_chars(tokens: Column, n=3) -> Column:
    """Drop tokens shorter than n characters."""
    return F.filter(tokens, lambda x: F.char_length(x) >= n)


def detokenize(tokens: Column, sep=" ") -> Column:
    """Join tokens with a space."""
    return F.array_join(tokens, sep)


def types(long: DataFrame, term_col="term") -> DataFrame:
    """Distinct token types."""
    return long.select(term_col).distinct()


def replace_tokens(long: DataFrame, mapping: DataFrame, term_col="term",
                   find_col="find", repl_col="replacement") -> DataFrame:
    """Replace terms by a find -> replacement table (exact match)."""
    m = mapping.select(F.col(find_col).alias("_f"), F.col(repl_col).alias("_r")).dropDuplicates(["_f"])
    m = broadcast_if_small(m)
    return (long.join(m, F.col(term_col) == F.col("_f"), "left")
            .withColumn(term_col, F.coalesce(F.col("_r"), F.col(term_col)))
            .drop("_f", "_r"))


# ----------------------------------------------------------- negation
def _parse_patterns(patterns):
    """'can not *' -> ['can', 'not'] (trailing '*' = one mandatory token)."""
    out = []
    for p in patterns:
        words = p.split()
        if not words or words[-1] != "*":
            raise ValueError(f"negation pattern must end with '*': {p!r}")
        out.append([w.lower() for w in words[:-1]])
    return out


def _word_match(low_tok: Column, glob: str) -> Column:
    return low_tok.rlike(glob_to_regex(glob)) if is_glob(glob) else (low_tok == F.lit(glob))


def _shift(arr: Column, k: int) -> Column:
    """arr shifted left by k (element i holds arr[i + k]; NULL past the end)."""
    pad = F.array(*[F.lit(None).cast("string")] * k)
    return F.slice(F.concat(arr, pad), k + 1, F.size(arr))


def negation_starts(df: DataFrame, tokens_col="tokens", patterns=NEGATION_PATTERNS) -> DataFrame:
    """Adds ``_starts``: per position the number m of negator words of the
    longest match starting there (the match also needs the extra token at
    p+m), else -1.  Matching is case-insensitive.  The following tokens
    are read from shifted copies zipped with the token array, and one
    combined regex on the first word rules out most positions early."""
    pats = _parse_patterns(patterns)
    mmax = max(len(p) for p in pats)
    first_rx = "|".join(f"(?:{glob_to_regex(w[0])})" for w in pats)
    low = df.withColumn("_low", F.transform(tokens_col, F.lower))
    for k in range(1, mmax + 1):
        low = low.withColumn(f"_n{k}", _shift(F.col("_low"), k))
    zipped = F.arrays_zip(F.col("_low"), *[F.col(f"_n{k}") for k in range(1, mmax + 1)])
    names = ["_low"] + [f"_n{k}" for k in range(1, mmax + 1)]

    def start_len(z):
        cands = []
        for words in pats:
            m = len(words)
            cond = z[names[m]].isNotNull()            # the mandatory extra token
            for j, w in enumerate(words):
                cond = cond & _word_match(z[names[j]], w)
            cands.append(F.when(cond, F.lit(m)).otherwise(F.lit(-1)))
        best = F.greatest(*cands) if len(cands) > 1 else cands[0]
        return F.when(z["_low"].rlike(first_rx), best).otherwise(F.lit(-1))

    return low.withColumn("_starts", F.transform(zipped, start_len)).drop(*names)


def tag_negation(df: DataFrame, id_col="doc_id", tokens_col="tokens", patterns=NEGATION_PATTERNS,
                 window=NEGATION_WINDOW, mode="corpus", suffix="_neg") -> DataFrame:
    """B9 window negation tagging; returns long tokens ``(doc_id, pos, term)``.

    A match of m negator words at p covers p..p+m and opens the span
    p..p+m+window.  The furthest match end among the positions that can still
    reach a token is a sliding maximum, taken inside the token array by doubling
    shifted copies; a token is in a span when that end is at most ``window``
    before it, and in a match when it is not before it.
    mode='window': tokens inside a span and outside any match get ``suffix``;
    nothing is shuffled.  mode='corpus': the set of such terms is collected over
    the whole corpus and every span token whose term is in the set is tagged.
    """
    if mode not in ("corpus", "window"):
        raise ValueError("mode must be 'corpus' or 'window'")
    st = negation_starts(df.select(id_col, tokens_col), tokens_col, patterns)
    reach = window + max(len(p) for p in _parse_patterns(patterns)) + 1
    ends = F.transform("_starts", lambda m, i: F.when(m >= 0, i + m).otherwise(F.lit(-1 - reach)))
    st = st.withColumn("_ends", F.when(F.exists("_starts", lambda m: m >= 0), ends)).drop("_starts")
    covered = 1  # positions that the maximum covers so far
    while covered < reach:
        by = min(covered, reach - covered)
        shifted = F.concat(F.array_repeat(F.lit(-1 - reach), by), "_ends")
        st = st.withColumn("_ends", F.zip_with("_ends", F.slice(shifted, F.lit(1), F.size("_ends")), lambda x, y: F.greatest(x, y)))
        covered += by
    if mode == "corpus":
        st = st.repartition(id_col)  # both branches below read this exchange: one scan, one tokenisation
    long = posexplode1(st, F.arrays_zip(F.col(tokens_col).alias("t"), F.coalesce("_ends", F.array().cast("array<int>")).alias("e")),
                       [id_col], "pos", "z").select(id_col, "pos", F.col("z.t").alias("term"), F.col("z.e").alias("e"))
    in_span = F.coalesce(F.col("e") + window >= F.col("pos") - 1, F.lit(False))
    is_match = F.coalesce(F.col("e") >= F.col("pos") - 1, F.lit(False))
    tagged = F.concat(F.col("term"), F.lit(suffix))
    if mode == "window":
        return long.select(id_col, "pos", F.when(in_span & ~is_match, tagged).otherwise(F.col("term")).alias("term"))
    span = long.filter(in_span)
    tagset = span.filter(~is_match).select(F.col("term").alias("_t")).distinct().withColumn("_hit", F.lit(True))
    span = span.join(tagset, F.col("term") == F.col("_t"), "left").select(
        id_col, "pos", F.when(F.col("_hit"), tagged).otherwise(F.col("term")).alias("term"))
    return long.filter(~in_span).select(id_col, "pos", "term").unionByName(span)
