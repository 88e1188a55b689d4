"""Proximity and annotation features (E1–E3, E6, E7, AG1).

Nearest candidate to a target without a pair join and without a window over
the tokens: only targets and candidates of a document are collected, sorted by
position, and one fold over them keeps the last target, the last candidate
and the closest pair so far (ties to the leftmost candidate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmine.functions.lexicons import CLOSEST_TAGS
from textmine.operators.util import broadcast_if_small


def _marks(long: DataFrame, cand_key: Column, is_target: Column, by: list[str], term_col="term") -> DataFrame:
    """``(by, _m)``: a document's targets and candidates in the order of their positions."""
    marks = long.select(*by, F.struct(F.col("pos").cast("int").alias("pos"), F.coalesce(is_target, F.lit(False)).alias("target"),
                                      cand_key.alias("key"), F.col(term_col).alias("term")).alias("_x"))
    marks = marks.filter(F.col("_x.target") | F.col("_x.key").isNotNull())
    return marks.groupBy(*by).agg(F.sort_array(F.collect_list("_x")).alias("_m"))


def _closest(marks: Column, is_candidate) -> Column:
    """(distance, position, term) of the candidate closest to a target; null when there is none."""
    pair = "struct<dist:int,pos:int,term:string>"
    start = F.struct(F.lit(None).cast("int").alias("target"), F.lit(None).cast("struct<pos:int,term:string>").alias("cand"),
                     F.lit(None).cast(pair).alias("best"))

    def step(state, x):
        target = F.when(x["target"], x["pos"]).otherwise(state["target"])
        mine = is_candidate(x)
        # A candidate meets the last target, a target the last candidate: no closer pair lies across those.
        behind = F.when(mine & target.isNotNull(), F.struct((x["pos"] - target).alias("dist"), x["pos"].alias("pos"), x["term"].alias("term")))
        ahead = F.when(x["target"] & state["cand"].isNotNull(), F.struct(
            (x["pos"] - state["cand"]["pos"]).alias("dist"), state["cand"]["pos"].alias("pos"), state["cand"]["term"].alias("term")))
        return F.struct(target.alias("target"),
                        F.when(mine, F.struct(x["pos"].alias("pos"), x["term"].alias("term"))).otherwise(state["cand"]).alias("cand"),
                        F.least(state["best"], behind, ahead).alias("best"))

    return F.aggregate(marks, start, step, lambda state: state["best"])


def nearest(long: DataFrame, cand_key: Column, is_target: Column, by=("doc_id",), term_col="term") -> DataFrame:
    """Closest candidate to any target per document, ``(by, closest)``.

    ``cand_key`` is non-null on candidate tokens."""
    by = list(by)
    marks = _marks(long, cand_key, is_target, by, term_col)
    found = marks.select(*by, _closest(F.col("_m"), lambda x: x["key"].isNotNull()).alias("_b"))
    return found.filter(F.col("_b").isNotNull()).select(*by, F.col("_b.term").alias("closest"))


def tagged_tokens(annot: DataFrame) -> DataFrame:
    """E6 long form: ``(doc_id, pos, term = lemma_UPOS)``; ``pos`` counts the
    document's tokens in (sid, tid) order, so distances run across sentences."""
    words = annot.groupBy("doc_id").agg(F.sort_array(F.collect_list(
        F.struct("sid", "tid", F.concat_ws("_", "lemma", "upos").alias("term")))).alias("_w"))
    return words.select("doc_id", F.posexplode("_w").alias("_p", "_x")).select(
        "doc_id", "_x.sid", "_x.tid", "_x.term", (F.col("_p") + 1).alias("pos"))


def tagged_text(annot: DataFrame) -> DataFrame:
    """E6/AG1: one text per document, tags joined by spaces in token order."""
    t = tagged_tokens(annot)
    return (t.groupBy("doc_id")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("_t"))
            .select("doc_id", F.array_join(F.transform("_t", lambda s: s["term"]), " ").alias("text")))


def closest_pos(tagged: DataFrame, target_regex: str, tags=CLOSEST_TAGS, docs: DataFrame | None = None) -> DataFrame:
    """Per document the closest ``_VERB`` / ``_ADJ`` / ``_ADV`` tag to a
    target marker, suffix stripped; '' when none.  Columns are the lower-cased
    tag names."""
    cls = F.lit(None).cast("string")
    for tag in reversed(tags):
        cls = F.when(F.col("term").contains("_" + tag), F.lit(tag)).otherwise(cls)
    suffix = "_(" + "|".join(tags) + ")"
    marks = F.struct("pos", F.col("term").rlike(target_regex).alias("target"), cls.alias("key"), "term")
    # Tokens that are neither target nor candidate are null, which collect_list leaves out; a document without any keeps its row.
    kept = F.when(F.col("_x.target") | F.col("_x.key").isNotNull(), F.col("_x"))
    wide = tagged.select("doc_id", marks.alias("_x")).groupBy("doc_id").agg(F.sort_array(F.collect_list(kept)).alias("_m"))
    out = docs.select("doc_id").distinct().join(wide, "doc_id", "left") if docs is not None else wide
    return out.select("doc_id", *[
        F.coalesce(F.regexp_replace(_closest(F.col("_m"), lambda x, t=t: F.coalesce(x["key"] == t, F.lit(False)))["term"], suffix, ""),
                   F.lit("")).alias(t.lower()) for t in tags])


def closest_in_list(df: DataFrame, wordlist: DataFrame, target_regex: str, text_col="text") -> DataFrame:
    """Closest word of a word list (exact, case-sensitive) to a target
    marker on the space-split text (empty pieces keep their position)."""
    long = (df.select("doc_id", F.posexplode_outer(F.split(F.coalesce(text_col, F.lit("")), " ")).alias("pos", "term"))
            .filter(F.col("pos").isNotNull()))
    words = broadcast_if_small(wordlist.select(F.col("word").alias("_w")).distinct())
    long = long.join(words, F.col("term") == F.col("_w"), "left")
    res = nearest(long, F.when(F.col("_w").isNotNull(), F.lit("w")), F.col("term").rlike(target_regex))
    return df.select("doc_id").join(res, "doc_id", "left") \
             .select("doc_id", F.coalesce("closest", F.lit("")).alias("closest"))


def dependency_triples(annot: DataFrame) -> DataFrame:
    """``relation_lemma_headlemma`` per dependent with a head in the same sentence.

    A sentence's words stand in one array by ``tid``; a head is read at its place
    there, or searched for where the ids have gaps.  No join of the words with
    themselves; of words that share an id in a sentence one is the head."""
    word = F.struct("tid", "lemma", "relation", "tid_target")
    sentences = annot.groupBy("doc_id", "sid").agg(F.sort_array(F.collect_list(word)).alias("_w"))

    def head(x):
        at = F.get(F.col("_w"), x["tid_target"] - 1)
        found = F.get(F.filter("_w", lambda y: y["tid"] == x["tid_target"]), F.lit(0))
        return F.when(at["tid"] == x["tid_target"], at["lemma"]).when(x["tid_target"] > 0, found["lemma"])

    pairs = F.transform("_w", lambda x: F.struct(x["tid"].alias("tid"), x["relation"].alias("relation"), x["lemma"].alias("lemma"),
                                                 head(x).alias("head")))
    out = sentences.select("doc_id", "sid", F.explode(pairs).alias("x")).filter(F.col("x.head").isNotNull())
    return out.select("doc_id", F.struct("sid", F.col("x.tid").alias("tid")).alias("pos"),
                      F.concat_ws("_", "x.relation", "x.lemma", "x.head").alias("term"))
