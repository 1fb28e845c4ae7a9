"""License scan by ordered signature rules, with DataFrame functions only.

White space is collapsed, then a text meets literal anchors; only a text with one of them is matched
against the rules whose own literal it holds. Every match is an interval with the priority of its
rule; each id of an SPDX expression is one. Intervals are swept in order of start: one that lies inside an interval of higher priority, or of the same priority and
no shorter, is suppressed. The labels of what is left are the method's labels. Base phrases are
counted separately, word by word, and always stay.

Edge cases: a null text is empty; an empty text has no words, places or labels and score 0; repeated
rows give repeated results; equal intervals of one priority keep the first rule's label. No row
limit or prefix: whole texts are read. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_rules import ANCHORS, SPACE, rules

# Phrase: label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_CONFIDENCE = 0.8

GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = f"[^{GAP}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The words of a text before lower-casing are the same stretches.
RAW_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def places(words: Column, phrase: str) -> Column:
    """Starts, in words from 0, at which the words of `phrase` stand consecutively."""
    first, *rest = phrase.split(" ")
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
    follows = lambda k, word: lambda i: F.coalesce(F.get(words, i + k) == word, F.lit(False))
    for k, word in enumerate(rest, 1):
        starts = F.filter(starts, follows(k, word))
    return starts


def intervals(low: Column, rule: Column) -> Column:
    """What each match of a rule claims, its group or all of it, as `array<struct<from, stop>>`: matches lie between the pieces of a split."""
    pieces = F.split(low, rule["pattern"], -1)
    hits = F.regexp_extract_all(low, rule["pattern"], F.lit(0))
    claims = F.when(rule["grouped"], F.regexp_extract_all(low, rule["pattern"], F.lit(1))).otherwise(hits)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,stop:int>>").alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["piece"])
        stop = begin + F.length(pair["hit"])
        return F.struct(stop.alias("at"), F.concat(acc["found"], F.array(F.struct((stop - F.length(pair["claim"])).alias("from"), stop.alias("stop")))).alias("found"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(hits)), F.arrays_zip(hits.alias("hit"), claims.alias("claim")), lambda p, h: F.struct(p.alias("piece"), h["hit"].alias("hit"), h["claim"].alias("claim")))
    return F.aggregate(pairs, start, step, lambda acc: acc["found"])


def detections(low: Column) -> Column:
    """Matches of all rules whose literal the text holds."""
    made = [F.struct(*(F.lit(v).alias(k) for k, v in r.items())) for r in rules()]
    tried = F.filter(F.array(*made), lambda r: F.contains(low, r["need"]) & F.regexp_like(low, r["pattern"]))
    each = F.transform(
        tried,
        lambda r: F.transform(
            intervals(low, r),
            lambda m: F.struct(
                m["from"].alias("from"), (-m["stop"]).alias("minus_stop"), (-r["priority"]).alias("minus_priority"), r["ordinal"].alias("ordinal"), r["label"].alias("label"), r["confidence"].alias("confidence")
            ),
        ),
    )
    return F.array_sort(F.flatten(each))


def surviving(found: Column) -> Column:
    """`struct<labels, score>` of the intervals that no interval of at least their priority contains.

    `far` holds, per priority, the farthest stop so far: all that contain an interval precede it.
    """
    start = F.struct(F.array(*[F.lit(-1)] * 3).alias("far"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        stop, priority = -d["minus_stop"], -d["minus_priority"]
        inside = F.exists(F.slice(acc["far"], priority, 3), lambda far: far >= stop)
        far = F.transform(acc["far"], lambda x, i: F.when(i + 1 == priority, F.greatest(x, stop)).otherwise(x))
        return F.struct(
            far.alias("far"),
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], d["confidence"])).alias("score"),
        )

    return F.aggregate(found, start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["score"].alias("score")))


def scan(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text)` to doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = text.select("doc_id", "text", F.regexp_replace(F.lower("text"), SPACE, " ").alias("low"))
    low = F.col("low")
    gated = text.select(
        "doc_id",
        F.regexp_count("text", F.lit(f"[^{RAW_GAP}]+")).cast("long").alias("n_words"),
        F.when(F.col("text").rlike(f"(?i)license|cc[{RAW_GAP}]+by"), F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))).alias("words"),
        F.when(F.greatest(*(F.contains(low, F.lit(a)) for a in ANCHORS)), low).alias("low"),
    )
    none = F.lit(None)
    found = gated.select(
        "doc_id",
        "n_words",
        F.when(F.col("words").isNotNull(), F.struct(*(places(F.col("words"), p).alias(label) for p, label in BASE.items()))).alias("base"),
        F.when(F.col("low").isNotNull(), surviving(detections(F.col("low")))).alias("rule"),
    )
    every = F.coalesce(F.concat(*(F.col("base")[label] for label in BASE.values())), F.array().cast("array<int>"))
    named = F.filter(F.array(*(F.when(F.size(F.col("base")[label]) > 0, label) for label in BASE.values())), lambda x: x.isNotNull())
    both = found.select("doc_id", "n_words", every.alias("every"), named.alias("named"), F.coalesce(F.col("rule.labels"), F.array().cast("array<string>")).alias("more"), F.coalesce("rule.score", F.lit(0.0)).alias("score"))
    return both.select(
        "doc_id",
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.when(F.size("every") > 0, F.array_min("every").cast("long")).otherwise(none).alias("first_word"),
        F.when(F.size("every") > 0, F.array_max("every").cast("long")).otherwise(none).alias("last_word"),
        F.concat_ws(",", F.array_sort("named")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("named", "more"))).alias("labels"),
        F.greatest("score", F.when(F.size("every") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0))).alias("score"),
    )


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
