"""Text functions: significance, names and quotes, overlap, conflicts, merging, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.columns import words

# Messages that mean nothing; statements about oneself; hints at time.
TRIVIAL = (
    "ok", "okay", "k", "thanks", "thank you", "thx", "ty", "hello", "hi", "hey", "howdy", "bye", "goodbye", "see you", "later", "sure", "yeah", "yes", "no", "nah", "lol", "haha", "hehe", "lmao", "np", "no problem", "no worries", "got it", "understood", "i see", "cool", "nice", "great", "awesome",
    "hmm", "hm", "uh", "um", "yep", "yup", "nope", "right", "exactly", "correct", "sounds good", "makes sense", "good morning", "good night", "good evening", "what", "why", "how", "when", "where",
)
FIRST_PERSON = (
    "i am", "i'm", "i work", "i live", "i like", "i love", "i hate", "i prefer", "i want", "i need", "i have", "i've", "i was", "my name", "my job", "my wife", "my husband", "my friend", "my favorite", "my hobby",
    "i enjoy", "i started", "i moved", "i changed", "i quit", "i joined", "i bought", "i'm learning", "i just", "i recently", "i used to",
)
TEMPORAL = ("yesterday", "today", "tomorrow", "last week", "next week", "last month", "next month", "this morning", "tonight", "just now", "recently", "currently", "right now", "planning to", "going to", "will be", "about to")
# Pairs of opposite statements; words that end something; words of change; life categories; opposite words; words without a subject.
OPPOSITES = (
    ("likes", "doesn't like"), ("likes", "does not like"), ("likes", "dislikes"), ("loves", "hates"), ("loves", "doesn't love"), ("prefers", "doesn't prefer"), ("prefers", "avoids"), ("wants", "doesn't want"), ("enjoys", "doesn't enjoy"),
    ("is", "is not"), ("is", "isn't"), ("can", "cannot"), ("can", "can't"), ("will", "won't"), ("will", "will not"), ("has", "doesn't have"), ("has", "has no"),
)
ENDINGS = ("no longer", "not anymore", "stopped", "quit")
CHANGES = ("now", "currently", "recently", "just", "today", "this week", "this month", "this year", "changed to", "switched to", "moved to", "started", "began", "now using")
LIFE = {
    "location": ("live in", "lives in", "living in", "moved to", "moving to", "relocated to", "based in", "reside in", "resides in", "residing in", "settled in", "home in", "from"),
    "job": ("work at", "works at", "working at", "job at", "employed at", "joined", "hired at", "position at", "role at", "work for", "works for", "working for"),
    "diet": ("drink", "drinks", "drinking", "eat", "eats", "eating", "coffee", "tea", "vegetarian", "vegan", "cups a day", "switched to"),
    "status": ("married", "single", "divorced", "engaged", "dating", "relationship", "partner", "spouse", "wife", "husband", "girlfriend", "boyfriend"),
}
CONTRARY = (
    (("yes", "agree", "correct", "true", "will", "can", "do"), ("no", "disagree", "wrong", "false", "won't", "can't", "don't")),
    (("always", "every", "all"), ("never", "none", "no")),
    (("more", "increase", "higher"), ("less", "decrease", "lower")),
)
SUBJECTLESS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "i", "me", "my", "mine", "we", "you", "your", "yours", "he", "she", "it", "they", "them", "their", "this", "that", "these", "those", "and", "or", "but", "if", "then", "to", "of", "in", "on", "at", "by", "for", "with", "about", "from",
)


def _any(text: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def has_proper_noun(text: Column) -> Column:
    """A word after the first that begins with a capital and has more than one byte."""
    return F.exists(F.slice(words(text), 2, 100_000_000), lambda w: w.rlike(r"^[A-Z]") & (F.octet_length(w) > 1))


def significance(content: Column) -> Column:
    """0 to 1: how much a message is worth remembering."""
    text = F.trim(content)
    low, size = F.lower(text), F.octet_length(text)
    named, number, count = has_proper_noun(text), text.rlike("[0-9]"), F.size(words(text))
    score = 0.4 + F.when(_any(low, FIRST_PERSON), 0.3).otherwise(0.0) + F.when(named, 0.2).otherwise(0.0) + F.when(number, 0.1).otherwise(0.0)
    score = score + F.when(_any(low, TEMPORAL), 0.15).otherwise(0.0) + F.when(count >= 10, 0.1).otherwise(0.0) + F.when(count >= 20, 0.1).otherwise(0.0)
    return F.when(size == 0, 0.0).when(low.isin(*TRIVIAL), 0.0).when((size < 15) & ~named & ~number, 0.1).when(text.endswith("?") & (size < 30) & ~named, 0.2).otherwise(F.least(score, F.lit(1.0)))


def proper_nouns(text: Column) -> Column:
    """Runs of capitalised words after the first word."""
    return F.regexp_extract_all(F.regexp_replace(text, r"^\S+\s*", ""), F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"), F.lit(0))


def quoted(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))


def numbers(text: Column) -> Column:
    """Words that are whole numbers once punctuation around them is gone."""
    return F.filter(F.transform(words(text), lambda w: F.regexp_replace(w, r"^[.,!?;:'\"]+|[.,!?;:'\"]+\z", "")), lambda w: w.rlike(r"^[0-9]+\z"))


def covered(new: Column, old: Column) -> Column:
    """Share of the new text's words that the old text has."""
    a, b = words(F.lower(new)), words(F.lower(old))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.filter(a, lambda w: F.array_contains(b, w))) / F.size(a))


def is_subset(new: Column, old: Column) -> Column:
    x, y = F.lower(F.trim(new)), F.lower(F.trim(old))
    return ((F.length(x) < F.length(y)) & y.contains(x)) | (covered(new, old) >= 0.9)


def is_redundant(first: Column, second: Column) -> Column:
    x, y = F.lower(F.trim(first)), F.lower(F.trim(second))
    return x.contains(y) | y.contains(x) | (covered(second, first) >= 0.8)


def unique_words(first: Column, second: Column) -> Column:
    """The words of the second text that the first doesn't have, in order; empty if there are fewer than three."""
    known = words(F.lower(first))
    rest = F.filter(words(second), lambda w: ~F.array_contains(known, F.lower(w)))
    return F.when(F.size(rest) < 3, "").otherwise(F.array_join(rest, " "))


def merged(old: Column, new: Column) -> Column:
    """The longer text if it holds the other; what is new after a common beginning of more than half the old words; else both."""
    a, b = F.trim(old), F.trim(new)
    x, y = words(a), words(b)
    same = F.zip_with(F.transform(x, F.lower), F.transform(y, F.lower), lambda p, q: F.coalesce(p == q, F.lit(False)))
    common = F.when(F.forall(same, lambda s: s), F.least(F.size(x), F.size(y))).otherwise(F.array_position(same, False).cast("int") - 1)
    rest = F.array_join(F.slice(y, common + 1, 100_000_000), " ")
    return F.when(F.lower(a).contains(F.lower(b)), a).when(F.lower(b).contains(F.lower(a)), b).when(common > F.floor(F.size(x) / 2), F.concat(a, F.lit(". Additionally: "), rest)).otherwise(F.concat(a, F.lit(". "), b))


def same_subject(first: Column, second: Column) -> Column:
    """At least 0.3 of the meaningful words of the shorter text are shared."""
    meaning = lambda t: F.array_distinct(F.filter(words(F.lower(t)), lambda w: (F.octet_length(w) > 2) & ~w.isin(*SUBJECTLESS)))
    a, b = meaning(first), meaning(second)
    small = F.least(F.size(a), F.size(b))
    return F.when(small == 0, False).otherwise(F.size(F.array_intersect(a, b)) / small >= 0.3)


def conflict(new: Column, old: Column, new_type: Column | None = None, old_type: Column | None = None) -> Column:
    """A struct (kind, confidence) of the first conflict that fits, null if the texts agree. With the types of both, two preferences about one subject are a change of preference."""
    x, y = F.lower(new), F.lower(old)
    negated = _any(x, ENDINGS)
    for yes, no in OPPOSITES:
        negated = negated | (y.contains(yes) & x.contains(no)) | (y.contains(no) & x.contains(yes))
    same = same_subject(new, old)
    life = F.lit(False)
    for parts in LIFE.values():
        life = life | (_any(x, parts) & _any(y, parts))
    m, n = numbers(x), numbers(y)
    numeric = same & (F.size(m) > 0) & (F.size(n) > 0) & (F.size(F.array_distinct(F.concat(m, n))) > 1)
    contrary = F.lit(False)
    for up, down in CONTRARY:
        contrary = contrary | (_any(x, up) & _any(y, down)) | (_any(x, down) & _any(y, up))
    preference = F.lit(False) if new_type is None or old_type is None else (new_type == "PREFERENCE") & (old_type == "PREFERENCE")
    of = lambda kind, confidence: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
    return F.when(negated, of("negation", 0.8)).when(same & _any(x, CHANGES), of("temporal", 0.7)).when(life, of("life", 0.75)).when(same & preference, of("preference", 0.75)).when(numeric, of("numeric", 0.6)).when(same & contrary, of("boolean", 0.7))


def within_budget(rows: DataFrame, text: str, order: Sequence[Column], budget: int, group: str, each: int = 240) -> DataFrame:
    """The first rows of each group whose texts, cut to ``each`` bytes and a line break, fit a budget of bytes."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.least(F.octet_length(text), F.lit(each)) + 1
    return rows.withColumn("_used", F.sum(size).over(w)).where(F.col("_used") <= budget).withColumnRenamed("_used", "used")


def topics(memory_type: Column, tags: Column) -> Column:
    return F.concat(F.array(F.lower(memory_type)), F.transform(F.filter(tags, lambda t: ~t.startswith("cron:")), lambda t: F.lower(t)))
