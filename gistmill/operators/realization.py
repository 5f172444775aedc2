"""Rewriting of noun phrases, as joins: an entity's first mention in a summary is given in full, later ones briefly.

Four tables meet. Mentions say where noun phrases stand in a summary's sentences, and of which entity. Names are the phrases
that a docset has for an entity. Verdicts pair each mention with its entity's names and hold a column for each rule; edits
are the chosen ones, and are applied to a sentence from its end, by position. Parsing and coreference come from the user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Part-of-speech tags of pronouns and of proper nouns.
PRONOUN_TAGS = ("PRP", "PRON", "PRP$")
PROPER_TAGS = ("PROPN", "NNP", "NNPS", "NE", "NNE", "NR")

_PLACE = ["docset_id", "order_idx", "start"]


def some_tag(tags: Column, kinds: tuple[str, ...]) -> Column:
    return F.exists(tags, lambda t: t.isin(*kinds))


def every_tag(tags: Column, kinds: tuple[str, ...]) -> Column:
    return F.forall(tags, lambda t: t.isin(*kinds))


def tagged_words(text: Column, tags: Column, kinds: tuple[str, ...]) -> Column:
    """The words of a phrase whose tags are among kinds, without marks at their ends."""
    pairs = F.arrays_zip(F.split(text, " ").alias("word"), tags.alias("tag"))
    return F.transform(F.filter(pairs, lambda x: x["tag"].isin(*kinds)), lambda x: F.regexp_replace(x["word"], r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def match_sentences(chosen: DataFrame, sents: DataFrame) -> DataFrame:
    """docset_id, order_idx, doc_id, sent_idx: the first docset sentence with the same set of tokens as a chosen one."""
    bag = F.array_sort(F.array_distinct("tokens")).alias("bag")
    first = sents.groupBy("docset_id", bag).agg(F.min(F.struct("doc_id", "sent_idx")).alias("at"))
    return chosen.select("docset_id", "order_idx", bag).join(first, ["docset_id", "bag"]).select("docset_id", "order_idx", "at.doc_id", "at.sent_idx")


def link_mentions(phrases: DataFrame, spans: DataFrame) -> DataFrame:
    """Noun phrases (docset_id, order_idx, start, text, sentence, tags, features) with the entity (column cluster) that has a
    span of the same text in the same sentence; of several the least."""
    entity = spans.groupBy("docset_id", "text", "sentence").agg(F.min("cluster").alias("cluster"))
    return phrases.join(entity, ["docset_id", "text", "sentence"])


def names(spans: DataFrame) -> DataFrame:
    """docset_id, cluster, name, tags, features, full: the phrases of each entity up to their first comma; full ones have
    several words and are no pronouns."""
    head = F.trim(F.split("text", ",")[0])
    words = F.size(F.split(head, " "))
    cut = spans.select("docset_id", "cluster", head.alias("name"), F.slice("tags", F.lit(1), F.greatest(words, F.lit(1))).alias("tags"), F.slice("features", F.lit(1), F.greatest(words, F.lit(1))).alias("features"))
    return cut.distinct().withColumn("full", (F.size(F.split("name", " ")) > 1) & ~every_tag(F.col("tags"), PRONOUN_TAGS))


def verdicts(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """Each mention with each name of its entity, `first` (no earlier mention of the entity in the summary) and a column a rule."""
    earlier = Window.partitionBy("docset_id", "cluster").orderBy("order_idx", "start")
    numbered = mentions.withColumn("first", F.row_number().over(earlier) == 1)
    other = known.withColumnsRenamed({"tags": "name_tags", "features": "name_features"})
    met = numbered.join(other, ["docset_id", "cluster"])
    owns = lambda x: F.col(x).endswith("'s")
    pronoun = lambda x: some_tag(F.col(x), PRONOUN_TAGS)
    proper = lambda text, tags: tagged_words(F.col(text), F.col(tags), PROPER_TAGS)
    mine, its = proper("text", "tags"), proper("name", "name_tags")
    feature = lambda x: F.coalesce(F.get(F.col(x), F.lit(0)), F.lit(""))
    rules = {
        "other_text": F.col("name") != F.col("text"),
        "same_case": owns("name") == owns("text"),
        "same_pronoun": ~(pronoun("tags") & pronoun("name_tags")) | (feature("features") == feature("name_features")),
        "no_twin": (F.col("text") != F.concat(F.lit("("), "name", F.lit(")"))) & (F.col("text") != F.concat(F.lit('"'), "name", F.lit('"'))),
        "shared_name": (F.size(mine) == 0) | (F.size(its) == 0) | F.arrays_overlap(mine, its),
        "third_person": ~(pronoun("name_tags") & F.exists("name_features", lambda f: f.rlike("Person=[12]"))),
        "names_entity": ~every_tag(F.col("name_tags"), PRONOUN_TAGS),
        "keeps_name": ~F.col("first") | (F.size(its) > 0) | (F.size(mine) == 0),
    }
    return met.withColumns(rules).withColumn("allowed", F.forall(F.array(*rules), lambda x: x))


def edits(mentions: DataFrame, known: DataFrame, policy: str = "by_mention") -> DataFrame:
    """docset_id, order_idx, start, text, name, name_tags of the mentions to be replaced.

    by_mention: a first mention takes the longest allowed full name that is longer than it, a later one the shortest allowed
    name that is shorter. extremes: the longest and the shortest allowed full name, whatever the mention's length. Equally
    long names go by text. Of nested mentions the outermost that has an edit is replaced.
    """
    found = verdicts(mentions, known).where("allowed")
    longer = F.length("name") - F.length("text")
    if policy == "by_mention":
        found = found.where((F.col("first") & F.col("full") & (longer > 0)) | (~F.col("first") & (longer < 0)))
    elif policy == "extremes":
        found = found.where("full")
    else:
        raise ValueError("policy is by_mention or extremes")
    order = F.struct(F.when(F.col("first"), -F.length("name")).otherwise(F.length("name")), "name")
    best = found.groupBy(*_PLACE, "text", "cluster").agg(F.min_by(F.struct("name", "name_tags"), order).alias("n")).select(*_PLACE, "text", "cluster", "n.*")
    outer = Window.partitionBy("docset_id", "order_idx").orderBy("start", F.length("text").desc(), "cluster").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("start") + F.length("text")).over(outer)
    return best.withColumn("reach", F.coalesce(reach, F.lit(0))).where("start >= reach").drop("reach", "cluster")


def realize(sentences: DataFrame, mentions: DataFrame, spans: DataFrame, policy: str = "by_mention") -> DataFrame:
    """docset_id, order_idx, sentence with the mentions replaced; sentences without edits stay as they are.

    sentences: docset_id, order_idx, sentence. mentions: docset_id, order_idx, start (0-based), text, tags, features, cluster.
    spans: docset_id, cluster, text, tags, features of the docset's coreference. A new name starts small unless a proper
    noun leads it, large at the start of a line, and stands in brackets within quotes, where a speaker's own "I" stays.
    """
    chosen = edits(mentions, names(spans), policy).join(sentences, ["docset_id", "order_idx"])
    before, after = F.substring("sentence", F.lit(1), F.col("start")), F.substring("sentence", F.col("start") + F.length("text") + 1, F.length("sentence"))
    marks = lambda x: F.length(x) - F.length(F.replace(x, F.lit('"'), F.lit("")))
    quoted = (marks(before) % 2 == 1) & (marks(after) % 2 == 1)
    proper = F.coalesce(F.get("name_tags", F.lit(0)), F.lit("")).isin(*PROPER_TAGS)
    rest = F.substring("name", F.lit(2), F.length("name"))
    by = F.when(F.col("start") == 0, F.concat(F.upper(F.substring("name", 1, 1)), rest)).when(proper, F.col("name")).otherwise(F.concat(F.lower(F.substring("name", 1, 1)), rest))
    made = chosen.where(~(quoted & (F.col("text") == "I") & F.col("sentence").contains("said"))).withColumn("by", F.when(quoted, F.concat(F.lit("["), by, F.lit("]"))).otherwise(by))
    packed = F.reverse(F.array_sort(F.collect_list(F.struct("start", F.length("text").alias("size"), "by"))))
    lines = made.groupBy("docset_id", "order_idx").agg(packed.alias("edits"))
    cut = lambda s, e: F.concat(F.substring(s, F.lit(1), e["start"]), e["by"], F.substring(s, e["start"] + e["size"] + 1, F.length(s)))
    new = F.when(F.col("edits").isNotNull(), F.aggregate("edits", F.col("sentence"), cut)).otherwise(F.col("sentence"))
    return sentences.join(lines, ["docset_id", "order_idx"], "left").select("docset_id", "order_idx", new.alias("sentence"))


def replace_referents(sentences: DataFrame, mentions: DataFrame, spans: DataFrame) -> DataFrame:
    """A whole summary's sentences by the older policy: the longest name at first, then the shortest."""
    return realize(sentences, mentions, spans, "extremes")


def resolver(model: Callable | None) -> Callable:
    """The user's parser and coreference model; none comes with the library."""
    if model is None:
        raise NotImplementedError("no coreference model is available; pass one: text -> (mentions by sentence, clusters)")
    return model
