"""Texts that hold other texts whole, without comparing each with each."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short items tried in one pass over the documents.
BLOCK = 1000


def containing(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text") -> DataFrame:
    """item and document of each item whose text stands in the document's, character for character.

    If it does, the item's words but the first and the last stand there as whole words. The longest of them is met by an
    equality join with the documents' distinct words, and what it meets is verified. Items of one or two words, which may
    be parts of others, are tried on every document, BLOCK of them in a pass.
    """
    words = lambda c: F.split(c, r"\s+")
    asked = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("_item"), F.col(text).alias("_part")).withColumn("_words", words("_part"))
    inner = F.slice("_words", F.lit(2), F.size("_words") - 2)
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    anchors = asked.where(F.size("_words") > 2).select("_item", "_part", longest.alias("_anchor"))
    split = docs.where(F.col(text).isNotNull()).select(doc_id, F.explode(F.array_distinct(words(text))).alias("_anchor"))
    met = split.join(anchors, "_anchor").select(doc_id, "_item", "_part")
    found = met.join(docs.select(doc_id, text), doc_id).where(F.contains(text, "_part")).select(F.col("_item").alias(item_id), doc_id)
    short = asked.where(F.size("_words") <= 2).select("_item", "_part").toLocalIterator()
    kind = dict(items.dtypes)[item_id]
    while block := list(islice(short, BLOCK)):
        parts = F.array(*(F.struct(F.lit(r._item).cast(kind).alias("i"), F.lit(r._part).alias("p")) for r in block))
        hits = F.filter(parts, lambda x: F.contains(F.col(text), x["p"]))
        found = found.union(docs.select(doc_id, F.explode(hits).alias("x")).select(F.col("x.i").alias(item_id), doc_id))
    return found
