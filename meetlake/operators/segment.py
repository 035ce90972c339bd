"""Words to sentences, utterances and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions import text as T

def order():
    return Window.partitionBy("meeting_id", "track").orderBy("i")


def before():
    return order().rowsBetween(Window.unboundedPreceding, -1)



def glue_punctuation(words: DataFrame) -> DataFrame:
    """Tokens without letters or digits join the word before them; such tokens at the start are dropped."""
    real = (F.col("norm") != "").cast("int")
    grouped = words.withColumn("_g", F.sum(real).over(order())).where("_g > 0")
    parts = F.sort_array(F.collect_list(F.struct("i", "text", "start_ms", "end_ms")))
    out = grouped.groupBy("meeting_id", "track", "_g").agg(parts.alias("p"))
    return out.select("meeting_id", "track", (F.col("_g") - 1).cast("int").alias("i"), F.col("p")[0]["start_ms"].alias("start_ms"), F.array_max("p.end_ms").alias("end_ms"), F.array_join("p.text", "").alias("text"))


def with_sentences(words: DataFrame, punctuated_gap: int = 2000, plain_gap: int = 800) -> DataFrame:
    """words with sentence_i: cut after a terminator or a long gap; punctuation counts only where there is enough of it."""
    whole = Window.partitionBy("meeting_id", "track")
    term = T.terminates("text").cast("int")
    n_term, n = F.sum(term).over(whole), F.count(F.lit(1)).over(whole)
    dotted = (n_term > 0) & (n_term >= F.greatest(F.lit(1), F.floor(n / 40)))
    gap = F.lead("start_ms").over(order()) - F.col("end_ms")
    cut = F.when(term.cast("boolean") | (gap >= F.when(dotted, punctuated_gap).otherwise(plain_gap)), 1).otherwise(0)
    return words.withColumn("_cut", cut).withColumn("sentence_i", F.coalesce(F.sum("_cut").over(before()), F.lit(0))).drop("_cut")


def sentences(words: DataFrame) -> DataFrame:
    """A row for each sentence of with_sentences(words); n_words leaves out fillers."""
    return words.groupBy("meeting_id", "track", "sentence_i").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("i").alias("word_from"), F.max("i").alias("word_to"),
        F.count_if(F.col("kind") != "filler").alias("n_words"), F.max_by("text", "i").rlike(r"\?[\"'»)\]} ]*$").alias("is_question"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


def utterances(words: DataFrame, starters: list[str], long_starters: list[str] = (), gap_ms: int = 1000) -> DataFrame:
    """The other party's utterances; a question ends with ? or begins with a starter, or its first three words begin with one of several words."""
    own = words.where("track = 'system'")
    gap = F.lead("start_ms").over(order()) - F.col("end_ms")
    cut = (T.terminates("text") | F.coalesce(gap >= gap_ms, F.lit(False))).cast("int")
    own = own.withColumn("_cut", cut).withColumn("u", F.coalesce(F.sum("_cut").over(before()), F.lit(0)))
    ahead = lambda k: F.lead("norm", k).over(Window.partitionBy("meeting_id", "u").orderBy("i"))
    own = own.withColumn("_three", F.concat_ws(" ", "norm", ahead(1), ahead(2)))
    out = own.groupBy("meeting_id", "u").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_words"), F.min_by("norm", "i").alias("first"), F.max_by("text", "i").alias("last"), F.min_by("_three", "i").alias("three"))
    is_question = F.col("last").rlike(r"\?$") | F.col("first").isin(starters)
    for phrase in long_starters:
        is_question = is_question | F.col("three").startswith(phrase)
    return out.select("meeting_id", F.col("u").alias("utterance_i"), "start_ms", "end_ms", "n_words", is_question.alias("is_question"))


def transcript(sentences: DataFrame) -> DataFrame:
    """A text for each meeting: '[mm:ss] sentence' lines by time, own ones first at ties, the other party marked."""
    other = F.col("track") == "system"
    line = F.concat(F.lit("["), T.timecode(F.floor(F.col("start_ms") / 1000)), F.lit("] "), F.when(other, "> ").otherwise(""), F.col("text"))
    rows = sentences.select("meeting_id", F.struct("start_ms", other.alias("o"), "sentence_i", line.alias("line")).alias("s"))
    return rows.groupBy("meeting_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["line"]), "\n").alias("text"))


def merge_tokens(tokens: DataFrame) -> DataFrame:
    """Sub-word tokens to words: a token without a leading space continues the one before; prob is the least of its tokens'."""
    first = F.row_number().over(order()) == 1
    grouped = tokens.withColumn("_g", F.sum((first | F.col("text").startswith(" ")).cast("int")).over(order()))
    text = F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), ""))
    out = grouped.groupBy("meeting_id", "track", "_g").agg(text.alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("prob").alias("prob"))
    return out.select("meeting_id", "track", (F.col("_g") - 1).cast("int").alias("i"), "text", "start_ms", "end_ms", "prob")
