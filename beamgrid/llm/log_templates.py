"""Line dedup by a log-template tree: lines are parsed to templates, and templates that recur across documents are dropped. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _stage

#: What stands for a variable field.
FIELD = "<*>"
DEPTH, MIN_DOCS, MIN_TOKENS = 3, 10, 3
#: A line of more tokens than this is a passage: it recurs as soon as it stands, fields aside, in two different texts.
PASSAGE = 50
#: Recurring leaves (8 bytes each) that may be broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 500_000


def tokens_of(line: Column) -> Column:
    """Words between ASCII white space; those with a digit are fields, unless over half of the line's words are: it then stands as it is.

    Lines without digits, the most, skip the look at each word. Splitting at single spaces needs no regular expression.
    """
    spaced = F.when(line.rlike(r"[\x09-\x0D]"), F.regexp_replace(line, r"[\x09-\x0D]", " ")).otherwise(line)
    words = F.array_remove(F.split(spaced, " ", -1), "")
    masked = F.transform(words, lambda w: F.when(w.rlike("[0-9]"), F.lit(FIELD)).otherwise(w))
    mostly = 2 * F.size(F.filter(words, lambda w: w.rlike("[0-9]"))) > F.size(words)
    return F.when(line.rlike("[0-9]") & ~mostly, masked).otherwise(words)


def has_words(line: Column, n: int) -> Column:
    """Whether the line has n words at least; no more of it is read than those. (A filter on tokens_of() would cut all words twice.)"""
    space = r"\x20\x09-\x0D"
    return line.rlike(rf"^[{space}]*+(?:[^{space}]++[{space}]++){{{n - 1}}}[^{space}]") if n > 0 else line.isNotNull()


def dropped_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, passage: int = PASSAGE
) -> DataFrame:
    """_id, _text_hash, _dropped: line numbers (from 0) of each document whose template recurs in min_docs different texts or more.

    The tree has a fixed depth: token count, then the first `depth` tokens. Leaves seen in fewer than min_docs texts end
    there. In the others, a token is fixed if it stands at its place in min_docs (text, distinct line) pairs of the leaf; any other one,
    and any field, is variable. Lines with at least half of their tokens fixed, and with a template in min_docs texts,
    recur. So do lines of over `passage` tokens that two texts have with all tokens but fields alike. Lines of fewer than min_tokens
    tokens never do. Copies of a text, and repeated rows, count once, but lose the lines that recur in other texts.
    """
    key = [F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_text_hash")]
    lines = docs.where(F.col(text).isNotNull()).select(*key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    lines = lines.where(has_words(F.col("line"), min_tokens)).withColumn("tokens", tokens_of(F.col("line")))
    # A passage has two leaves: that of its leading tokens, and one of its own for all its tokens.
    leaf = F.struct(F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf"), F.lit(False).alias("whole"))
    own = F.struct(F.xxhash64("tokens").alias("leaf"), F.lit(True).alias("whole"))
    at = F.explode(F.when(F.size("tokens") > passage, F.array(leaf, own)).otherwise(F.array(leaf)))
    lines = lines.select("_id", "_text_hash", "line_no", "tokens", at.alias("at"))
    lines = lines.select("_id", "_text_hash", "line_no", "tokens", "at.*")
    seen = lines.groupBy("leaf", "whole", "_text_hash").agg(F.lit(1).alias("one")).groupBy("leaf", "whole").count()
    leaves = _stage.stored(seen.where(F.col("count") >= F.when(F.col("whole"), 2).otherwise(min_docs)).select("leaf", "whole"), "leaves")
    # Recurring leaves are few beside lines; only while their count is small do they go to every task.
    small = leaves.count() <= BROADCAST_LEAVES
    few = lines.join(F.broadcast(leaves) if small else leaves, ["leaf", "whole"], "left_semi").withColumn("tokens", F.when(~F.col("whole"), F.col("tokens")))
    few = _stage.stored(few.groupBy("leaf", "tokens", "_id", "_text_hash").agg(F.collect_list("line_no").alias("line_nos")), "lines")
    passages, few = few.where("tokens is null").select("_id", "_text_hash", "line_nos"), few.where("tokens is not null")

    distinct = few.groupBy("leaf", "tokens").agg(F.count_distinct("_text_hash").alias("docs"))
    distinct = _stage.stored(distinct.withColumn("line", F.xxhash64("leaf", "tokens")), "distinct-lines")
    placed = distinct.select("leaf", "line", "docs", F.posexplode("tokens").alias("place", "token"))
    fixed = placed.where(F.col("token") != FIELD).groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs)
    marked = placed.join(fixed.withColumn("fixed", F.lit(True)).drop("n"), ["leaf", "place", "token"], "left")
    parts = F.array_sort(F.collect_list(F.struct("place", F.when(F.col("fixed"), F.col("token")).alias("token"))))
    template = marked.groupBy("leaf", "line").agg(parts.alias("parts"))
    half = 2 * F.size(F.filter("parts", lambda p: p["token"].isNotNull())) >= F.size("parts")
    named = F.array_join(F.transform("parts", lambda p: F.coalesce(p["token"], F.lit(FIELD))), " ")
    # A table: joined right after its aggregation, a line that fills many documents could not be split between tasks.
    template = _stage.stored(template.where(half).select("leaf", "line", named.alias("template")), "line-templates")
    of_line = few.withColumn("line", F.xxhash64("leaf", "tokens")).select("leaf", "line", "_id", "_text_hash", "line_nos")
    found = _stage.stored(of_line.join(template, ["leaf", "line"]), "templates")
    per_text = found.groupBy("leaf", "template", "_text_hash").agg(F.lit(1).alias("one")).groupBy("leaf", "template").count()
    recurring = _stage.stored(per_text.where(F.col("count") >= min_docs).select("leaf", "template"), "recurring")  # for the same reason
    gone = found.join(recurring, ["leaf", "template"], "left_semi").select("_id", "_text_hash", "line_nos").unionByName(passages)
    return gone.groupBy("_id", "_text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("line_nos")))).alias("_dropped"))


def drop_recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """docs with the recurring lines cut out of the text, and n_lines and n_dropped beside it (columns of these names are replaced).

    Null texts stay null and have no lines; an empty text is one empty line. Other lines, blank ones too, stay in order.
    """
    own = _stage.Own(docs)
    doc_id, text = own.of(doc_id), own.of(text)
    gone = dropped_lines(own.df, doc_id, text, **kw)
    x = own.df.withColumn("hash", F.xxhash64(F.col(text)))
    x = x.join(gone, x[doc_id].eqNullSafe(gone["_id"]) & (x["hash"] == gone["_text_hash"]), "left")
    lines = F.split(text, "\n", -1)
    # The lines between one dropped number and the next, so that a text costs its lines and not their product.
    gaps = F.transform(F.concat(F.array(F.lit(-1)), "_dropped"), lambda i, k: F.slice(lines, i + 2, F.coalesce(F.get(F.col("_dropped"), k), F.size(lines)) - i - 1))
    kept = F.flatten(gaps)
    x = x.withColumn("lines", F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long"))
    x = x.withColumn("gone", F.coalesce(F.size("_dropped"), F.lit(0)).cast("long"))
    x = x.withColumn(text, F.when(F.col("gone") > 0, F.array_join(kept, "\n")).otherwise(F.col(text)))
    return x.select(*own.back("n_lines", "n_dropped"), F.col("lines").alias("n_lines"), F.col("gone").alias("n_dropped"))
