"""Batch search, sorting and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.session import settle, with_global_rank


def search_tokens(tokens: DataFrame, query: str, query_norm: str, limit: int = 20) -> DataFrame:
    """Form contains the query, norm starts with it, or lemma contains it; one row per norm, shortest first.

    Matches are reduced to one per norm in every task; the final top rows are merged, not sorted whole.
    """
    q, qn = F.lit(query), F.lit(query_norm)
    hits = tokens.where(tx.match_contains(q, F.col("form"), F.col("lemma")) | tx.match_prefix(qn, F.col("norm")))
    rest = [c for c in tokens.columns if c not in ("token_id", "norm")]
    one = hits.groupBy("norm").agg(F.min(F.struct("token_id", *rest)).alias("_t")).select("norm", "_t.*")
    return one.orderBy(F.char_length("norm"), "token_id").limit(limit)


GRAM = 3        # characters of an index entry; shorter queries are looked up by all of their characters


def _pieces(text: Column, size: Column | int) -> Column:
    """All runs of ``size`` characters; none if the text is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.char_length(text) >= size, F.transform(
        F.sequence(F.lit(1), F.char_length(text) - size + 1), lambda i: F.substring(text, i, size))).otherwise(
        F.array().cast("array<string>"))


def search_index(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (entries, postings) over the vocabulary of ``tokens`` (token_id, form, norm, lemma).

    An entry is a distinct (norm, form, lemma) with its first token and its number of tokens, reduced in every task before
    entries meet. Postings name, for each run of one to ``GRAM`` characters, the entries whose form or lemma holds it,
    and for each beginning of a norm of up to so many characters the entries that begin with it. Both grow with the
    vocabulary, not with the tokens, and are built once for any number of searches.
    """
    kinds = tokens.groupBy("norm", "form", "lemma").agg(F.min("token_id").alias("token_id"), F.count(F.lit(1)).alias("n"))
    entries = settle(kinds.withColumn("entry", F.monotonically_increasing_id()))
    sizes = range(1, GRAM + 1)
    inside = F.array_distinct(F.flatten(F.array(*[
        F.coalesce(_pieces(F.col(c), k), F.array().cast("array<string>")) for c in ("form", "lemma") for k in sizes])))
    ahead = F.array_distinct(F.array(*[F.substring("norm", 1, k) for k in sizes]))
    both = F.concat(F.transform(inside, lambda g: F.struct(F.lit(False).alias("begins"), g.alias("gram"))),
                    F.transform(F.filter(ahead, lambda g: g != ""), lambda g: F.struct(F.lit(True).alias("begins"), g.alias("gram"))))
    return entries, settle(entries.select("entry", F.inline(both)).repartitionByRange("gram").sortWithinPartitions("gram"))


def search_tokens_many(index: tuple[DataFrame, DataFrame], queries: DataFrame, limit: int = 20) -> DataFrame:
    """:func:`search_tokens` for many queries at once (query_id, query, query_norm) on a stored :func:`search_index`.

    A query becomes its runs of ``GRAM`` characters, or itself if it is shorter; entries that are in the postings of all
    of them are compared with the query. Empty queries find nothing. One row per query and norm: norm, its first token
    among the hits, its number of tokens, and rank by length of the norm, then token.
    """
    entries, postings = index
    asked = settle(queries.select("query_id", "query", "query_norm"))
    size = F.least(F.char_length("query"), F.lit(GRAM))
    text = F.when(F.char_length("query") > 0, F.array_distinct(_pieces(F.col("query"), size)))
    inside = asked.select("query_id", "query", F.size(text).alias("need"), F.explode(text).alias("gram"), F.lit(False).alias("begins"))
    start = asked.where(F.char_length("query_norm") > 0).select(
        "query_id", "query_norm", F.substring("query_norm", 1, GRAM).alias("gram"), F.lit(True).alias("begins"))
    met = inside.join(postings, ["begins", "gram"]).groupBy("query_id", "query", "need", "entry").agg(
        F.count(F.lit(1)).alias("have")).where("have = need")
    found = entries.select("entry", "norm", "form", "lemma", "token_id")
    holds = met.join(found, "entry").where(
        tx.match_contains(F.col("query"), F.col("form"), F.col("lemma"))).select("query_id", "norm", "token_id")
    opens = start.join(postings, ["begins", "gram"]).join(found, "entry").where(
        tx.match_prefix(F.col("query_norm"), F.col("norm"))).select("query_id", "norm", "token_id")
    one = holds.unionByName(opens).groupBy("query_id", "norm").agg(F.min("token_id").alias("token_id"))
    order = Window.partitionBy("query_id").orderBy(F.char_length("norm"), F.col("token_id"))
    top = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    # totals of the shown norms only
    totals = entries.join(top.select("norm").distinct(), "norm", "left_semi").groupBy("norm").agg(F.sum("n").alias("occurrences"))
    return top.join(totals, "norm")


def search_items(counted: DataFrame, query: str, query_norm: str, limit: int = 20) -> DataFrame:
    """Dictionary items by item text, space-less text or transliteration; most frequent first."""
    q, qn = F.lit(query), F.lit(query_norm)
    spaceless = tx.match_contains(tx.strip_spaces(qn), tx.strip_spaces(F.col("item")))
    hits = counted.where(tx.match_contains(q, F.col("item")) | spaceless | tx.match_contains(qn, F.col("translit")))
    return hits.orderBy(F.desc("occurrences"), F.asc("item")).limit(limit)


def search_all(items: DataFrame, tokens: DataFrame, kind: str = "all") -> DataFrame:
    """Both result lists as one table (category, label); ``kind`` selects."""
    roots = items.select(F.lit("item").alias("category"), F.col("item").alias("label"))
    words = tokens.select(F.lit("token").alias("category"), F.col("norm").alias("label"))
    if kind == "item":
        return roots
    if kind == "token":
        return words
    return roots.unionByName(words)


def browse(counted: DataFrame, sort: str) -> list[Column]:
    """Order columns of the browser: byte order, or frequency with byte order among equals."""
    return [F.asc("item")] if sort == "alpha" else [F.desc("occurrences"), F.asc("item")]


def page_rows(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page. Each task keeps only the rows up to the end of the page."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_meta(rows: DataFrame, number: int, size: int, sort: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(number).alias("current_page"),
        F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long").alias("last_page"),
        "total", F.lit(sort).alias("sort"))


def paged(rows: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """Every row with its page number, for exporting all pages at once."""
    ranked = with_global_rank(rows, order, "rank")
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / size) + 1)


def dense_reorder(entries: DataFrame, requested: DataFrame, key: str = "entry_id") -> DataFrame:
    """Requested positions closed up to 1..n by (position, id); locked and unknown entries keep out."""
    open_entries = entries.where("not is_locked").select(key)
    wanted = requested.join(open_entries, key, "left_semi")
    return with_global_rank(wanted, [F.asc("position"), F.asc(key)], "sort_order").select(key, "sort_order")
