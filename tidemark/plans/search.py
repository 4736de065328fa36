"""Keyword search over the product catalogue, single, for a list, or by a trigram index.

``%`` and ``_`` in a query are wildcards unless the search is literal; behind a backslash
they are signs like others, as is a backslash behind one. A backslash before anything
else stands for itself.

The index holds a posting (trigram, product) for every trigram of a product's searched
texts, and how many products hold each trigram. A query looks up the trigrams of its parts
without wildcards, meets the postings of the rarest, and each pair is then tested in full.
So a query costs as many rows as its rarest trigram has, however common its others are.
Queries without a trigram take one separate scan, by their first one or two signs; those
of wildcards alone only ask for a length.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import top_n, top_per_group
from tidemark.session import write_and_read

# Fixed values.
SEARCH_RESULTS = 8
_SEARCHED = ("name", "description", "tags")
_RESULT = ("product_id", "name", "category", "material", "price_inr")

_GRAM = 3
#: Queries with up to so many signs in all are copied to every task.
_FEW_SIGNS = 1 << 20
#: An escaped wildcard or backslash as group 1, else a backslash that escapes nothing.
_ESCAPES = r"(\\[%_\\])|(\\)"
#: A part of a query without wildcards.
_PART = r"((?:\\[%_\\]|[^%_\\])+)"


class SearchIndex(NamedTuple):
    """``postings``: gram, product_id; ``grams``: gram, products that hold it."""

    postings: DataFrame
    grams: DataFrame


def _order() -> list[Column]:
    return [F.col("price_inr").desc(), F.col("product_id")]


def like_pattern(query: Column | str) -> Column:
    """The query as a pattern in which every backslash escapes something."""
    text = F.lit(query) if isinstance(query, str) else query
    return F.regexp_replace(text, F.lit(_ESCAPES), F.lit("$1$2$2"))


def matches(query: Column | str, literal: bool) -> Column:
    """Any searched column holds the query in any case."""
    found = F.lit(False)
    for name in _SEARCHED:
        if literal:
            hit = F.contains(F.lower(name), F.lower(F.lit(query)))
        else:
            hit = F.ilike(F.col(name), F.concat(F.lit("%"), like_pattern(query), F.lit("%")))
        found = found | F.coalesce(hit, F.lit(False))
    return found


def search_products(
    products: DataFrame, query: str | None, n: int = SEARCH_RESULTS, literal: bool = False
) -> DataFrame:
    """The dearest ``n`` products whose name, description or tags hold the query."""
    hits = products.where(matches(query, literal) if query is not None else F.lit(False))
    return top_n(hits.select(*_RESULT), _order(), n)


def search_products_many(
    products: DataFrame, queries: Sequence[str], n: int = SEARCH_RESULTS, literal: bool = False
) -> DataFrame:
    """The same search for a list of queries in one pass over the catalogue.

    Each product is tested against every query text in place and repeated only for the
    queries it matches; at most ``n`` rows per query and task are shuffled.
    """
    tests = [F.when(matches(query, literal), F.lit(query)) for query in dict.fromkeys(queries)]
    hits = products.select(*_RESULT, F.explode(F.array_compact(F.array(*tests))).alias("query"))
    return top_per_group(hits, "query", _order(), n)


def _searched_text() -> Column:
    return F.lower(F.concat_ws("\n", *_SEARCHED))


def _grams(text: Column, size: int) -> Column:
    """All stretches of ``size`` signs of a text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    return F.coalesce(F.transform(starts, lambda at: F.substring(text, at, F.lit(size))), F.array().cast("array<string>"))


def _spread(products: DataFrame) -> DataFrame:
    """The products dealt evenly over as many tasks as a shuffle has."""
    return products.repartition(int(products.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def build_index(products: DataFrame) -> SearchIndex:
    held = _spread(products.select("product_id", _searched_text().alias("text")))
    postings = held.select(F.explode(F.array_distinct(_grams(F.col("text"), _GRAM))).alias("gram"), "product_id")
    return SearchIndex(postings, _gram_counts(postings))


def _gram_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("gram").agg(F.count(F.lit(1)).alias("products"))


def _are_few(asked: DataFrame) -> bool:
    signs = asked.agg(F.coalesce(F.sum(F.length("query") + 1), F.lit(0)).alias("signs")).first().signs
    return signs <= _FEW_SIGNS


def _met(rows: DataFrame, asked: DataFrame, key: str, few: bool) -> DataFrame:
    """Rows taken from products with the queries' rows of their key; the rows are never broadcast."""
    return rows.join(F.broadcast(asked), key) if few else rows.hint("merge").join(asked, key)


def _asked(searches: DataFrame, literal: bool) -> DataFrame:
    """Different queries with their parts without wildcards, in lower case, and sign wildcards."""
    queries = searches.select("query").where("query IS NOT NULL").distinct()
    lowered = F.lower("query")
    if literal:
        # Only an empty query is without a part, and it asks for no sign.
        return queries.select("query", F.array(lowered).alias("parts"), F.length("query").alias("signs"))
    pattern = like_pattern(lowered)
    parts = F.transform(
        F.regexp_extract_all(pattern, F.lit(_PART), F.lit(1)),
        lambda part: F.regexp_replace(part, r"\\([%_\\])", "$1"),
    )
    bare = F.regexp_replace(pattern, r"\\[%_\\]", "x")
    return queries.select("query", parts.alias("parts"), F.regexp_count(bare, F.lit("_")).alias("signs"))


def _wanted_grams(asked: DataFrame) -> DataFrame:
    parts = F.transform("parts", lambda p: _grams(p, _GRAM))
    return asked.select("query", F.explode(F.array_distinct(F.flatten(parts))).alias("gram"))


def rarest_grams(asked: DataFrame, grams: DataFrame) -> DataFrame:
    """(query, gram) of the rarest trigram of each query; none for a query that no product can hold."""
    known = _wanted_grams(asked).join(grams, "gram", "left")
    rarest = F.min(F.struct(F.coalesce("products", F.lit(0)).alias("n"), F.col("gram"))).alias("rarest")
    chosen = known.groupBy("query").agg(rarest)
    return chosen.where("rarest.n > 0").select("query", F.col("rarest.gram").alias("gram"))


def _by_index(products: DataFrame, asked: DataFrame, index: SearchIndex | None, literal: bool, few: bool) -> DataFrame:
    if index is None:
        # Only the trigrams asked for are counted, so there are no more of them than the queries have.
        postings = build_index(products).postings
        index = SearchIndex(postings, _gram_counts(_met(postings, _wanted_grams(asked).select("gram").distinct(), "gram", few)))
    met = _met(index.postings, rarest_grams(asked, index.grams), "gram", few).select("query", "product_id")
    return met.join(products, "product_id").where(matches(F.col("query"), literal)).select(*_RESULT, "query")


def _by_short_key(products: DataFrame, asked: DataFrame, literal: bool, few: bool) -> DataFrame:
    """Queries of one or two signs between wildcards, met by their longest part."""
    longest = F.array_max(F.transform("parts", lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    keyed = _spread(products).withColumn("__text", _searched_text())
    keys = F.array_distinct(F.concat(_grams(F.col("__text"), 1), _grams(F.col("__text"), 2)))
    keyed = keyed.withColumn("key", F.explode(keys)).drop("__text")
    hits = _met(keyed, asked.select("query", longest.alias("key")), "key", few)
    return hits.where(matches(F.col("query"), literal)).select(*_RESULT, "query")


def _by_length(products: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """Queries of wildcards alone: products with a text of at least as many signs as they ask for.

    Of the products of each length only the dearest ``n`` count, and they are repeated
    for the lengths asked, which are as many as the longest query has signs at most.
    """
    lengths = F.greatest(*[F.length(name) for name in _SEARCHED])
    sized = products.withColumn("size", lengths).where("size IS NOT NULL").select(*_RESULT, "size")
    few = top_per_group(sized, "size", _order(), n).drop("place")
    wanted = asked.agg(F.collect_set("signs").alias("wanted")).scalar()
    repeated = few.withColumn("__wanted", wanted).withColumn(
        "signs", F.explode(F.filter("__wanted", lambda signs: signs <= F.col("size")))
    )
    hits = top_per_group(repeated.drop("size", "__wanted"), "signs", _order(), n).drop("place")
    return hits.join(asked.select("query", "signs"), "signs").select(*_RESULT, "query")


def search_products_asked(
    products: DataFrame,
    searches: DataFrame,
    n: int = SEARCH_RESULTS,
    literal: bool = False,
    index: SearchIndex | None = None,
) -> DataFrame:
    """The same search for a table of queries (column ``query``), by the index.

    Repeated queries are answered once, NULL is not. Without an index one is built.
    """
    asked = _asked(searches, literal).withColumn(
        "reach", F.coalesce(F.array_max(F.transform("parts", F.length)), F.lit(0))
    )
    asked = write_and_read(asked, "queries")
    few = _are_few(asked)
    long = asked.where(F.col("reach") >= _GRAM)
    short = asked.where((F.col("reach") > 0) & (F.col("reach") < _GRAM))
    bare = asked.where("reach = 0")
    hits = (
        _by_index(products, long, index, literal, few)
        .unionByName(_by_short_key(products, short, literal, few))
        .unionByName(_by_length(products, bare, n))
    )
    return top_per_group(hits, "query", _order(), n)
