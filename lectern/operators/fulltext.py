"""Full-text search: tokens, stop words, stems, conjunctive match and cover-density rank.

Postings are exploded only for the query's terms; a chunk's positions of these are gathered and ranked. Approximate
against other engines' parsers: words are ``\\w+`` runs, compounds and numbers get no special tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, lexemes, stem, stems
from .vector import top_k


def query_terms(query: str, stemmed: bool = True) -> list[str]:
    """Distinct lexemes of a plain query, all of which must occur."""
    import re

    words = re.findall(r"\w+", query.lower())
    return list(dict.fromkeys(stem(w) for w in words if w not in STOP_WORDS) if stemmed else dict.fromkeys(words))


def cover_density(positions: list[list[int]]) -> float:
    """The rank of a text from each term's positions: minimal covers weigh 0.1, less by the gaps inside them.

    One term alone counts 0.1 for each occurrence.
    """
    if not positions or any(len(p) == 0 for p in positions):
        return 0.0
    events = sorted((at, term) for term, ps in enumerate(positions) for at in ps)
    last: dict[int, int] = {}
    total, previous, low, upto = 0.0, -1, 0, 0
    for at, term in events:
        last[term] = at
        if len(last) < len(positions):
            continue
        begin = min(last.values())
        if begin == previous:
            continue
        previous = begin
        # covers begin and end ever later: two pointers count the events between
        while events[low][0] < begin:
            low += 1
        while upto < len(events) and events[upto][0] <= at:
            upto += 1
        noise = (at - begin) - (upto - low - 1)
        total += 0.1 / (1 + max(0, noise)) if len(positions) > 1 else 0.1
    return total


def cover_rank(positions: Column, terms: int) -> Column:
    """``cover_density`` as a column: one walk over the positions of all terms, which keeps where each term was last."""
    placed = F.flatten(F.transform(positions, lambda ps, t: F.transform(ps, lambda at: F.struct(at.cast("int").alias("at"), t.cast("int").alias("t")))))
    events = F.transform(F.array_sort(placed), lambda e, i: F.struct(e["at"].alias("at"), e["t"].alias("t"), i.cast("int").alias("i")))
    never = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("i"))
    start = F.struct(F.array(*[never] * terms).alias("last"), F.lit(-1).alias("begin"), F.lit(0.0).alias("total"))

    def step(acc: Column, e: Column) -> Column:
        last = F.transform(acc["last"], lambda x, t: F.when(t == e["t"], F.struct(e["at"].alias("at"), e["i"].alias("i"))).otherwise(x))
        first = F.array_min(last)
        fresh = (first["at"] >= 0) & (first["at"] != acc["begin"])
        gaps = (e["at"] - first["at"]) - (e["i"] - first["i"])
        return F.struct(last.alias("last"), F.when(fresh, first["at"]).otherwise(acc["begin"]).alias("begin"), (acc["total"] + F.when(fresh, F.lit(0.1) / (1 + F.greatest(gaps, F.lit(0)))).otherwise(F.lit(0.0))).alias("total"))

    return F.aggregate(events, start, step, lambda acc: acc["total"])


def sparse_search(chunks: DataFrame, query: str, k: int = 10, id_: str = "chunk_id", content: str = "content", stemmed: bool = True) -> DataFrame:
    """``(id, rank)`` of the best chunks that hold every term; nothing for a query of no terms."""
    terms = query_terms(query, stemmed)
    if not terms:
        return chunks.select(F.col(id_), F.lit(0.0).alias("rank")).limit(0)
    tokens = lexemes(F.col(content))
    words = stems(tokens) if stemmed else tokens

    def places(term: str):
        return F.transform(F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["x"] == term), lambda y: y["i"] + 1)

    if not stemmed:  # a text that lacks a term anywhere need not be cut into words
        low = F.lower(F.coalesce(F.col(content), F.lit("")))
        for t in terms:
            chunks = chunks.where(F.contains(low, F.lit(t)))
    held = chunks.select(id_, words.alias("w")).select(id_, *[places(t).alias(f"p{n}") for n, t in enumerate(terms)])
    matched = held.where(" and ".join(f"size(p{n}) > 0" for n in range(len(terms))))
    if len(terms) == 1:
        return top_k(matched.select(id_, (F.size("p0") * F.lit(0.1)).alias("rank")), "rank", id_, k)
    return top_k(matched.select(id_, cover_rank(F.array(*[F.col(f"p{n}") for n in range(len(terms))]), len(terms)).alias("rank")), "rank", id_, k)


def postings(chunks: DataFrame, id_: str = "chunk_id", content: str = "content", stemmed: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(lexeme, id, carried..., positions)``: an inverted index to store partitioned or bucketed by lexeme."""
    tokens = lexemes(F.col(content))
    each = chunks.select(id_, *carried, F.posexplode(stems(tokens) if stemmed else tokens).alias("at", "lexeme")).where("lexeme is not null")
    return each.groupBy("lexeme", id_, *carried).agg(F.sort_array(F.collect_list(F.col("at") + 1)).alias("positions"))


def indexed_search(index: DataFrame, query: str, k: int = 10, id_: str = "chunk_id", stemmed: bool = True) -> DataFrame:
    """``sparse_search`` over stored ``postings``: only the postings of the query's terms are read, no text."""
    terms = query_terms(query, stemmed)
    if not terms:
        return index.select(F.col(id_), F.lit(0.0).alias("rank")).limit(0)
    met = index.where(F.col("lexeme").isin(*terms)).groupBy(id_).agg(F.collect_list("positions").alias("p")).where(F.size("p") == len(terms))
    rank = F.size(F.col("p")[0]) * F.lit(0.1) if len(terms) == 1 else cover_rank(F.col("p"), len(terms))
    return top_k(met.select(id_, rank.alias("rank")), "rank", id_, k)
