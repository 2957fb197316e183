"""Questions to cited passages: BM25, near duplicates, top-k, summaries, prompts and citation checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.functions.stored import met, stored
from pagelore.functions.text import tokens
from pagelore.operators.safety import bound, once

MIN_WORDS, LIMIT, CONTAINMENT = 8, 12, 0.9
K1, B, RANK_WEIGHT = 1.5, 0.75, 0.1
#: What a model is told before the question, and how a passage's source is named.
INSTRUCTION = "Answer the question using only the numbered sources below. Cite every claim with its source number in brackets, e.g. [1]. If the sources do not answer the question, say so."
SOURCE = "\n(source: "


def evidence(blocks: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Blocks that are no headings and have min_words tokens or more, with their tokens."""
    return blocks.where("kind <> 'heading'").withColumn("tokens", once(tokens(F.col("text")))).where(F.size("tokens") >= min_words)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, times: a term that a query repeats counts as often."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


AT = ["page_id", "block_id"]
#: So many blocks' occurrences at most, on average, are scored in a task, for so many weights of queries; so many of their
#: meetings are in memory at once.
BLOCKS_A_TASK, WEIGHTS_A_TASK, CELLS = 50_000, 500_000, 1 << 20
#: By so much a query reads on in its ranks when those it has read hold too few passages.
FURTHER = 8


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _impact(tf: Column, n_tokens: Column, avg_len: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * n_tokens / avg_len))


def bm25(queries: DataFrame, candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_id, page_id, block_id, same (a digest of the text), source_rank and score over 0 of each block of each
    query's pages.

    candidates: query_id, page_id, source_rank. A query's terms travel as one array and a block keeps how often it holds
    each, so blocks are never exploded into tokens. One aggregation, summed up in the map tasks first, gives a query's
    number of blocks, their mean length and its terms' frequencies, however long its list is; scores need no shuffle.
    """
    ev = evidence(blocks).select(*AT, F.unhex(F.md5("text")).alias("same"), "tokens", F.size("tokens").alias("n_tokens"))
    terms = query_terms(queries).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("terms")).withColumn("asked", F.col("terms.term"))
    # a block's tokens are first cut to those that are asked, in one pass; only these few are compared term by term
    own = F.filter("tokens", lambda x: F.array_contains("asked", x))
    tfs = bound(own, lambda found: F.transform("asked", lambda t: F.size(F.filter(found, lambda x: x == t))))
    counted = stored(candidates.join(terms, "query_id").join(ev, "page_id").select("query_id", *AT, "same", "source_rank", "n_tokens", "terms.times", tfs.alias("tfs")), "counted")
    each = counted.select("query_id", "n_tokens", F.posexplode(F.arrays_zip("times", "tfs")).alias("at", "t"))
    stats = each.groupBy("query_id", "at").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("length"), F.count_if(F.col("t.tfs") > 0).alias("df"), F.first("t.times").alias("times"))
    weight = F.col("times") * _idf(F.col("n"), F.col("df")) * (K1 + 1)
    told = stats.groupBy("query_id").agg(F.first(F.col("length") / F.col("n")).alias("avg_len"), F.array_sort(F.collect_list(F.struct("at", weight.alias("weight")))).alias("weights"))
    part = F.zip_with("tfs", "weights", lambda tf, w: w["weight"] * _impact(tf, F.col("n_tokens"), F.col("avg_len")))
    scored = met(counted, stored(told, "stats"), ["query_id"]).withColumn("bm25", F.aggregate(part, F.lit(0.0), lambda total, x: total + x))
    return scored.select("query_id", *AT, "same", "source_rank", (F.col("bm25") / (1 + RANK_WEIGHT * F.col("source_rank"))).alias("score")).where("score > 0")


class CorpusScores:
    """R3, R4 with every block as a candidate of every query, all of source rank 0.

    The blocks are read once, for the occurrences of the queries' terms, which are stored as arrays by block, with their
    impact, what a term of weight 1 brings. Groups of blocks meet the weights of groups of queries in tasks that sum up
    a block's occurrences for all those queries at once, so pairs of blocks and queries are never rows unless they rank.
    Parts of a score are summed in billionths, so that their order can't change it.
    """

    def __init__(self, queries: DataFrame, blocks: DataFrame) -> None:
        terms = stored(query_terms(queries), "terms")
        asked = stored(terms.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "asked")
        # no token is empty, so the empty term, which every block gets, keeps blocks that hold no other
        asked = asked.unionByName(asked.sparkSession.createDataFrame([("", -1)], "term string, term_id bigint"))
        every = blocks.where("kind <> 'heading'").select(*AT, "text").repartition(*AT).withColumn("tokens", once(tokens(F.col("text")))).where(F.size("tokens") >= MIN_WORDS)
        words = every.select(*AT, F.unhex(F.md5("text")).alias("same"), F.size("tokens").alias("n_tokens"), F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term"))
        found = met(words, asked, ["term"]).groupBy(*AT, "same", "n_tokens", "term_id").agg(F.count("*").alias("tf"))
        held = F.filter(F.collect_list(F.struct("term_id", "tf")), lambda h: h["term_id"] >= 0)
        counted = stored(found.groupBy(*AT, "same", "n_tokens").agg(held.alias("h")).select(*AT, "same", "n_tokens", F.col("h.term_id").alias("term_ids"), F.col("h.tf").alias("tfs")), "hits")
        n, avg_len = counted.agg(F.count("*"), F.avg("n_tokens")).first()
        impacts = F.transform("tfs", lambda tf: _impact(tf, F.col("n_tokens"), F.lit(avg_len or 1.0)))
        self.hits = counted.where(F.size("term_ids") > 0).select(*AT, "same", "term_ids", impacts.alias("impacts"))
        self.n_hits = self.hits.count()
        df = counted.select(F.explode("term_ids").alias("term_id")).groupBy("term_id").agg(F.count("*").alias("df"))
        weight = F.col("times") * _idf(F.lit(n), F.col("df")) * (K1 + 1)
        self.weights = stored(terms.join(asked, "term").join(df, "term_id").select("query_id", "term_id", weight.alias("weight")), "weights")

    def _parts(self) -> int:
        return max(int(self.hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.n_hits // BLOCKS_A_TASK))

    def _placed(self, shards: int = 1) -> DataFrame:
        """Occurrences by block, once for each group of queries, in as many parts as shuffles have, and more of many blocks,
        so that a part's share doesn't grow with them."""
        parts = self._parts()
        part = F.pmod(F.xxhash64(*AT), F.lit(parts)).cast("int")
        dealt = self.hits.withColumn("part", part).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return dealt.repartition(parts * shards, "part", "shard")

    def _scored(self, weights: DataFrame, first: int | None, texts: bool) -> DataFrame:
        shards = max(1, -(-weights.count() // WEIGHTS_A_TASK))
        hits, n = self._placed(shards), self._parts()
        parts = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part")
        dealt = weights.withColumn("shard", F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int")).select("*", parts).repartition(n * shards, "part", "shard")
        kinds = dict(weights.select("query_id").dtypes + hits.select(*AT, "same").dtypes)
        out = ", ".join([*(f"{c} {kinds[c]}" for c in ("query_id", *AT, "same")), "source_rank int, score double"])
        return hits.groupBy("part", "shard").cogroup(dealt.groupBy("part", "shard")).applyInArrow(_ranker(first, texts, CELLS), out)

    def every(self) -> DataFrame:
        """query_id, page_id, block_id, same, source_rank and score over 0 of each block."""
        return self._scored(self.weights, None, False)

    def best(self, first: int, left: DataFrame | None = None, texts: bool = False) -> DataFrame:
        """The same of each query's first ranks at least; of the queries in left, if it is given.

        Each task keeps the first ranks of its own blocks, by score, page and block: what is among the first of all
        blocks is among the first of its task's. With texts, blocks of one text have one rank together, that of the first.
        """
        return self._scored(self.weights if left is None else self.weights.join(left.select("query_id").distinct(), "query_id", "left_semi"), first, texts)

    def ranks(self, first: int, left: DataFrame | None = None) -> DataFrame:
        return ranked_texts(self.best(first, left, texts=True), first)


def _ranker(first: int | None, texts: bool, cells: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a group of blocks (with term_ids and impacts) and a group of weights (query_id, term_id, weight) that
    gives each query's first ranks among those blocks, or all of them. cells: so many meetings are in memory at once."""

    def rank(hits: pa.Table, weights: pa.Table) -> pa.Table:
        hits = hits.take(pc.sort_indices(hits, sort_keys=[(c, "ascending") for c in AT], null_placement="at_start"))
        same = hits["same"].combine_chunks()
        if texts:
            hits = hits.take(np.sort(np.unique(same.dictionary_encode().indices.to_numpy(zero_copy_only=False), return_index=True)[1]))
            same = hits["same"].combine_chunks()
        asked = weights["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        n_queries = len(asked.dictionary)
        by_term = np.argsort(weights["term_id"].to_numpy(), kind="stable")
        term, query, weight = weights["term_id"].to_numpy()[by_term], asked.indices.to_numpy(zero_copy_only=False)[by_term], weights["weight"].to_numpy()[by_term]
        held = hits["term_ids"].combine_chunks()
        ends = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        held, impact = held.flatten().to_numpy(), hits["impacts"].combine_chunks().flatten().to_numpy()
        start = np.searchsorted(term, held, "left")
        times = np.searchsorted(term, held, "right") - start
        upto = np.concatenate([[0], np.cumsum(times)])[ends]
        floor, none = np.zeros(n_queries), np.zeros(0, np.int64)
        blocks, queries, scores = none, none, np.zeros(0)
        told, at = [], 0
        while at < len(hits) and n_queries:
            to = min(at + max(1, cells // n_queries), max(at + 1, int(np.searchsorted(upto, upto[at] + cells, "right")) - 1))
            of = slice(ends[at], ends[to])
            k = times[of]
            pos = np.repeat(start[of] - np.cumsum(k) + k, k) + np.arange(k.sum())
            value = weight[pos] * np.repeat(impact[of], k) * 1e9
            whole = np.floor(value)
            whole += value - whole >= 0.5  # halves away from zero, as SQL rounds
            own = np.repeat(np.repeat(np.arange(to - at), np.diff(ends[at : to + 1])), k)
            total = np.bincount(own * n_queries + query[pos], whole, (to - at) * n_queries).reshape(to - at, n_queries)
            b, q = np.nonzero(total > floor)
            blocks, queries, scores = np.concatenate([blocks, b + at]), np.concatenate([queries, q]), np.concatenate([scores, total[b, q]])
            if first is None:
                told.append((blocks, queries, scores))
                blocks, queries, scores = none, none, np.zeros(0)
            else:  # later blocks must pass the score of a query's last rank
                order = np.lexsort((blocks, -scores, queries))
                place = np.arange(len(order)) - np.searchsorted(queries[order], queries[order], "left")
                kept = order[place < first]
                last = order[place == first - 1]
                floor[queries[last]] = scores[last]
                blocks, queries, scores = blocks[kept], queries[kept], scores[kept]
            at = to
        told.append((blocks, queries, scores))
        blocks, queries, scores = (np.concatenate(x) for x in zip(*told, strict=True))
        columns = {"query_id": asked.dictionary.take(pa.array(queries)), **{c: hits[c].combine_chunks().take(pa.array(blocks)) for c in AT}, "same": same.take(pa.array(blocks))}
        return pa.table(columns | {"source_rank": pa.array(np.zeros(len(blocks), np.int32)), "score": pa.array(scores / 1e9)})

    return rank


def bm25_corpus(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    return CorpusScores(queries, blocks).every()


def ranked_texts(scored: DataFrame, first: int) -> DataFrame:
    """query_id, page_id, block_id, source_rank, score and position of each query's first texts, from 1.

    Copies of a text are near duplicates of each other, so of those only the first in order can be a passage: score, then
    source rank, page and block.
    """
    least = F.min(F.struct((-F.col("score")).alias("worse"), "source_rank", *AT)).alias("b")
    one = scored.groupBy("query_id", "same").agg(least).select("query_id", *(F.col(f"b.{c}").alias(c) for c in AT), "b.source_rank", (-F.col("b.worse")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_rank", *AT)
    return one.withColumn("position", F.row_number().over(order)).where(F.col("position") <= first)


def table_ranks(scored: DataFrame) -> Callable[[int, DataFrame | None], DataFrame]:
    """Ranks to read from a table of scores that holds all."""
    return lambda first, left: ranked_texts(scored if left is None else scored.join(left.select("query_id").distinct(), "query_id", "left_semi"), first)


def _grams(text: str) -> frozenset[str]:
    flat = " ".join(text.lower().split())
    return frozenset(flat[i : i + 3] for i in range(len(flat) - 2))


def _near(own: frozenset[str], other: frozenset[str], containment: float) -> bool:
    """Texts without trigrams are near nothing."""
    return bool(own) and bool(other) and len(own & other) >= containment * min(len(own), len(other))


@F.pandas_udf(T.BooleanType())
def _near_any(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether a text is a near duplicate, by the containment given, of one of the texts."""
    of_taken = lru_cache(maxsize=4096)(_grams)
    for text, taken, share in parts:
        yield pd.Series([any(_near(own, of_taken(x), least) for x in others) for own, others, least in zip(map(_grams, text), taken, share, strict=True)], dtype=bool)


def top_passages(ranks: Callable[[int, DataFrame | None], DataFrame], texts: DataFrame, limit: int = LIMIT, containment: float = CONTAINMENT, first: int = 8 * LIMIT) -> DataFrame:
    """For each query up to limit passages by score, without near duplicates of passages already taken.

    ranks: gives, for a number and maybe a table of query_ids, the first so many ranks, as ranked_texts does. texts:
    page_id, block_id, text, url, title of every scored block. A group holds a query's texts of `first` ranks at most.
    Queries that got too few from them read on: of FURTHER times as many ranks, those beyond the last one read that are
    near no passage taken, again `first` at a time. Each such round takes a passage more or multiplies the ranks read, so
    there are at most limit rounds and the logarithm of the number of texts.
    """
    names = ["query_id", *AT, "score", "source_rank"]
    columns = [*names, "url", "title", "text", "position"]

    def with_texts(rows: DataFrame) -> DataFrame:
        return met(texts, rows, AT)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position").reset_index(drop=True)
        taken: list[tuple[int, frozenset[str]]] = []
        for i, text in enumerate(group.text):
            own = _grams(text)
            if group.position[i] > 0 and any(_near(own, g, containment) for _, g in taken):
                continue
            taken.append((i, own))
            if len(taken) == limit:
                break
        got = group.iloc[[i for i, _ in taken]].copy()
        got["reached"], got["full"] = int(group.position.max()), bool((group.position > 0).sum() >= first)
        got["few"] = len(taken) < limit
        return got[[*columns[:-1], "reached", "full", "few"]]

    def step(taken: DataFrame, ranked: DataFrame) -> DataFrame:
        """Queries' passages so far (taken, which have read up to reached) and the next from ranked."""
        have = stored(taken.groupBy("query_id").agg(F.collect_list("text").alias("_taken"), F.max("reached").alias("_reached")), "taken")
        rest = with_texts(met(ranked, have, ["query_id"]).where("position > _reached"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
        new = rest.where(~_near_any("text", "_taken", F.lit(containment))).withColumn("_k", place).where(F.col("_k") <= first)
        return new.select(columns).unionByName(taken.withColumn("position", F.lit(0)).select(columns))

    ranked, depth = stored(ranks(first, None), "ranks"), first
    out = ", ".join([*(f"{c} {kind}" for c, kind in ranked.select(names).dtypes), "url string, title string, text string, reached int, full boolean, few boolean"])
    got = stored(with_texts(ranked).select(columns).groupBy("query_id").applyInPandas(choose, out).withColumn("full", F.lit(False)), "passages")
    done, waiting = got.where("not few"), None
    while True:
        deeper = ranked.groupBy("query_id").agg((F.max("position") >= depth).alias("deeper"))
        few = got.where("few").join(deeper, "query_id")
        again, behind = few.where("full"), few.where("not full and deeper")
        done = done.unionByName(few.where("not full and not deeper").drop("deeper"))
        waiting = behind if waiting is None else waiting.unionByName(behind)
        if not again.isEmpty():
            left = again
        elif not waiting.isEmpty():
            left, waiting = waiting.withColumn("reached", F.lit(depth)), None
            depth *= FURTHER
            ranked = stored(ranks(depth, left), "ranks")
        else:
            break
        got = stored(step(left, ranked).groupBy("query_id").applyInPandas(choose, out), "passages")
        done = done.unionByName(got.where("not few"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_rank", *AT)
    return done.withColumn("passage", F.row_number().over(order).cast("int")).select("query_id", "passage", *AT, F.round("score", 4).alias("score"), "url", "title", "text")


def summary(queries: DataFrame, passages: DataFrame, triaged: DataFrame) -> DataFrame:
    """query_id, n_passages, tokens, n_failures and sources_consulted; queries without passages stay.

    triaged: query_id, url and reason (null for usable sources); a null query_id stands for every query.
    """
    got = passages.groupBy("query_id").agg(F.count("*").alias("n_passages"), F.floor(F.sum(F.length("text")) / 4).cast("long").alias("tokens"))
    seen = triaged.groupBy("query_id").agg(F.count("reason").alias("n_failures"), F.count_if(F.col("reason").isNull()).alias("sources_consulted"))
    everyone = triaged.where("query_id is null").agg(F.count("reason").alias("_failures"), F.count_if(F.col("reason").isNull()).alias("_sources"))  # one row
    joined = queries.select("query_id").distinct().join(got, "query_id", "left").join(seen, "query_id", "left").fillna(0).crossJoin(F.broadcast(everyone))
    return joined.withColumns({"n_failures": F.col("n_failures") + F.col("_failures"), "sources_consulted": F.col("sources_consulted") + F.col("_sources")}).drop("_failures", "_sources")


RESULT = ["url", "title", "citation", "score", "text"]


def results(queries: DataFrame, passages: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each query: query_id, passages (array of structs in order), failures (array of url and reason, every
    source that was tried and could not be used), sources_consulted, tokens, and no_sources, whether no source was usable,
    so that the failures are all there is to tell.

    passages: query_id, passage and the fields of RESULT; sources: query_id, url, reason (null for usable ones) of each
    candidate, as search gives them. Queries without candidates have neither.
    """
    told = F.transform(F.array_sort(F.collect_list(F.struct("passage", *RESULT))), lambda p: F.struct(*(p[c].alias(c) for c in RESULT)))
    got = passages.groupBy("query_id").agg(told.alias("passages"), F.floor(F.sum(F.length("text")) / 4).cast("long").alias("tokens"))
    failed = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("url", "reason"))))
    tried = sources.where("query_id is not null").groupBy("query_id").agg(failed.alias("failures"), F.count_if(F.col("reason").isNull()).alias("sources_consulted"))
    joined = queries.select("query_id").distinct().join(got, "query_id", "left").join(tried, "query_id", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "sources_consulted": F.coalesce("sources_consulted", F.lit(0))})
    lists = {c: F.coalesce(c, F.array().cast(joined.schema[c].dataType)) for c in ("passages", "failures")}
    return joined.withColumns(lists | {"no_sources": F.col("sources_consulted") == 0}).select("query_id", "passages", "failures", "sources_consulted", "tokens", "no_sources")


def summary(queries: DataFrame, passages: DataFrame, triaged: DataFrame) -> DataFrame:
    """query_id, n_passages, tokens, n_failures and sources_consulted; queries without passages stay.

    triaged: query_id, url and reason (null for usable sources); a null query_id stands for every query.
    """
    got = passages.groupBy("query_id").agg(F.count("*").alias("n_passages"), F.floor(F.sum(F.length("text")) / 4).cast("long").alias("tokens"))
    seen = triaged.groupBy("query_id").agg(F.count("reason").alias("n_failures"), F.count_if(F.col("reason").isNull()).alias("sources_consulted"))
    everyone = triaged.where("query_id is null").agg(F.count("reason").alias("_failures"), F.count_if(F.col("reason").isNull()).alias("_sources"))  # one row
    joined = queries.select("query_id").distinct().join(got, "query_id", "left").join(seen, "query_id", "left").fillna(0).crossJoin(F.broadcast(everyone))
    return joined.withColumns({"n_failures": F.col("n_failures") + F.col("_failures"), "sources_consulted": F.col("sources_consulted") + F.col("_sources")}).drop("_failures", "_sources")


def without_sources(queries: DataFrame, triaged: DataFrame) -> DataFrame:
    """Queries that no usable source was found for."""
    usable = triaged.where("reason is null").select("query_id")
    found = F.col("q.query_id").eqNullSafe(F.col("u.query_id"))
    left = queries.select("query_id").distinct().alias("q").join(usable.where("query_id is not null").distinct().alias("u"), found, "left_anti")
    everyone = usable.where("query_id is null").limit(1)  # a source of all
    return left.crossJoin(F.broadcast(everyone.agg(F.count("*").alias("_any")))).where("_any = 0").select("query_id")


def prompts(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id and prompt: the question, then the numbered passages, each with its source, and how to cite them."""
    line = F.concat(F.lit("["), F.col("passage").cast("string"), F.lit("] "), "text", F.lit(SOURCE), "url", F.lit(")"))
    lines = passages.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("passage", line.alias("line")))).alias("_lines"))
    text = F.concat(F.lit(f"{INSTRUCTION}\n\nQuestion: "), "query", F.lit("\n\nSources:\n"), F.array_join(F.transform("_lines", lambda x: x["line"]), "\n\n"), F.lit("\n\nAnswer:"))
    return queries.join(lines, "query_id").select("query_id", text.alias("prompt"))


def check_citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """answer_id, cited (numbers with a passage, in order of first mention), unresolved, and fully_grounded.

    answers: answer_id, query_id, text; passages: query_id, passage.
    """
    marks = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), 1), lambda x: x.try_cast("int")))
    asked = answers.select("answer_id", "query_id", F.posexplode_outer(marks).alias("place", "n"))
    known = passages.select("query_id", F.col("passage").alias("n"), F.lit(True).alias("known"))
    joined = asked.join(known, ["query_id", "n"], "left")
    pick = lambda holds: F.transform(F.array_sort(F.collect_list(F.when(holds & F.col("n").isNotNull(), F.struct("place", "n")))), lambda x: x["n"])
    one = joined.groupBy("answer_id").agg(pick(F.col("known")).alias("cited"), pick(F.col("known").isNull()).alias("unresolved"))
    return one.withColumn("fully_grounded", (F.size("cited") > 0) & (F.size("unresolved") == 0))
