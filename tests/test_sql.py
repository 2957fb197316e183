"""Every registered query of the library that has SQL, against DuckDB at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from pagelore.jobs.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return con


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(frame.columns)
    shown = frame[columns].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else v).astype(str)
    return shown.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    pd.testing.assert_frame_equal(_plain(QUERIES[name](spark, DIR).toPandas()), _plain(duck.sql(SQL[name]).df()))


@pytest.mark.parametrize("name", ["r6_top_passages", "v7_v9_deltas", "e15_verdict"])
def test_runs_whatever_the_partitions(spark, name):
    key = "spark.sql.shuffle.partitions"
    seen = []
    for n in ("2", "7"):
        spark.conf.set(key, n)
        seen.append(_plain(QUERIES[name](spark, DIR).toPandas()))
    spark.conf.set(key, "4")
    pd.testing.assert_frame_equal(*seen)


ODD = "c8_triage e2_reach_rows e3_reach_report p1_static_text p2_read_blocks p3_page_text w1_candidate_search w1_failures w1_search r7_failures r7_summary t1_triage_stream v1_v2_rendering".split()


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory):
    """Given tables, with pages whose titles end within a reference, thin pages, a page without blocks, and pages of one address."""
    base = tmp_path_factory.mktemp("odd")
    for name in TABLES:
        if name != "pages":
            (base / f"{name}.parquet").symlink_to(f"{DIR}/{name}.parquet")
    pages = pd.read_parquet(f"{DIR}/pages.parquet").head(40)
    head = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{0}</title></head><body><nav><ul><li><a href="/a">a&amp;b</a></li></ul></nav><div class="ad">{1}</div><article><h1>{0}</h1>{2}</article><footer>&copy; x &middot; y.</footer></body></html>'
    long = " ".join(f"word{i} of the page" for i in range(20))
    more = [head.format(f"Cut {cut}", "Ad.", f"<p>{long} {cut}</p>") for cut in ("&amp", "&quot", "&am", "&&amp")]
    more += [head.format("Thin", long, "<p>Few words.</p>")] * 4 + [head.format("", long, "")] * 2
    n = len(pages)
    # addresses of given pages, so that a candidate's address has two pages, one of which is thin
    odd = pd.DataFrame({"page_id": range(n, n + len(more)), "url": [f"https://odd.test/{i}" if i % 2 else pages.url[i] for i in range(len(more))], "html": more})
    pd.concat([pages, odd]).to_parquet(base / "pages.parquet")
    return str(base)


@pytest.mark.parametrize("name", ODD)
def test_same_rows_of_odd_pages(spark, odd_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{odd_dir}/{table}.parquet'")
    pd.testing.assert_frame_equal(_plain(QUERIES[name](spark, odd_dir).toPandas()), _plain(con.sql(SQL[name]).df()))


@pytest.mark.parametrize("name", ["v3_refs", "v4_stale_refs", "v5_targets", "v6_restamped", "v7_v9_deltas", "v10_sent_payloads"])
def test_histories_are_never_sent_to_all(spark, name):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_texts_meet_before_their_trigrams_are_taken(spark):
    plan = QUERIES["r5_near_duplicate"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(text" in plan


def test_trigrams_count_characters(spark):
    from pagelore.functions.text import trigrams

    texts = ["a😀b😀bc", "ab", "", "  A\n B  c", "xyxyxyx" * 3000]
    for row in spark.createDataFrame([(x,) for x in texts], "text string").select("text", trigrams("text").alias("g")).collect():
        flat = " ".join(row.text.lower().split())
        assert set(row.g) == {flat[i : i + 3] for i in range(len(flat) - 2)} and len(row.g) == len(set(row.g))


def test_pages_are_parsed_once_for_reach(spark):
    plan = QUERIES["e2_reach_rows"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


def test_a_task_scores_no_more_blocks_of_more(spark, monkeypatch):
    from pagelore.jobs import tables
    from pagelore.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCKS_A_TASK", 100)
    scores = retrieval.CorpusScores(tables.corpus_questions(spark, DIR), tables.blocks(spark, DIR))
    placed = scores._placed()
    assert placed.count() == scores.n_hits and placed.rdd.getNumPartitions() == -(-scores.n_hits // 100) > 4


def test_pages_are_parsed_once_for_flags(spark):
    plan = QUERIES["i3_i4_elision_and_flags"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


def test_blocks_meet_queries_as_arrays(spark, monkeypatch):
    """No row is made of a block and a question before ranks are known, and parts of any size give the same ranks."""
    from pagelore.jobs import tables
    from pagelore.operators import retrieval

    scores = retrieval.CorpusScores(tables.corpus_questions(spark, DIR), tables.blocks(spark, DIR))
    plan = scores.best(3, texts=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "FlatMapCoGroupsInArrow" in plan
    plain = lambda df: sorted(map(tuple, df.select("query_id", "position", "page_id", "block_id", "score").collect()))
    want = plain(scores.ranks(7))
    assert want == plain(retrieval.ranked_texts(scores.every(), 7))
    for name, few in (("CELLS", 50), ("WEIGHTS_A_TASK", 200), ("BLOCKS_A_TASK", 150)):
        monkeypatch.setattr(retrieval, name, few)
    assert plain(scores.ranks(7)) == want and len(want) > 100


def test_tokens_of_a_block_are_taken_once(spark):
    plan = QUERIES["r1_r2_evidence"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
