"""Cross-tokenizer alignment, the factorisation machine and the Merkle manifest against plain versions on small fixtures."""

import hashlib
import itertools
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.llm import cross_tokens, factors, jaccard_join, merkle, token_counts, token_files, tokenizers
from pagelore.llm.queries import QUERIES, SQL, tokenizer_path

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# cross-tokenizer alignment

MEASURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
STRANGE = [
    None, "", " ", "  ", "a  b", "\t  bar \n baz", "x\n\n y", "foo \nbar   ", "▁ hi", "a▁b", "<|endoftext|> <s> </s> <unk>", "日本語のテキスト です。", "🙂🙂 ok" * 3, "\x00 nul", "=== " * 50, "=" * 5000, "é" * 900,
    " lead", "trail ", " nb sp  x", "\x1c sep \x85 y", "it's we'll 123 4567", "a\r\n b\r\n\tc", "a　 b", "…… …",
]


def plain_alignment(rows):
    """Whole texts through both libraries, all pairs of each group written out."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tokens = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a_tokens.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    level = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    out, count = [], Counter()
    for doc_id, text in rows:
        row = {"doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""}
        links = Counter()
        out.append((row, links))
        if not text:
            continue
        a, b = a_tokens.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        bytes_a = [bytes(level[c] for c in a_tokens.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(pieces.id_to_piece(x)[3:5], 16)]) if pieces.is_byte(x) else pieces.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b)]
        groups, at = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[x for x, e in zip(ids, own, strict=True) if at < e <= cut] for ids, own in zip((a, b), ends, strict=True)])
            links.update(itertools.product(*groups[-1]))
            at = cut
        said = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        row.update(n_a=len(a), n_b=len(b), n_groups=len(groups), n_links=links.total(), groups_sha256=hashlib.sha256(said.encode()).hexdigest())
        count.update(links.keys())
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [row | {"n_best": sum(k for p, k in links.items() if count[p] == most[p[0]]), "count_sum": sum(k * count[p] for p, k in links.items())} for row, links in out], count


def test_alignment_against_plain_version(spark):
    rng = random.Random(3)
    texts = STRANGE + ["".join(rng.choice(" \n\tab é✓1.") for _ in range(rng.randrange(60))) for _ in range(80)]
    rows = [*enumerate(texts), (None, "same text here"), (7, "same text here"), (7, "same text here")]
    want, count = plain_alignment(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n_a": F.lit("x"), "pair": F.lit(1)})
    shown = lambda found: sorted(repr(tuple(r[c] for c in MEASURES)) for r in found)
    for most in (cross_tokens.BROADCAST_PAIRS, 0):  # sent to all, and joined by a shuffle over salts
        measures, pairs = cross_tokens.align(df, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), broadcast_pairs=most)
        assert shown(measures.collect()) == shown(want)
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == dict(count)
    measures, pairs = cross_tokens.align(df.limit(0), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    assert measures.count() == 0 and pairs.count() == 0


def test_alignment_of_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r.asDict() for r in QUERIES["op11_cross_tokenizer_alignment"](spark, sf).collect()}
    assert got == {r["doc_id"]: r for r in plain_alignment(rows)[0]}


def test_alignment_forgets_and_counts_long_groups(monkeypatch):
    own = cross_tokens.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    texts = ["the cat sat on the mat", "é" * 400 + " ====", "word " * 200_000]
    want = [(s.tolist(), g, p.tolist(), n.tolist()) for s, g, p, n in own(texts)]
    monkeypatch.setattr(cross_tokens, "REMEMBERED", 1)
    monkeypatch.setattr(cross_tokens, "LONG_GROUP", 0)
    again = cross_tokens.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    for k, text in enumerate(texts):
        (s, g, p, n) = again([text])[0]
        assert (s.tolist(), g, p.tolist(), n.tolist()) == want[k]


# quality classifier


def test_factors_in_linear_time_equal_all_pairs():
    rng = np.random.default_rng(5)
    model = factors.Model(0.3, rng.normal(size=factors.N_FEATURES), rng.normal(0, 0.1, (factors.N_FEATURES, factors.RANK)), rng.normal(size=factors.N_STATS), np.ones(factors.N_STATS))
    found = factors.Extractor()(["Some words, some MORE words!\n- item\n- item", "", None], [40, None, 3])
    for (words, stats), score in zip(found, model(found), strict=True):
        features = [(int(w), 1 / np.sqrt(len(words))) for w in words] + [((1 << factors.BITS) + i, x) for i, x in enumerate(model.scaled(stats))]
        z = model.bias + sum(model.weights[i] * x for i, x in features) + sum(model.vectors[i] @ model.vectors[j] * x * y for (i, x), (j, y) in itertools.combinations(features, 2))
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_factors_fit_lowers_the_loss():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 30)) + ("!" * 40 if k % 2 else ".") for k in range(60)]
    found = factors.Extractor()(texts, [len(x) for x in texts])
    good = np.arange(60) % 2 == 0
    losses = [-np.log(np.where(good, p, 1 - p)).mean() for p in (factors.fit(found, good, 1.0, steps=k)(found) for k in (0, 40))]
    assert losses[0] > 0.6 and losses[1] < 0.1


def test_quality_scores(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op12_quality_classifier"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["predicted"], q) for i, q in labels.items() if i in got and got[i]["held_out"]]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.9


def test_quality_rows_and_labels(spark):
    rows = [(i, ("fine prose goes here, with some words. " if i % 2 else "SPAM!!! $$$ *** ") * 9, "en", "s", 100) for i in range(60)]
    odd = [(100, None, None, None, None), (101, "", "en", "s", 0), (None, "no id", "en", "s", 5), (1, "fine prose goes here", "en", "s", 20), (102, "long " * 300_000, "en", "s", 1_500_000)]
    df = spark.createDataFrame(rows + odd, DOCS).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 1), (None, 1), (3, None), (1, 7)], "doc_id bigint, quality int")
    model = factors.train(df, labels)
    scored = factors.score(df, model, keep=("doc_id", "score"))
    assert scored.columns == ["doc_id", "score"] and scored.count() == len(rows + odd)
    found = {r["doc_id"]: r["score"] for r in scored.where("doc_id < 60 and doc_id <> 1").collect()}
    assert min(found[i] for i in range(3, 60, 2)) > 0.5 > max(found[i] for i in range(2, 60, 2))
    again = factors.train(df.repartition(3), labels.repartition(2))
    assert np.allclose(model.weights, again.weights) and model.bias == pytest.approx(again.bias)
    few = factors.train(df.unionByName(df), labels, sample=5)  # repeated ids bring no more rows
    assert factors.score(df, few).count() == len(rows + odd)
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert factors.score(df.limit(2), factors.train(df, none)).count() == 2
    assert factors.score(df.limit(0), model).count() == 0


# Merkle manifest


def _digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(values):
    return _digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def plain_manifest(rows):
    """rows: doc_id, text, lang, source, n_chars. Trees built and proofs walked node by node."""
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    of = lambda r, text: _leaf((r[0], r[3], r[2], r[4], text))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, of(r, r[1]), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: _levels([n[2] for n in sorted(groups[x], key=lambda n: n[:3])]) for x in names}
    above = _levels([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for place, (_, _, leaf, r) in enumerate(sorted(groups[x], key=lambda n: n[:3])):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now, proof = of(r, r[1].translate(lower) if tampered and r[1] is not None else r[1]), []
            for tree, at in ((trees[x], place), (above, k)):
                for level in tree[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    proof += run[: at % 8] + run[at % 8 + 1 :]
                    now = _digest("".join([*run[: at % 8], now, *run[at % 8 + 1 :]]))
                    at //= 8
            out.append((r[0], leaf, trees[x][-1][0], above[-1][0], _digest("".join(proof)), now, now == above[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9}, {"en": 8, "de": 1}, {None: 3, "": 2, "en": 70, "fr": 65, "É": 1, "z": 8, "y": 1, "x": 1, "w": 1, "v": 2}, {"en": 600}])
def test_manifest_against_plain_version(spark, tmp_path, sizes):
    rng = random.Random(4)
    rows = [(k * 1000 + i, rng.choice(["Some Text", "", None, "ünï ✓ 汉字", "lower"]) if i else "A" * 5, lang, rng.choice(["s", None]), rng.choice([i, None])) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    if len(rows) > 100:  # null and repeated ids, repeated rows
        rows += [rows[5], rows[5], (None, "Null Id", "en", None, None), (None, "Null Id", "en", None, None), (rows[7][0], "Other", "en", "s", 1)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_of_nothing_and_of_other_columns(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).count() == 0
    rows = spark.createDataFrame([(1, "x", b"\1"), (2, "x", b"\2"), (3, None, b"\3")], "id int, tree string, digest binary")
    made = merkle.manifest(rows, "tree", ["id"], "digest", ("id",))
    assert made.columns == ["id", "digest", "subroot", "root", "way"]
    assert made.select((merkle.folded(merkle.hex_digest("digest")) == merkle.hex_digest("root")).alias("ok")).where("ok").count() == 3


def test_manifest_without_broadcasts(spark, monkeypatch):
    """Beyond the bound of a broadcast pointers meet by a shuffle, with the same result."""
    rows = spark.range(700).select("id", (F.col("id") % 3).cast("string").alias("lang"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    shown = lambda: sorted(map(repr, merkle.manifest(rows, "lang", ["id"], "leaf", ("id",)).collect()))
    want = shown()
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    assert shown() == want


def test_manifest_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rows = con.execute(SQL["op13_merkle_manifest"]).fetchall()
    assert sorted(rows) == sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, sf).collect()))


# very long texts


def test_very_long_texts(spark):
    long = "a long text of many words. " * 150_000
    df = spark.createDataFrame([(1, long, "en", "s", 0), (2, long + "more", "en", "s", 0), (3, "x" * 3_000_000, "en", "s", 0), (4, None, "en", "s", 0)], DOCS)
    path = tokenizer_path("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in token_files.round_trip(df, lambda: tokenizers.word_encoder(path), end_id=2).collect()}
    assert got[4]["n_tokens"] == 1 and got[2]["n_tokens"] == got[1]["n_tokens"] + 1 and got[2]["start"] == got[1]["n_tokens"]
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df.where("doc_id <> 3"), lambda: tokenizers.rank_encoder(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), 50256).collect()}
    assert counted[1] > 1_000_000 and counted[2] == counted[1]
    joined = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert joined == {1: (6, 1), 2: (7, 1), 3: (1, 3), 4: (0, 4)}
