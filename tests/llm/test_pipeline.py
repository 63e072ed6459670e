"""The corpus pipeline: columns, effect of every stage, and its last stage against the tokenizer."""

import random

import pytest

import corpus_pipeline
from tests.conftest import SF
from threatloom.llm import near_copies, simhash
from threatloom.llm.shared import materialize


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages_keep_columns_and_take_effect(stages):
    docs, quality, unique, clean, mixed, tokens = stages
    assert all(s.columns == docs.columns for s in stages[1:5])
    assert docs.count() > quality.count() >= unique.count() >= clean.count() > 0
    assert unique.join(simhash.near_duplicates(quality).where("doc_id = component_id"), "doc_id", "left_anti").count() == 0
    assert mixed.join(clean, "doc_id", "left_anti").count() == 0
    assert tokens.count() == mixed.count()


def test_near_dedup_finds_copies_of_similarity_four_fifths(spark):
    chance = random.Random(3)
    given = {}
    for k in range(30):
        words = [f"w{chance.randrange(5000)}" for _ in range(chance.randrange(20, 200))]
        for copy in range(4):
            changed = list(words)
            for _ in range(chance.randrange(1, 5) if copy else 0):
                changed[chance.randrange(len(words))] = f"x{chance.randrange(5000)}"
            given[4 * k + copy] = " ".join(changed)
    given[120] = given[7] + "  "
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in given.items()}
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    for i in given:
        for j in given:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {d: low if g == high else g for d, g in group.items()}
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == set(group.values()) and kept < {r["doc_id"] for r in simhash.keep_one(docs).collect()}


def test_large_groups_make_few_pairs(spark):
    """Copies of one text with a word changed, and texts that share a long passage but little else: links are those
    of all pairs, as components, and candidates grow with the texts."""
    chance = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(base)]
    for k in range(120):
        changed = list(base)
        changed[chance.randrange(60)] = f"x{k}"
        texts.append(" ".join(changed))
    texts += [passage + " " + " ".join(f"u{k}x{i}" for i in range(30)) for k in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    found = {r["node"]: r["component"] for r in simhash.components(near_copies.links(df)).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert [found.get(i, i) for i in range(len(texts))] == root and root[:121] == [0] * 121 and root[121:] == list(range(121, 241))
    assert near_copies.links(df).count() < 3 * len(texts)


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-empty-{name}")
        assert docs.count() == 0


def test_stages_with_hard_cases(spark):
    """Nulls in every column, blank and very long texts, repeated rows and ids, columns with names that stages use."""
    from pyspark.sql import functions as F

    own = "".join(f"plain{i} sentence{i % 97} number{i % 89} " for i in range(30))
    odd = [(900, None, "s"), (901, "", "s"), (902, " \t\n", None), (None, None, None), (None, own + "alpha", "s"), (903, own + "alpha", "s"), (904, own + "alpha", None), (905, "first text of an id " * 9, "s"), (905, "second and other text " * 9, "s"), (906, own + "beta gamma", None), (906, own + "beta gamma", None), (907, "long " + " ".join(f"t{i} v{i % 991}" for i in range(40_000)), "s")]
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 80").select("doc_id", "text", "source")
    docs = base.unionByName(spark.createDataFrame(odd, "doc_id long, text string, source string"))
    clash = {"fp": F.lit("x"), "_row": F.lit(1), "_leaks": F.lit(2), "node": F.lit("n"), "text_key": F.lit(3), "_kept_id": F.lit(4), "_n": F.lit(5), "_source": F.lit("y"), "score": F.lit(None).cast("double"), "component": F.col("doc_id"), "shard": F.lit(6)}
    docs = materialize(docs.withColumns(clash), "test-hard").orderBy("doc_id", "text")
    counted = lambda df: {(r["doc_id"], r["text"], r["source"]): r["n"] for r in df.groupBy("doc_id", "text", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    given = counted(docs)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = materialize(stage(spark, docs, SF), f"test-hard-{name}")
        assert out.columns == docs.columns and out.where("fp <> 'x' OR _n <> 5 OR shard <> 6 OR NOT component <=> doc_id").count() == 0
        got = counted(out)
        assert set(got) <= set(given) and (name == "source_mix" or all(got[k] <= given[k] for k in got))
        if name == "near_dedup":
            blank = [k for k in got if not (k[1] or "").split()]
            assert [k[0] for k in blank] == [900] and got[blank[0]] == 1
            assert {k[0] for k in got if k[1] and k[1].startswith("plain0")} == {903}  # of all near copies the one with the smallest id
            assert sum(n for k, n in got.items() if k[0] == 905) == 2 and (907 in {k[0] for k in got})
        if name == "no_benchmark":
            assert all(got.get(k) == n for k, n in given.items() if not (k[1] or "").split())
    tokens = corpus_pipeline.token_output(spark, docs, SF)
    assert tokens.count() == docs.count() and tokens.where("n_tokens = 1").count() == 3
