import re

import pytest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ra", "to", "mi", "ne", "sol", "ka"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(60), "en" if i % 2 else "fr", f"s{i % 3}", 0) for i in range(40)]
    near = rows[1][1].split(" ")
    near[30] = "edited"
    rows += [(50, " ".join(near), "en", "s0", 0), (51, rows[2][1], "fr", "s1", 0), (52, "123 456", "en", "s1", 0), (53, None, "en", "s1", 0)]
    rows.append((54, text(30) + ' password = "hunter2hunter2" ' + text(10), "en", "s2", 0))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}", rows


def test_stages(spark, tables, tmp_path):
    import corpus_pipeline

    sf_dir, _ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "tokens" or docs.columns == columns
    everything = set(range(40)) | {50, 51, 52, 53, 54}
    assert set(seen["language"]) == everything - {52, 53}
    assert set(seen["near_copies"]) == everything - {50, 51, 52, 53}
    assert set(seen["secrets"]) == set(seen["mixture"]) == set(seen["tokens"]) == set(seen["near_copies"])
    masked = seen["secrets"][54]
    assert "[SECRET]" in masked.text and "hunter2" not in masked.text and masked.n_chars == len(masked.text)
    assert all(seen["secrets"][i].text == seen["language"][i].text for i in range(40))
    assert all(r.n_tokens == len(r.ids) > 0 for r in seen["tokens"].values())


def test_run_and_registration(spark, tables):
    import __spark_entry__ as entry

    sf_dir, _ = tables
    assert {re.match(r"op(\d+)_", k)[1] for k in entry.queries() if re.match(r"op\d+_", k)} == set("123456789") | {"10"}
    assert entry.queries()["pipeline"](spark, sf_dir).count() == 41


def test_stages_of_an_empty_table_and_of_extra_columns(spark, tables, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    sf_dir, rows = tables
    wide = spark.read.parquet(f"{sf_dir}/documents.parquet").select("*", *[F.lit(7).alias(n) for n in ("doc", "node", "spans", "slot", "clean", "s", "kept_id")])
    for docs, expect in ((wide.where("false"), 0), (wide, 41)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{expect}-{name}")
            docs = spark.read.parquet(f"file://{tmp_path}/{expect}-{name}")
            assert name == "tokens" or docs.columns == columns
        assert docs.count() == expect


def test_the_mixed_order_reaches_the_result(spark, tmp_path):
    import corpus_pipeline
    from lectern.llm import mixing
    from pyspark.sql import functions as F

    text = F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), F.when(F.col("id") % 7 == 0, F.lit(60)).otherwise(F.lit(1)).cast("int"))
    docs = spark.range(600).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("id") % 5 % 3).cast("string")).alias("source"), F.lit(0).cast("long").alias("n_chars"))
    want = [r.doc_id for r in mixing.mix(docs).orderBy("mix_order").select("doc.doc_id").collect()]
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus_pipeline.mixture(spark, docs, "").write.option("maxRecordsPerFile", 70).parquet(f"file://{tmp_path}/mixed")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    mixed = spark.read.parquet(f"file://{tmp_path}/mixed")
    assert len(mixed.inputFiles()) > 5
    got = corpus_pipeline.tokens(spark, mixed, "").select("doc_id", "mix_order").collect()
    assert sorted(r.mix_order for r in got) == list(range(600))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.mix_order)] == want


def test_run_returns_the_mixed_order(spark, tables, monkeypatch):
    import corpus_pipeline
    from lectern.llm import mixing

    seen = []
    monkeypatch.setattr(corpus_pipeline.mixing, "mix", lambda docs, mix=mixing.mix: seen.append(mix(docs)) or seen[-1])
    rows = corpus_pipeline.run(spark, tables[0]).select("doc_id", "mix_order").collect()
    want = [r.doc_id for r in seen[0].orderBy("mix_order").select("doc.doc_id").collect()]
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.mix_order)] == want and len(want) == 41


def test_awkward_rows_and_token_ids_of_the_library(spark, tmp_path):
    """Very long, empty and repeated rows through every stage; ids as the library has them."""
    import random

    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken
    from lectern.llm import bpe
    from lectern.llm.queries import ENCODER

    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ra", "to", "mi", "ne", "sol", "ka"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    long_ = text(60_000) + ' token = "' + "aB3" * 8 + '" ' + text(10)
    rows = [(i, text(50), "en" if i % 2 else "fr", None if i % 5 == 0 else "s1", 0) for i in range(20)]
    rows += [(20, long_, "en", "s1", 0), (21, "", "en", "s1", 0), (22, " \n ", "en", "s1", 0), (None, text(40), "en", "s1", 0), (3, rows[3][1], "en", "s1", 0), (3, text(45), "en", "s2", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"file://{tmp_path}/{name}")
        last, docs = docs, spark.read.parquet(f"file://{tmp_path}/{name}")
    kept = sorted(((r.doc_id, r.text) for r in last.collect()), key=str)
    assert sorted(i for i, _ in kept if i is not None) == [*range(3), 3, 3, *range(4, 21)] and sum(i is None for i, _ in kept) == 1
    masked = dict(kept)[20]
    assert "aB3" not in masked and masked.startswith(long_[:1000]) and masked.endswith(long_[-30:])
    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(ENCODER)), special_tokens={})
    got = sorted(((r.doc_id, encoder.decode(r.ids), list(r.ids)) for r in docs.collect()), key=lambda r: str(r[:2]))
    assert [(i, t) for i, t, _ in got] == kept and all(ids == encoder.encode_ordinary(t) for _, t, ids in got)
    assert sorted(r.mix_order for r in docs.select("mix_order").collect())[0] == 0 and docs.select("mix_order").distinct().count() == len(kept)
