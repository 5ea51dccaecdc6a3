"""The pipeline's stages on a small corpus with planted cases."""

import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from gridloom.llm.bpe import load_ranks


def test_stages(spark, tmp_path):
    r = random.Random(8)
    syl = ["ta", "re", "mi", "so", "lun", "ker", "vo", "shan"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    clean = {i: text(r.randint(40, 120)) for i in range(60)}
    junk = {200 + i: " ".join(f"{word().upper()}!!%%% ###" for _ in range(40)) for i in range(40)}
    short = {300: "too short", 301: "", 302: None}
    copies = {400 + i: clean[i] for i in range(10)}
    near = {500 + i: clean[20 + i] + " " + word() for i in range(10)}
    passage = text(40)
    dirty = {600: text(60) + " " + passage + " " + text(30)}
    private = {700: text(50) + " mail ann@mail.example.com or +1 (243) 555-5526 now. " + text(20)}
    every = clean | junk | short | copies | near | dirty | private
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in every.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(40)] + [(200 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    sf, now = str(tmp_path), docs
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(str(tmp_path / f"{k}"))
        now = spark.read.parquet(str(tmp_path / f"{k}"))
        left.append({x["doc_id"] for x in now.select("doc_id").collect()})
        if k < 4:
            assert now.columns == docs.columns
    good = set(every) - set(junk) - set(short)
    assert left[0] == good
    for a, b in [(400 + i, i) for i in range(10)] + [(500 + i, 20 + i) for i in range(10)]:
        assert len({a, b} & left[1]) == 1
    assert len(left[1]) == len(good) - 20
    assert left[2] == left[1] - {600} and left[3] == left[4] == left[2]
    redacted = spark.read.parquet(str(tmp_path / "3")).where("doc_id = 700").first()
    assert "mail <EMAIL> or <PHONE> now" in redacted["text"] and redacted["n_chars"] == len(redacted["text"])
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert all(enc.decode(np.frombuffer(x["ids"], "<u4").tolist()) == texts[x["doc_id"]] for x in now.collect())


def test_tokens_are_decoded(spark):
    texts = {1: "Some text, é 漢字.", 2: "", 3: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x for x in corpus_pipeline.tokens(spark, docs, "").collect()}
    assert {i: bytes(x["decoded"]).decode() for i, x in got.items()} == {i: t or "" for i, t in texts.items()}
    assert all(len(x["ids"]) == 4 * x["n_tokens"] for x in got.values())


def test_items_without_an_id_count(spark, tmp_path):
    """The registered query against its SQL, and the stage, on a benchmark with null ids."""
    import duckdb

    from gridloom.llm import queries

    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"a b {passage} c"), (2, "only clean words"), (3, "short item, see q1 Q2"), (4, f"{passage} x {passage[:-1]}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(None, passage), (None, "q1 q2"), (7, passage), (8, None), (None, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = queries.op5_decontamination(spark, str(tmp_path)).collect()
    assert sorted(tuple(x) for x in got) == sorted(con.execute(queries.OP5_SQL).fetchall())
    kept = corpus_pipeline.without_benchmark(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert [x["doc_id"] for x in kept.collect()] == [2]


def test_stages_on_nulls_repeated_rows_long_texts_and_clashing_names(spark, tmp_path):
    r = random.Random(4)
    text = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n))
    one, long, passage = text(40), text(60_000), text(30)
    names = ["k", "y", "h", "x", "quality", "row", "own", "verdict", "t", "name", "item"]
    rows = [(1, one, "en", "s", 7)] * 3 + [(None, one, None, None, None), (2, text(50), None, "s", 0), (3, None, "en", "s", 5), (3, "", "en", None, 0), (None, None, None, None, None), (4, long, "en", "s", 1)]
    rows += [(5, passage + " " + text(30), "en", "s", 1), (5, "too short", "en", "s", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names)
    spark.createDataFrame([(*x, *range(len(names))) for x in rows], kinds).repartition(3).write.parquet(str(tmp_path / "in"))
    docs, sf = spark.read.parquet(str(tmp_path / "in")), str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (1, passage), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def texts(df):
        assert df.columns == docs.columns
        return sorted((x["text"] for x in df.collect()), key=repr)

    every = [x[1] for x in rows]
    long_enough = [t for t in every if t and len(t.split()) >= 10]
    assert texts(corpus_pipeline.keep_quality(spark, docs, sf)) == sorted(long_enough, key=repr)
    assert texts(corpus_pipeline.one_of_each_group(spark, docs, sf)) == sorted([one] + [t for t in every if t != one], key=repr)
    assert texts(corpus_pipeline.without_benchmark(spark, docs, sf)) == sorted([t for t in every if not (t or "").startswith(passage)], key=repr)
    redacted = corpus_pipeline.without_personal_data(spark, docs, sf)
    assert texts(redacted) == sorted(every, key=repr) and all(x["n_chars"] == len(x["text"]) for x in redacted.where("text is not null").collect())
    tokens = corpus_pipeline.tokens(spark, docs, sf).collect()
    assert sorted(((x["doc_id"], bytes(x["decoded"]).decode()) for x in tokens), key=repr) == sorted(((x[0], x[1] or "") for x in rows), key=repr)


def test_empty_tables(spark, tmp_path):
    for name, kinds in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kinds).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and got.count() == 0
