"""The pipeline's stages over the smallest tables: what each rejects and keeps, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """(name, input, output) of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        after.count()
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_columns_and_whole_rows(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns
        assert after.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    assert 0 < steps[3][2].count() < steps[0][1].count()


def test_toxicity_rejects_few(steps):
    _, before, after = steps[0]
    assert after.count() > 0.7 * before.count()


def test_no_window_is_left(steps, spark):
    text = F.regexp_replace(F.lower("text"), "[^a-z0-9\\x{80}-\\x{10FFFF}]+", " ")
    items = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select(F.trim(text)).collect()]
    left = [r[0] for r in steps[3][2].select(text).collect()]
    windows = {" ".join(w[i : i + 10]) for w in (x.split() for x in items) for i in range(max(1, len(w) - 9))}
    assert not any(" ".join(w[i : i + 10]) in windows for w in (x.split() for x in left) for i in range(len(w) - 9))


def test_one_of_many_exact_copies_is_left(spark):
    copy = "\n".join(f"line {i} of a text that has many copies" for i in range(6))
    rows = [(i, copy) for i in range(25)] + [(100 + i, f"footer of all\nown text {i} and nothing but {i}") for i in range(12)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in [*rows, (200, "footer of all")]], "doc_id long, text string, n_chars long")
    lines = corpus_pipeline.line_dedup(spark, docs, SF).cache()
    got = {r.doc_id: r for r in lines.collect()}
    assert set(got) == {i for i, _ in rows} | {200} and all(got[i].text == copy and got[i].n_chars == len(copy) for i in range(25))
    assert got[103].text == "own text 3 and nothing but 3" and (got[200].text, got[200].n_chars) == ("", 0)
    left = {r.doc_id: r.text for r in corpus_pipeline.jaccard_join(spark, lines, SF).collect()}
    assert left[0] == copy and not set(range(1, 25)) & set(left)


def test_mix_comes_from_its_input(steps):
    _, before, after = steps[4]
    assert after.where("words <= 0 OR words > size").count() == 0
    longest = after.agg(F.max("size")).first()[0]
    assert after.groupBy("source").agg(F.sum("words").alias("w"), F.max("target").alias("t")).where(f"abs(w - t) > {longest}").count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, n_dropped int, n_lines int, row string, document string, words int, hits string, id long, component_id long"


def odd_rows():
    own = (None, "s", 9, 0.7, 99, 98, "row", "doc", 97, "hits", 96, 95)
    long = " ".join(f"w{i % 7919}x{i % 31}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a text without an id, and with some words"), (4, "the same text of seven words twice"), (4, "the same text of seven words twice"), (4, "the same id but another text of words"), (5, long), (6, long + " end"), (7, "Ä ö ü"), (8, "the same text of seven words twice")]
    return [(*r, *own) for r in rows]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]])
def test_odd_rows_and_clashing_columns(spark, stage):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r[5:] == tuple(odd_rows()[0][5:]) for r in got)
    ids = sorted((r.doc_id or -1) for r in got)
    if stage is corpus_pipeline.jaccard_join:
        assert ids == [-1, 1, 2, 3, 4, 4, 5, 7]  # 6 is like 5, 8 like a row of 4, which has two texts
        assert {r.text for r in got if r.doc_id == 4} == {r[1] for r in odd_rows() if r[0] == 4}
        assert sorted(map(str, stage(spark, docs.repartition(2), SF).collect())) == sorted(map(str, got))
    else:
        assert ids == sorted((r[0] or -1) for r in odd_rows())
        assert sum(r.text is None for r in got) == 1
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_mixing_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    out = corpus_pipeline.mixing(spark, docs, SF)
    assert out.where("words <= 0 OR words > size").count() == 0 and out.agg(F.sum("words")).first()[0] == 3 * sum(len((r[1] or "").split()) for r in odd_rows()) // 2
    assert corpus_pipeline.mixing(spark, docs.limit(0), SF).count() == 0


def test_a_doc_id_with_several_texts(spark):
    """Texts of one doc_id stand for themselves: what nothing links stays, and of a component the least doc_id's text is kept."""
    text = lambda a: " ".join(f"{a}{i}" for i in range(40))
    rows = [(9, text("a")), (9, text("b")), (9, text("b")), (3, text("b") + " more"), (12, text("a") + " more"), (20, text("c")), (20, text("c") + " more"), (21, text("d")), (9, None), (9, None), (9, "")]
    got = corpus_pipeline.jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF).collect()
    left = sorted((r.doc_id, (r.text or "")[:2], r.text is None) for r in got)
    assert left == [(3, "b0", False), (9, "", False), (9, "", True), (9, "a0", False), (20, "c0", False), (21, "d0", False)]
