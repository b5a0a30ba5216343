import corpus_pipeline
import numpy as np

from glyphledger.llm.common import keep_rows
from glyphledger.llm.exact_dedup import exact_dedup
from glyphledger.llm.toxicity import _words


def test_stages_keep_and_reject(spark, tmp_path):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(["ka", "ro", "mi", "tel", "ans", "ore", "ub", "ist", "ven", "dal"], rng.integers(1, 4)))
    text = lambda n=80: " ".join(word() for _ in range(n))
    rows = [(i, text() + (" zonkhead" if i % 6 == 0 else "")) for i in range(300)]
    base = rows[1][1]
    leak = text(30)
    rows += [(301, base.replace(" ", "  ")), (302, base + " tail"), (303, text() + " " + leak + " " + text()), (304, None), (305, ""), (307, rows[2][1]), (307, rows[2][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    earlier = exact_dedup(docs)
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert earlier.count() == len(rows)  # a lazy result outlives a run
    assert len(ids) == len(set(ids))
    left = set(ids)
    assert not {i for i in range(300) if i % 6 == 0} & left
    assert {1, 301, 302} & left and len({1, 301} & left) <= 1 and 303 not in left and len({2, 307} & left) == 1 and len({304, 305} & left) == 1
    clean = {i for i in range(300) if i % 6 and i not in (1, 2)}
    assert len(clean - left) <= 3, sorted(clean - left)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    assert _words("A b") == ["a", "b"]


def test_one_row_of_a_group_stays_whatever_its_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text), (7, text + " tail"), (None, "v " + text[:150]), (None, "v " + text[:150] + " end"), (9, "other words stand here and there"), (9, "other words stand here and there")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, root int")
    left = corpus_pipeline.near(spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["7", "9", "None"] and left[0].__fields__ == docs.columns


def test_stages_take_any_columns_and_empty_tables(spark, tmp_path):
    names = ["toxicity", "score", "n_hit", "spans", "items", "n_words", "ids", "row_key", "__id", "__key", "c0", "node", "kept", "part", "fp"]
    rows = [(i, f"text {i} " + " ".join(f"w{i}x{k}" for k in range(20)), *range(len(names))) for i in range(12)] + [(None, None, *range(len(names)))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    assert sorted(map(str, (tuple(r) for r in now.collect()))) == sorted(str(r) for r in [*rows[:3], *rows[4:12], rows[-1]])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 12
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    for n in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{n}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_a_repeated_row_is_one_row_per_task(spark):
    docs = spark.createDataFrame([(None, "same")] * 500 + [(1, "a")], "doc_id long, text string").repartition(4)
    kept = docs.limit(0).select("doc_id").selectExpr("doc_id", "0L AS row_key").unionByName(docs.selectExpr("doc_id", "xxhash64(text) AS row_key"))
    out = keep_rows(docs, kept)
    assert out.count() == 2 and out.columns == docs.columns


def test_no_machine_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    import pytest

    from glyphledger.llm.common import shared_dir

    class Session:
        conf = SimpleNamespace(get=lambda key, default=None: None, set=lambda *a: None)
        sparkContext = SimpleNamespace(master="yarn")

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session())
