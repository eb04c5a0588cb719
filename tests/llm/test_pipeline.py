import os
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from relengine.llm.mixing import mix  # noqa: E402
from relengine.llm.queries import QUERIES, SQL  # noqa: E402

from .test_simhash import slow_components, slow_fingerprint  # noqa: E402
from .test_substring import slow  # noqa: E402
from .test_toxicity import made  # noqa: E402


def tables(spark, folder):
    texts, toxic = made(5, 300)
    rng = random.Random(1)
    passage = " ".join(f"p{rng.randrange(999)}" for _ in range(70))
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[i], "en", "copy", len(texts[i])) for i in range(20)]
    rows += [(2000 + i, f"{texts[50 + i]} {passage} end{i}", "de", "s1", 5) for i in range(15)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s0", 0), (3002, "  \n", "en", "s0", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, dict(enumerate(toxic))


def test_stages(spark, tmp_path):
    rows, toxic = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r.asDict() for r in docs.collect()]
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = {n: [r["doc_id"] for r in s] for n, s in seen.items()}
    gone = {r[0] for r in rows} - set(ids["toxicity"])
    bad = {i for i, y in toxic.items() if y} | {1000 + i for i in range(20) if toxic[i]} | {2000 + i for i in range(15) if toxic[50 + i]}
    assert len(gone ^ bad) <= 3
    kept = sorted(seen["toxicity"], key=lambda r: r["doc_id"])
    group = slow_components([slow_fingerprint(r["text"]) for r in kept])
    assert sorted(ids["simhash"]) == sorted(kept[g]["doc_id"] for g in set(group))
    want = {d: (n, gone) for d, n, gone, _ in slow([(r["doc_id"], r["text"]) for r in seen["simhash"]], 50)}
    before = {r["doc_id"]: r["text"] for r in seen["simhash"]}
    for r in seen["substring"]:
        n, gone = want[r["doc_id"]]
        assert len((r["text"] or "").split()) == n - gone and (gone or r["text"] == before[r["doc_id"]])
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert len(seen["substring"]) == len(before) and any(gone for _, gone in want.values())
    taken = {r.doc_id: r.taken for r in mix(spark, spark.read.parquet(f"{tmp_path}/substring")).collect() if r.taken}
    words = {}
    for r in seen["mix"]:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == taken
    assert sum(r["length"] for r in seen["pack"]) >= sum(words.values()) and set(ids["pack"]) == set(ids["mix"])
    assert sorted(map(str, (r.asDict()["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()))) == sorted(map(str, ids["pack"]))


CLASHING = ["_first", "_toxicity", "_null", "_cut", "_epochs", "row", "key", "_words", "_own", "score", "kept", "own", "words", "epochs", "c0", "c1", "id", "tie", "nth", "a.b", "component_id"]


def test_clashing_names(spark, tmp_path):
    """Each stage keeps all columns and their values, whatever their names."""
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id is not null")
    docs = docs.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in CLASHING])
    docs.write.parquet(f"{tmp_path}/wide")
    docs = spark.read.parquet(f"{tmp_path}/wide")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        assert docs.columns == columns
        rows = docs.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in CLASHING)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len({r["doc_id"] for r in rows})


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "pack" or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_of_one_doc_id_and_of_none(spark, tmp_path):
    """Groups, not ids, decide which rows stay, and the choice doesn't hang on the order of the rows."""
    from relengine.llm.simhash import one_of_each

    rows = [(1, "a b c d e f", "x"), (1, "q r s t u v w", "x"), (1, "a b c d e f", "w"), (None, "a b c d e f", "n"), (None, "only null here now", "n"), (None, "only null here now", "m"), (2, "q r s t u v w", "x"), (3, None, "x"), (4, "", "x")]
    got = [sorted(map(tuple, one_of_each(spark, spark.createDataFrame(r, "doc_id long, text string, more string").repartition(2)).collect()), key=str) for r in (rows, rows[::-1])]
    assert got[0] == got[1] == sorted([(1, "a b c d e f", "w"), (1, "q r s t u v w", "x"), (3, None, "x"), (None, "only null here now", "m")], key=str)


def test_all_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] and set(SQL) < set(QUERIES)
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
