"""The stages on planted documents, and the whole run against the stages' plain meaning."""

import json
import random

import pytest

from plotweave.llm import pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def planted():
    rnd = random.Random(12)
    stem = ["ta", "ri", "mo", "sel", "ka", "no", "pi", "du", "lem", "fo"]
    word = lambda: "".join(rnd.choices(stem, k=rnd.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs, labels, kind = [], [], {}

    def add(text, what, toxic=0):
        i = len(docs)
        docs.append((i, text, "en", f"s{i % 3}", None if text is None else len(text)))
        labels.append((i, 1, toxic))
        kind[i] = what

    item = prose(40)
    for i in range(400):
        if i % 8 == 0:
            words = prose(60).split()
            for _ in range(6):
                words.insert(rnd.randrange(len(words)), "zug" + word())
            add(" ".join(words), "toxic", 1)
        else:
            add(prose(rnd.randint(40, 120)) + ("\nPage 12 of the printed list by hand" if i % 4 == 1 else ""), "clean")
    base = prose(150)
    for k in range(12):
        add(base if k < 6 else base + " " + word(), "copy")
    for _ in range(5):
        add(prose(30) + " " + item + " " + prose(30), "leak")
    add(None, "empty")
    add("", "empty")
    return docs, labels, kind, item


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels, kind, item = planted()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, kind


def test_stages_one_after_the_other(spark, tables, tmp_path):
    path, docs, kind = tables
    was = spark.read.parquet(f"{path}/documents.parquet")
    texts = {i: t for i, t, *_ in docs}
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, was, path)
        assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        was = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in was.collect()}
    of = lambda name, what: [i for i in kept[name] if kind[i] == what]
    all_of = lambda what: [i for i in kind if kind[i] == what]
    assert len(of("toxicity", "toxic")) <= 2 and len(of("toxicity", "clean")) >= len(all_of("clean")) - 2
    lines = kept["line_dedup"]
    assert set(lines) == set(kept["toxicity"])
    assert not any("printed list" in (r.text or "") for r in lines.values())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.values())
    assert all(r.text == (texts[i] if "\n" not in (texts[i] or "") else texts[i].split("\n")[0]) for i, r in lines.items())
    near = kept["simhash_near_dedup"]
    assert of("simhash_near_dedup", "copy") == [min(all_of("copy"))]
    assert len(of("simhash_near_dedup", "empty")) == 1
    assert set(of("simhash_near_dedup", "clean")) == set(of("line_dedup", "clean"))
    clean = kept["benchmark_decontamination"]
    assert not of("benchmark_decontamination", "leak") and set(clean) == {i for i in near if kind[i] != "leak"}
    packed = pipeline.STAGES[-1][1](spark, was, path).collect()
    assert {r.doc_id for r in packed} == set(clean)
    whole = pipeline.run(spark, path).collect()
    strip = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert strip(whole) == strip(packed)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert json.dumps(pipeline.ORACLE_SQL) == "null"


def test_empty_documents(spark, tables):
    path, *_ = tables
    none = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, path).count() == 0
