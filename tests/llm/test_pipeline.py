"""The pipeline's stages against brute force on the smallest tables, and on odd rows."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from storyloom.llm import quality as q
from storyloom.llm import queries

from .test_operators import ODD_TEXTS, check_packing, groups_by_links, library_ids, linked, no_docs, odd_docs, shingles


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_order(kept):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mix", "pack"]
    assert all(k.columns == kept[0].columns for k in kept[1:-1])


def test_quality_keeps_what_scores(spark, sf, kept):
    good = {r.doc_id for r in queries.op8_quality(spark, sf).filter("predicted = 1").collect()}
    assert {r.doc_id for r in kept[1].collect()} == good


def test_one_document_of_each_group(kept):
    sets = {r.doc_id: shingles(r.text, 5) for r in kept[1].collect()}
    place = groups_by_links(sets, linked(sets, 80))
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(set(place.values()))


def test_secrets_only_change_secrets(kept):
    import re

    before, after = ({r.doc_id: r for r in k.collect()} for k in kept[2:4])
    for i, r in before.items():
        assert after[i].text == re.sub(r'(?i)(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", r.text) and after[i].n_chars == len(after[i].text)


def test_mix_copies_whole_rows(kept):
    whole = {tuple(r) for r in kept[3].collect()}
    assert all(tuple(r) in whole for r in kept[4].collect()) and kept[4].count() > 0


def test_pack_holds_every_copy(kept):
    docs = [(r.doc_id, r.text) for r in kept[4].collect()]
    check_packing(docs, kept[5].collect())
    for r in kept[5].collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


def test_run(spark, sf, kept):
    n = defaultdict(int)
    for r in pipeline.run(spark, sf).collect():
        n[r.doc_id] += r.length
    want = defaultdict(int)
    for r in kept[5].collect():
        want[r.doc_id] += r.length
    assert n == want


def through(spark, docs, sf, path):
    """The rows of docs after each stage, each reading what the one before wrote."""
    out = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, out[-1], sf).write.parquet(f"{path}/{name}")
        out.append(spark.read.parquet(f"{path}/{name}"))
    return out


def test_odd_rows(spark, sf, tmp_path):
    docs = odd_docs(spark).withColumn("score", F.lit("x")).withColumn("row", F.lit(3)).withColumn("doc", F.lit("y"))
    quality, near, clean, mixed, packed = through(spark, docs, sf, tmp_path)[1:]
    assert all(d.columns == docs.columns for d in (quality, near, clean, mixed))
    scored = {(r.doc_id, r.text): r.score for r in q.score(odd_docs(spark), queries.quality_model(spark, sf, docs), out="score").collect()}
    want = Counter((r.doc_id, r.text) for r in docs.collect() if scored[r.doc_id, r.text] >= queries.KEEP)
    assert Counter((r.doc_id, r.text) for r in quality.collect()) == want and want
    rows = near.collect()
    assert len({(r.doc_id, r.text) for r in rows}) == len(rows)
    kept = {(r.doc_id, r.text) for r in rows}
    copies = [k for k in want if k[1] and shingles(k[1], 5) == shingles(ODD_TEXTS[5], 5)]
    first = min(copies, key=lambda k: (k[0] is None, k[0] or 0), default=None)
    assert {k for k in want if k not in copies} | ({first} if first else set()) == kept
    assert sorted(map(str, clean.drop("n_chars").collect())) == sorted(map(str, near.drop("n_chars").collect()))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean.collect())
    whole = {str(r) for r in clean.collect()}
    assert all(str(r) in whole for r in mixed.collect())
    pieces = Counter()
    for r in packed.collect():
        pieces[r.doc_id] += r.length
    tokens = Counter()
    for r, ids in zip(mixed.collect(), library_ids([r.text for r in mixed.collect()]), strict=True):
        tokens[r.doc_id] += len(ids) + 1
    assert pieces == tokens


def test_rows_that_share_an_id_and_ties(spark, sf):
    text, other = "one two three four five six seven", "an other text of quite some other words"
    rows = [(5, text, "b"), (5, other, "a"), (2, text + " eight", "c"), (5, text, "a"), (None, other, "z"), (None, "lone", "q"), (None, "lone", "p"), (7, None, "n"), (7, None, "m"), (8, "", "e")]
    got = pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), sf).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, text, "a"), (5, other, "a"), (2, text + " eight", "c"), (None, "lone", "p"), (7, None, "m"), (8, "", "e")], key=str)


def test_an_empty_table(spark, sf, tmp_path):
    for docs in through(spark, no_docs(spark), sf, tmp_path)[1:]:
        assert docs.count() == 0
