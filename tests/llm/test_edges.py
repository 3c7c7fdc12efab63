"""Empty tables, missing labels, clashing names, and brute force where SQL cannot say what is right."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from relgrid.llm import decontaminate, flat, minhash, mixing, neighbours, queries, secret_scan, toxicity

from .conftest import corpus, prose

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path: str, documents: list, labels: list, benchmark: list) -> str:
    for name, rows, schema in (("documents", documents, DOCUMENTS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id string, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def everything():
    return {**queries.queries(), "pipeline": corpus_pipeline.run}


@pytest.mark.parametrize("name", sorted(everything()))
def test_empty_tables(spark, tmp_path, name):
    got = everything()[name](spark, tables(spark, str(tmp_path), [], [], []))
    assert got.count() == 0 and "doc_id" in got.columns


def test_without_labels_everything_is_scored_alike(spark, tmp_path):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in corpus()[:20]] + [(400, None, None, None, None), (None, "no id", None, "a", 5)]
    path = tables(spark, str(tmp_path), rows, [], [])
    assert {r.score for r in queries.queries()["op9_quality_classifier"](spark, path).collect()} == {0.5}
    for name in ("op3_quality_rules", "op8_toxicity"):
        assert queries.queries()[name](spark, path).count() == len(rows)


def test_names_of_ours_may_clash(spark, tmp_path):
    clash = ("__row", "__text", "__score", "spans", "base_spans", "row", "key", "copies", "h")
    rows = [(i, t, s, *range(len(clash))) for i, t, s in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in clash)).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("b", " ".join(rows[10][1].split()[:20]))], "item_id string, text string")
    for got in (minhash.keep_one(docs), decontaminate.clean(docs, bench), decontaminate.clean(docs, bench, block_words=5), neighbours.keep_good(docs, labels), mixing.mixed(docs)):
        assert got.columns == docs.columns
        assert all(tuple(r[3:]) == tuple(range(len(clash))) for r in got.collect())
    assert secret_scan.scan(docs.drop("__text"), secret_scan.fit(docs.select("doc_id", "text"))).count() == len(rows)


def test_inputs_that_are_no_scans_are_stored(spark, docs):
    """Rows of a shuffled input keep their places."""
    shuffled = docs.repartition(3)
    got = minhash.near_duplicates(shuffled, width=3, percent=85)
    want = minhash.near_duplicates(docs, width=3, percent=85)
    pick = lambda df: sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.where("doc_id is not null").collect())
    assert pick(got) == pick(want)


def test_votes_are_those_of_the_nearest(spark):
    r = np.random.default_rng(3)
    unit = lambda n: (lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))(r.standard_normal((n, 6)))
    m = neighbours.Model(np.zeros((1, 6), np.float32), unit(300), (r.random(300) < 0.5).astype(np.float32), 0.25)
    z = np.concatenate([unit(40), np.zeros((1, 6), np.float32)])
    got = neighbours.vote(z, m, 7, 4)
    for x, p in zip(z, got, strict=True):
        near = sorted(((float(x @ v), float(y)) for v, y in zip(m.vectors, m.labels, strict=True)), reverse=True)[:7]
        w = [max(s, 0) ** 4 for s, _ in near]
        assert math.isclose(p, sum(a * y for a, (_, y) in zip(w, near, strict=True)) / sum(w) if sum(w) > 1e-12 else m.share, abs_tol=1e-5)


def test_scores_do_not_depend_on_other_rows(spark, tmp_path):
    rows = [(i, prose(30, i) if i % 2 else "*** " * 20 + prose(3, i)) for i in range(40)] + [(90, None), (91, ""), (92, "a")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = neighbours.fit(docs, labels)
    whole = {r.doc_id: r.score for r in neighbours.score(docs.coalesce(1), model).collect()}
    alone = {r.doc_id: r.score for r in neighbours.score(docs.repartition(20), model).collect()}
    assert whole.keys() == alone.keys() and all(abs(whole[k] - alone[k]) < 1e-5 for k in whole)


def test_grades_follow_the_thresholds(spark, tmp_path):
    """Severity as the ordinal model says, term by term."""
    rows = [(i, prose(40, i) + (" idiot scum trash" * (1 + i % 3) if i % 4 == 0 else "")) for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.grade(docs, m).collect()}
    for i, text in rows:
        _, _, buf, off = next(flat.chunks(pa.array([(text or "").encode()], pa.binary())))
        seen: dict = {}
        for t in toxicity.terms(buf, off)[1].tolist():
            if m.column[t] >= 0:
                seen[m.column[t]] = seen.get(m.column[t], 0) + 1
        total = sum(math.log1p(n) * m.weights[c] for c, n in seen.items())
        above = [1 - 1 / (1 + math.exp(-(t - total))) for t in m.thresholds]
        p = [1 - above[0], *(a - b for a, b in zip(above, above[1:])), above[-1]]
        assert math.isclose(got[i].score, above[0], abs_tol=1e-6) and math.isclose(got[i].expected_severity, sum(above), abs_tol=1e-6)
        assert got[i].grade == int(np.argmax(p)) and got[i].toxic == (above[0] >= 0.5)


def test_hot_ids_of_token_files_are_dealt_apart(spark, tmp_path):
    """Many rows of one id, or of none, in several tasks, and all read back in order."""
    from relgrid.llm import token_store
    from relgrid.llm.runtime import tokenizer_file

    rows = [(7 if i % 3 else None, prose(5, i)) for i in range(300)] + [(1, "first"), (9, "last")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = sorted(token_store.token_files(spark, spark.read.parquet(str(tmp_path / "d")), tokenizer_file("word_bpe_49k.json")).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.doc_id for r in got[:100]] == [None] * 100 and got[100].doc_id == 1 and got[-1].doc_id == 9
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert re.fullmatch(r"\d+", str(got[0].ids_crc32))
