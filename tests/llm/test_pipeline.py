"""The pipeline's stages against the operators' brute-force rules on small documents."""

from __future__ import annotations

from array import array
from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_native import brute_hits, brute_lines
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_each_stage_on_what_its_predecessor_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if number < 4:
            assert docs.columns == columns
            after = {r.doc_id: r for r in docs.collect()}
            assert docs.count() == len(after)
        if number == 0:
            assert 0 < len(after) < len(before)
            assert all(after[i] == before[i] for i in after)
        if number == 1:
            expected = {r[0]: r[1] for r in brute_lines([(i, r.text) for i, r in before.items()])}
            assert {i: r.text for i, r in after.items()} == expected
            assert all(r.n_chars == len(r.text) for r in after.values())
        if number == 2:
            fps = {i: brute_fingerprint(r.text) for i, r in before.items()}
            assert set(after) == set(brute_components(fps).values())
        if number == 3:
            assert set(after) == {i for i, r in before.items() if not brute_hits(r.text, items)[1]}
        if number < 4:
            before = after
    found = defaultdict(list)
    for r in docs.collect():
        found[r.doc_id].append((r.start, list(array("I", bytes(r.ids)))))
    assert set(found) == set(before)
    for own, pieces in found.items():
        ids = tokenizer.encode(before[own].text, add_special_tokens=False).ids
        assert [i for _, part in sorted(pieces) for i in part] == [*ids, 0]


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == [
        "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"
    ]


CLASHING = ("n_lines", "n_dropped", "_own", "_id", "_hash", "_row", "_text", "_pair", "_maybe",
            "_gone", "_block", "_w0", "text_hash", "component_id", "kept", "surprise", "items", "n_hit")


def odd_documents(spark):
    """Rows of the table, and NULLs in every column, empty and repeated texts and ids, a long text."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    some = table.limit(60).collect()
    prose = max((r.text for r in some if r.lang == "en"), key=len)
    odd = [(None, None, None, None, None), (9001, None, "en", "x", 0), (9002, "", None, "x", 0),
           (9003, prose, "en", None, 1), (9003, prose, "en", None, 1), (None, prose, "en", "x", 1),
           (9004, " \n\n ", "en", "x", 5), (9005, (prose + "\n") * 40, "en", "x", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kinds = {f.name: f.dataType for f in table.schema.fields}
    rows = spark.createDataFrame(odd, schema).select(*[F.col(c).cast(kinds[c]) for c in table.columns])
    docs = table.unionByName(rows)
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    return docs


def test_stages_keep_columns_and_bear_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        found = spark.read.parquet(str(tmp_path / name))
        if number == 4:
            assert {r.doc_id for r in found.collect()} == {r.doc_id for r in before}
            break
        assert found.columns == docs.columns
        after = found.collect()
        own = {r.doc_id for r in before}
        assert {r.doc_id for r in after} <= own
        for r in after:
            assert all(r[c] == f"{c}{'?' if r.doc_id is None else r.doc_id}" for c in CLASHING)
        ids = [r.doc_id for r in after]
        if number == 0:
            assert not {9001, 9002, 9004} & set(ids)
        if number == 1:
            assert len(after) == len(before) and None not in [r.text for r in after]
        docs = found


def test_stages_of_no_rows_and_of_texts_alone(spark):
    """An empty table, and one whose rows have nothing to be judged by, through each stage alone."""
    docs = odd_documents(spark)
    blank = docs.where("doc_id IN (9001, 9002, 9004) OR doc_id IS NULL AND text IS NULL")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        nothing = stage(spark, docs.limit(0), SMALL)
        assert nothing.collect() == [] and (number == 4 or nothing.columns == docs.columns)
        left = stage(spark, blank, SMALL).collect()
        expected = [0, 4, 1, 4, 4][number]
        assert len(left) == expected, number
