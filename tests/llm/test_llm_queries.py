"""The registered queries against SQL on the smallest tables, and the pipeline against a plain version."""

import os

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as registered
import corpus_pipeline
from checks.compare import compare, connect
from dayloom.llm import line_crf, queries, secret_scan
from test_llm_decontaminate import brute as contaminated
from test_llm_jaccard_join import brute as grouped

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_all_ten_and_the_pipeline_are_registered():
    names = set(registered.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    problem, _, rows = compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
    assert problem is None and rows > 0


def test_pipeline_against_a_plain_version(spark):
    db = duckdb.connect()
    docs = db.execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = db.execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    field = line_crf.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    kept = [(i, t) for i, t in docs if field.scores([t.encode()])[0] >= 0.7]
    first = {key for key, lowest, _ in grouped(kept) if key == lowest}
    kept = [(i, t) for i, t in kept if i in first and not contaminated(t, items)[4]]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: library.encode(secret_scan.redacted(t)) for i, t in kept}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in rows} == want and len(rows) == len(want)
    assert all(r.lossless for r in rows)


def test_secret_stage_against_written_out_texts(spark):
    prose = "A line of plain words.\n" * 2000
    want = {
        'Run:\n```\nk = "Zx9!qq-Lm2$Tt7"\ndb_pwd = k\n```\nend': 'Run:\n```\nk = "[secret]"\ndb_pwd = k\n```\nend',
        'a = "p!4$5^7"\nb = a + "x?9#"\nclient_secret: str = b\n': 'a = "[secret]"\nb = a + "[secret]"\nclient_secret: str = b\n',
        "a ` here\ndb_pwd = 'qwe!rty98765'\nand ` there": "a ` here\ndb_pwd = '[secret]'\nand ` there",
        prose + "passphrase = 'qwe!rty98765'": prose + "passphrase = '[secret]'",
        "```\nx = 1\n```\n" + prose: "```\nx = 1\n```\n" + prose,
    }
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(want)], "doc_id bigint, text string, n_chars int")
    rows = sorted(dict(corpus_pipeline.STAGES)["secret scans"](spark, docs, SF).collect())
    assert [(r.text, r.n_chars) for r in rows] == [(t, len(t)) for t in want.values()]


def test_stages_keep_all_columns(spark):
    docs = spark.createDataFrame(
        [(i, t, "en", 5, "s", 0.5) for i, t in enumerate(["One line here.", None, "", "token = abcdefgh1"])],
        "doc_id bigint, text string, lang string, n_chars int, spans string, score double",
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4
