import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import quality, registry

from . import cases


def test_every_operator_is_registered():
    names = set(registry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert set(registry.oracle_sql()) <= names


def test_pipeline_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    state, kept = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, data)
        assert state.columns == docs.columns
        rows = {r.doc_id: r.text for r in state.collect()}
        if name == "quality rules":
            verdict = {r.doc_id: r.kept for r in quality.verdicts(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
            assert set(rows) == {k for k, v in verdict.items() if v}
        elif name == "n-gram Jaccard join":
            assert set(rows) == {c for _, c in cases.components(list(kept.items())).values()}
        else:
            assert set(rows) == set(kept) and not cases.later_holders(sorted(rows.items()))
            assert all(rows[k] == kept[k] for k in set(kept) - cases.later_holders(sorted(kept.items())) if len(rows[k]) == len(kept[k]))
        kept = rows
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in kept.items()}
    out = corpus_pipeline.run(spark, data).collect()
    found = {}
    for r in out:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == lengths


def test_stages_on_odd_tables(spark, data):
    """Null ids and texts, repeated rows, a long text, clashing columns, and no rows at all."""
    long = " ".join(f"word{k * k % 7919}" for k in range(9000))
    plain = " ".join(f"text{k * k % 997}" for k in range(120))
    rows = [(1, plain, "en", "s", 1, "x"), (1, plain, "en", "s", 1, "x"), (None, plain + " more", None, "s", 2, "y"), (3, None, "en", None, None, "z"), (4, "", "fr", "s", 0, None), (5, long, "de", "s", 3, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length string")
    for table, left in ((docs, {"1", "None", "5"}), (docs.limit(0), set())):
        state = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            state = stage(spark, state, data)
            assert state.columns == table.columns
        assert {str(r.doc_id) for r in state.collect()} == left
        pieces = corpus_pipeline.STAGES[-1][1](spark, state, data)
        assert {str(r.doc_id) for r in pieces.collect()} == left


@pytest.mark.parametrize("parts", [1, 5])
def test_texts_that_share_a_doc_id_are_not_lost(spark, parts):
    """Rows (1, A), (1, B), (2, B): A and one B stay, whatever the layout and the names of further columns."""
    a, b = (" ".join(f"{x}{k * k % 907}" for k in range(90)) for x in "ab")
    near = b.replace("b4 ", "zz ", 1)
    rows = [(1, a, "en", 1, "p", 1), (1, b, "en", 1, "q", 2), (2, b, "en", 1, "r", 3), (2, b, "en", 1, "r", 3), (3, near, "de", 1, "s", 4), (3, a + " more", "de", 1, "s", 5), (4, None, "fr", 1, "t", 6), (4, "", "fr", 1, "t", 6), (None, a, "en", 1, "u", 7), (None, a, "en", 1, "u", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, __nth string, __id int").withColumn("row", F.lit("x")).withColumn("own", F.lit(1)).withColumn("spans", F.lit(2)).repartition(parts)
    out = corpus_pipeline.STAGES[1][1](spark, docs, None)
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert left == sorted([(1, a), (1, b), (4, left[-3][1] if left[-3][0] == 4 else ""), (None, a), (None, a)], key=str)
    cut = corpus_pipeline.STAGES[2][1](spark, docs, None)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_the_smallest_doc_id_stays_when_none_comes_twice(spark):
    a = " ".join(f"a{k * k % 907}" for k in range(90))
    docs = spark.createDataFrame([(5, a, "x"), (3, a + " b", "y"), (9, a, "z"), (7, "other words in this one here", "w"), (None, a, "n")], "doc_id long, text string, __id string")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.STAGES[1][1](spark, docs, None).collect()) == ["3", "7", "None"]
