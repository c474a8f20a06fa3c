"""Token counts where several spaces follow each other."""

import pytest

from laurel.llm import unigram


@pytest.fixture(scope="module")
def model():
    return unigram.Unigram(*unigram.load_pieces(unigram.default_vocabulary()))


def test_no_piece_holds_a_mark_behind_another_character():
    pieces, _ = unigram.load_pieces(unigram.default_vocabulary())
    assert not [p for p, _ in pieces if unigram.MARK in p.lstrip(unigram.MARK)]


@pytest.mark.parametrize("text", ["a    b", " a", "  if x:\n        return  1", "a b", "x   ", " ", "   ", "col  \t  a      é", "a" + " " * 40 + "b"])
def test_runs_count_as_one_search_over_the_whole_text(model, text):
    assert model.count(text, whole_runs=True) == model.pieces_of(unigram.MARK + text.replace(" ", unigram.MARK))


def test_registered_query_keeps_runs(spark, tmp_path, model):
    from laurel.llm.queries import op2_token_counts

    spark.createDataFrame([(1, "a    b"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in op2_token_counts(spark, str(tmp_path)).collect()}
    assert got == {1: 3, 2: 0} and model.count("a    b") == 5
