"""Language identification: edge cases."""

from docweave.llm import kneser_ney

SCHEMA = "doc_id long, text string, lang string, score string, n int"


def run(spark, *rows):
    return kneser_ney.language_report(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()


def test_one_letter_texts(spark):
    rows = run(spark, (1, "a", "z"), (2, "a", "z"), (3, "b", "y"))
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id != 3} == {1: "z", 2: "z"}


def test_what_has_no_letter_is_undetermined(spark):
    texts = ["²", "½ ①", "Ⅷ", "12 _ 34", "", " ", None, "🙂"]
    rows = run(spark, *[(i, t, "z") for i, t in enumerate(texts)], (100, "abc abd", "z"), (101, "xyz xyw", "y"))
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id < 100)
        if r.doc_id < 100:
            assert r.score == 0 and r.cross_entropy is None and r.rejected


def test_repeated_rows_nulls_ties_and_long_texts(spark):
    rows = run(spark, (None, "abc abd", "z"), (7, "abc abd", "z"), (7, "abc abd", "z"), (8, "xyz xyw", None), (9, "abc " * 300_000, "z"), (10, "xyz xyw", "y"), (11, "q", None))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert len(rows) == 7 and by[7][0] == by[7][1] == by[None][0] and by[7][0][0] == by[9][0][0] == "z"
    assert by[11][0] == ("y", 0.5) or by[11][0][0] in "yz"
    assert run(spark) == []


def test_what_is_unlike_all_languages_is_rejected(spark):
    own = [(i, "the cat and the dog went to the sea " * 3, "en") for i in range(20)] + [(100 + i, "der hund und die katze gehen zum meer " * 3, "de") for i in range(20)]
    rows = {r.doc_id: r for r in run(spark, *own, (500, "qxzj wvkq jjxq zzqk", None))}
    assert rows[500].rejected and not any(rows[i].rejected for i, *_ in own)
