import pytest

from sparkreel.llm import decontam

ITEM = "If Anna has 12 apples and gives 5 of them to Bob, then 12 minus 5 apples weigh 3 kg in the end."
AGAIN = "Intro. If Clara has 40 apples and gives 9 of them to Dora, then 40 minus 9 apples weigh 7 lbs in the end. Outro."
WRONG = "If Clara has 40 apples and gives 9 of them to Dora, then 41 minus 8 apples weigh 7 lbs in the end."
SCHEMA = "doc_id long, text string, item_id string"


def found(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.reparameterised for r in decontam.matches(spark.createDataFrame(docs, SCHEMA), bench, **options).collect()}


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_copies_and_reparameterised_questions(spark, most):
    docs = [(1, ITEM, ""), (2, AGAIN, ""), (3, WRONG, ""), (4, "Nothing of the kind is said here, or anywhere else in it.", ""), (5, None, ""), (6, "", ""), (None, ITEM.upper().lower(), ""), (1, ITEM, "")]
    got = found(spark, docs, [(7, ITEM), (8, None), (9, "too short"), (7, ITEM)], most=most)
    assert got[1, 7] is False and got[2, 7] is True and got[None, 7] is False
    assert (3, 7) not in got or got[3, 7]
    assert not {k for k in got if k[0] in (4, 5, 6)}


def test_inconsistent_slots_are_no_match(spark):
    item = "take 3 and add 3 to the sum"
    docs = [(1, "take 8 and add 8 to the sum", ""), (2, "take 8 and add 9 to the sum", ""), (3, "take 3 and add 3 to the sum", "")]
    assert found(spark, docs, [(1, item)]) == {(1, 1): True, (3, 1): False}


def test_short_items_count_whole(spark):
    assert found(spark, [(1, "well the quick brown fox ran", ""), (2, "the quick red fox", "")], [(5, "The quick, brown FOX")]) == {(1, 5): False}


def test_decontaminate_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (2, "clean text", None)], SCHEMA)
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    out = decontam.decontaminate(docs, bench)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [2]
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 2
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_windows_of_mostly_numbers_match_their_own_values_only(spark, most):
    item = "12 + 7 = 19, 8 x 4 = 32, 90 / 3 = 30, 15 - 6 = 9"
    docs = [(1, f"Some words. {item} More words.", ""), (2, "13 + 7 = 20, 8 x 5 = 40, 90 / 2 = 45, 15 - 7 = 8", "")]
    assert found(spark, docs, [(1, item)], most=most) == {(1, 1): False}


ANNA = "Anna has 12 apples. Bob gives her 5 apples. Anna eats 3 apples. Bob buys 7 apples."


def test_names_that_begin_sentences_and_other_letter_case(spark):
    clara = "Clara has 40 apples. David gives her 6 apples. Clara eats 2 apples. David buys 9 apples."
    mixed = "Clara has 40 apples. David gives her 6 apples. David eats 2 apples. Clara buys 9 apples."
    docs = [(1, clara, ""), (2, f"so it goes: {ANNA.upper()}", ""), (3, ANNA.lower(), ""), (4, clara.lower(), ""), (5, mixed, "")]
    got = found(spark, docs, [(1, ANNA)])
    assert got == {(1, 1): True, (2, 1): False, (3, 1): False}


def test_numbers_of_any_shape_are_one_placeholder(spark):
    item = "A car costs 950 dollars and a tax of 40 dollars in most of the states."
    docs = [(1, item.replace("950", "1,250").replace("40", "7.5"), ""), (2, item.replace("950", "12,345,678.25"), ""), (3, item.replace("dollars and", "in"), "")]
    got = found(spark, docs, [(1, item)])
    assert got[1, 1] is True and got[2, 1] is True
    assert found(spark, [(1, "It costs 1,250 in all and 7.5 of it is the yearly tax", "")], [(1, "it costs 1250 in all and 7.5 of it is the yearly tax")]) == {(1, 1): False}


def test_items_of_any_length_count_with_their_own_values(spark):
    items = [(1, "photosynthesis equation"), (2, "What is 7 + 5?"), (3, "Ypsilon"), (4, "?!"), (5, "one two three four five six seven")]
    docs = [(1, "The photosynthesis equation, that is.", ""), (2, "Well, what is 7 + 5? Twelve.", ""), (3, "Well, what is 8 + 6? Fourteen.", ""), (4, "YPSILON", ""), (5, "one two three four five six seven eight", ""), (6, "photosynthesis of equation", "")]
    assert found(spark, docs, items) == {(1, 1): False, (2, 2): False, (4, 3): False, (5, 5): False}


def test_one_window_of_many_says_too_little_with_other_values(spark):
    item = "the train leaves at 9 and comes back at 12 with all of the people who had gone away on it before"
    docs = [(1, "the train leaves at 8 and comes back into quite another story that nobody has ever told anyone", ""), (2, "the train leaves at 9 and comes back into quite another story", ""), (3, item.replace("9", "8"), "")]
    assert found(spark, docs, [(1, item)]) == {(2, 1): False, (3, 1): True}


def test_long_text_clashing_columns_and_string_ids(spark):
    docs = spark.createDataFrame([("a", "filler words " * 60_000 + ITEM, 1, 2, 3), ("b", "clean", 1, 2, 3)], "doc_id string, text string, h int, once int, t int")
    bench = spark.createDataFrame([("q", ITEM)], "item_id string, text string")
    out = decontam.decontaminate(docs, bench)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == ["b"]
    assert [(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()] == [("a", "q")]


def test_rows_of_one_doc_id_or_none_are_told_apart(spark):
    item = "If Anna has 12 apples and gives 5 of them to Bob how many apples does she keep"
    rows = [(1, f"So. {item}? Yes."), (1, "A clean text of the same number."), (None, item), (None, "Another clean text."), (2, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _metadata int")
    benchmark = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert sorted(r["_metadata"] for r in decontam.decontaminate(docs, benchmark).collect()) == [1, 3, 4]
    assert sorted(((r.doc_id, r.item_id) for r in decontam.matches(docs, benchmark).collect()), key=str) == [(1, 9), (None, 9)]
    assert decontam.decontaminate(docs, benchmark.limit(0)).count() == len(rows)
