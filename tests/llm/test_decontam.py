import numpy as np
import pytest

from skylattice.llm import decontam
from tests.llm.cases import DOCS, docs

ITEM = "If Alice has 12 apples and gives 5 apples to Bob then how many apples does Alice keep after Bob eats 2 apples?"
PROSE = "there was nothing of the kind in any of the books that we had read before the winter came over the hills"


def _found(spark, texts, items=((1, ITEM),)):
    benchmark = spark.createDataFrame(list(items), "item_id long, text string")
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return {r["doc_id"]: r for r in decontam.contaminated(docs(spark, rows), benchmark).collect()}


def test_template():
    tokens, slots = decontam.template("Dr. Smith bought 3 kg of Rice in 1,234.5 days. The Élan")
    assert tokens == ["dr", "smith", "bought", "<number>", "<unit>", "of", "<name>", "in", "<number>", "<unit>", "the", "<name>"]
    assert slots[3:7] == ["3", "kg", None, "rice"] and slots[8] == "1,234.5"


def test_copies_and_new_parameters(spark):
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "30")
    got = _found(spark, [f"{PROSE}. {ITEM} {PROSE}", other, PROSE, ITEM.upper(), None, ITEM.replace("apples", "pears")])
    assert set(got) >= {0, 1} and 2 not in got and 4 not in got
    assert not got[0]["reworded"] and got[0]["max_share"] == 1.0 and got[1]["reworded"] and got[1]["item_ids"] == [1]


def test_inconsistent_slots_are_no_match(spark):
    once = ITEM.replace("12 apples", "12 pears")
    mixed = "If Carol has 1 apples and gives 2 apples to Carol then how many apples does Erin keep after Frank eats 9 apples?"
    got = _found(spark, [mixed])
    assert got == {}
    assert set(_found(spark, [once])) == {0}


def test_window_hashes_against_brute_force():
    texts = [f"{PROSE} {ITEM}", PROSE + " " + PROSE, f"{ITEM} Then 5km/h. Yes. No {ITEM}", "Short. Text", ""]
    got = list(decontam._rows(list(range(len(texts))), texts, [8], np.full(1, 255, np.uint8)))
    by_hash, expected = {}, set()
    for n, text in enumerate(texts):
        t = decontam._Tokens(text.encode() + b"\n")
        for i in range(len(t.starts) - 7):
            places = [k for k in range(i, i + 8) if t.either[k]]
            readings = [()] if not places else [(), tuple(places)] if len(places) == 1 else [(), tuple(places), (places[0],), tuple(places[1:])]
            for names in readings:
                kinds = [1 if k in names else int(t.kinds[k]) for k in range(i, i + 8)]
                tokens = tuple(t.value(i + k) if x < 0 else x for k, x in enumerate(kinds))
                if sum(x < 0 for x in kinds) >= decontam.MIN_LITERAL:
                    expected.add((n, i, tokens))
    for n, _, at, h, slots, places in got:
        if slots is not None:
            t = decontam._Tokens(texts[n].encode() + b"\n")
            kinds = {p: decontam._KINDS.index(s.split("=")[0]) for p, s in zip(places, slots)}
            tokens = tuple(kinds[k] if k in kinds else t.value(at + k) for k in range(8))
            by_hash.setdefault(h, set()).add(tokens)
            assert (n, at, tokens) in expected
            expected_left = (n, at, tokens)
    assert {(n, at) for n, _, at, *_ in got} == {(n, i) for n, x in enumerate(texts) for i in range(len(decontam.template(x)[0]) - 7)}
    assert len([x for x in got if x[4] is not None]) == len(expected) and expected_left
    assert all(len(x) == 1 for x in by_hash.values()) and len(set.union(*by_hash.values())) == len(by_hash)


def test_long_texts_by_pieces(monkeypatch):
    texts = [f"{PROSE}. {ITEM} " * 3, "x" * 500 + " " + ITEM, ITEM, "y" * 3000]
    every = np.full(1, 255, np.uint8)
    whole = sorted(map(repr, decontam._rows([1, 2, 3, 4], texts, [5, 8], every)))
    monkeypatch.setattr(decontam, "_BLOCK", 60)
    assert sorted(map(repr, decontam._rows([1, 2, 3, 4], texts, [5, 8], every))) == whole


def test_small_sieve_loses_nothing(spark, monkeypatch):
    texts = [f"{PROSE}. {ITEM}", PROSE, ITEM.replace("12", "13")]
    before = {k: tuple(v) for k, v in _found(spark, texts).items()}
    monkeypatch.setattr(decontam, "SIEVE_BITS", 16)
    assert {k: tuple(v) for k, v in _found(spark, texts).items()} == before


def test_names_that_start_sentences(spark):
    items = [(1, "Alice has 5 apples and 3 pears."), (2, "Tom ran 5km in 20 minutes. How far does Tom run in two hours?")]
    texts = [
        "Bob has 7 apples and 9 pears.", f"{PROSE}. Bob has 7 apples and 9 pears. {PROSE}", "Nobody had apples and pears at all.",
        "Jane ran 8 km in 35 minutes. How far does Jane run in three hours?", "When Jane ran 9km in 7 min, how far does Jane run in 12 hours?",
    ]
    got = {k: r["item_ids"] for k, r in _found(spark, texts, items).items()}
    assert got == {0: [1], 1: [1], 3: [2], 4: [2]}


def test_units_and_signs():
    assert decontam.template("It costs $5 or €7, at 30km/h for five hours")[0] == (
        "it costs <number> or <number> at <number> <unit> <unit> for <number> <unit>".split()
    )


def test_many_items_of_one_template(spark):
    item = lambda n, who: f"If {who} has {n} apples and gives {n + 1} apples to Bob then how many apples does {who} keep?"
    items = [(i, item(i + 3, ("Alice", "Carla")[i % 2])) for i in range(40)] + [(99, "An item of its own that nothing else in these texts is like at all.")]
    got = _found(spark, [item(7, "Zoe"), item(4, "Carla"), PROSE], items)
    assert set(got) == {0, 1} and got[0]["item_ids"] == got[1]["item_ids"] == list(range(40))
    assert got[0]["reworded"] and not got[1]["reworded"]


def test_short_items_and_awkward_rows(spark):
    items = [(1, ITEM), (2, "red green blue yellow mauve"), (3, "too short"), (None, PROSE), (4, None), (5, "")]
    got = _found(spark, ["so red green blue yellow mauve it is", PROSE, "too short", ""], items)
    assert set(got) == {0} and got[0]["item_ids"] == [2]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.contaminated(docs(spark), benchmark).collect() == []
    assert decontam.contaminated(docs(spark, []), benchmark).collect() == []
    assert decontam.contaminated(docs(spark), benchmark.limit(0)).collect() == []


def test_clean(spark):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = DOCS + [(50, ITEM, None, None, None)]
    out = decontam.clean(docs(spark, rows), benchmark)
    assert out.count() == len(DOCS) and out.columns == docs(spark).columns


@pytest.mark.parametrize("text", ["", " ", "A", "1", "ß" * 9, "a." * 20])
def test_any_text(text):
    decontam.template(text)


def test_numbers_that_repeat_by_chance(spark):
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dave")
    equal = other.replace("12 apples", "7 apples").replace("5 apples", "7 apples").replace("2 apples", "7 apples")
    twice = ITEM.replace("12 apples", "5 apples")
    assert set(_found(spark, [equal])) == {0}
    assert set(_found(spark, [other], [(1, twice)])) == {0}
    one_name_off = other.replace("does Carol", "does Erin")
    assert set(_found(spark, [one_name_off])) == {0}


def test_passages_and_insertions(spark):
    words = [f"{a}{b}" for a in "bcdfghklmnprstvz" for b in ("ara", "eli", "omo", "uni", "isa", "ote", "alu")]
    long = " ".join(words)
    assert set(_found(spark, [f"{PROSE} {' '.join(words[40:55])} {PROSE}", " ".join(words[40:50])], [(1, long)])) == {0}
    apart = " ".join(" ".join(words[i : i + 11]) + " however" for i in range(0, 112, 14))
    assert set(_found(spark, [apart], [(1, long)])) == {0}


def test_items_short_of_literals(spark):
    items = [(1, "What is 12 times 30?"), (2, "Add 1 2 3 4 5 6 7 8 9 10 11 then 12 13 14 15 16 17.")]
    texts = [f"{PROSE}. {items[0][1]} {PROSE}", "What is 14 times 30?", f"{PROSE}. {items[1][1]}", items[1][1].replace("1", "3")]
    got = _found(spark, texts, items)
    assert {k: r["item_ids"] for k, r in got.items()} == {0: [1], 2: [2]} and not got[0]["reworded"] and not got[2]["reworded"]
