import duckdb
import pytest
from pyspark.sql import functions as F

from skylattice.llm import chat
from skylattice.llm.queries import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "Hello there my friends.\nWhat is the time of day?"),
    (1, 1, "assistant", "> What is  the TIME of day?\nIt is noon."),
    (1, 2, "user", "On Mon, Ann wrote:\n> It is noon.\n>> What is the time of day?\nThanks a lot"),
    (1, 3, "x", "> unknown text that nobody said\nfoo"),
    (1, 4, "x", "no quote a > b"),
    (1, 5, "user", "> Thanks a lot\nok"),
    (2, 0, "u", None),
    (2, 1, "u", ">\n> \n"),
    (2, 2, "u", "> Hello there my friends."),
    (None, 1, "u", "> x"),
    (3, None, "u", "> x"),
]


CHAIN = [(1, 0, "u", "message number 0 of this long chain")] + [
    (1, i, "u", f"Ann wrote:\n> message number {i // 2} of this long chain\n\nmessage number {i} of this long chain\nthe same line each time") for i in range(1, 30)
] + [(2, i, "u", "> the same line each time\r\nthe same line each time") for i in range(4)]


def _rows(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumns({c: F.lit("?") for c in ("thread", "depth", "key", "own", "quotes", "lines", "n_linked")})


def test_threads(spark):
    got = {(r["conv_id"], r["turn"]): r for r in chat.conversations(_rows(spark, ROWS)).collect()}
    assert len(got) == len(ROWS)
    reply = {k: v["reply_to"] for k, v in got.items() if v["reply_to"] is not None}
    assert reply == {(1, 1): 0, (1, 2): 1, (1, 5): 2}
    assert [got[1, t]["depth"] for t in range(6)] == [0, 1, 2, 0, 0, 3] and [got[1, t]["thread"] for t in range(6)] == [0, 0, 0, 3, 4, 0]
    assert got[1, 2]["text"] == "Thanks a lot" and got[1, 1]["text"] == "It is noon." and got[1, 4]["text"] == "no quote a > b"
    assert got[1, 2]["n_quotes"] == 2 and got[1, 2]["n_linked"] == 2 and got[2, 0]["text"] is None


@pytest.mark.parametrize("rows", [ROWS, CHAIN])
def test_same_as_sql(spark, rows):
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = chat.conversations(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, db.execute(ORACLES["op6_chat"]).fetchall()))


def test_long_chain_and_repeats(spark):
    rows = [(1, 0, "u", "message number 0 of this long chain")]
    rows += [(1, i, "u", f"> message number {i - 1} of this long chain\nmessage number {i} of this long chain") for i in range(1, 40)]
    rows += [(1, 39, "u", rows[-1][3])]
    got = chat.conversations(_rows(spark, rows)).collect()
    assert len(got) == 41 and all(r["depth"] == r["turn"] and r["thread"] == 0 for r in got)


def test_no_quotes_and_no_rows(spark):
    plain = [(1, i, "u", f"text {i}") for i in range(5)]
    assert sorted((r["turn"], r["text"]) for r in chat.conversations(_rows(spark, plain)).collect()) == [(i, f"text {i}") for i in range(5)]
    assert chat.conversations(_rows(spark, [])).collect() == []


def test_only_functions(spark):
    plan = chat.conversations(_rows(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_partial_short_and_rewrapped_quotes(spark):
    long = "Shall we go there?\nYes.\nDo it.\n\nThe first paragraph is wrapped\nat some width or other.\n\nThe second one\nis wrapped too, as it is long."
    rows = [
        (1, 0, "u", long), (1, 1, "u", "> Do it.\nfine"), (1, 2, "u", "> Yes.\n> Do it.\nwell"),
        (1, 3, "u", "> The first paragraph is\n> wrapped at some width\n> or other.\n>\n> The second one is wrapped too, as it is long.\nokay"),
        (1, 4, "u", "> The first paragraph is wrapped at\n> some width or other.\nright"), (1, 5, "u", "> Yes.\n> said nobody\n>> fine\nhm"),
        (2, 0, "u", "Answers of mine:\nYes.\nNo."), (2, 1, "u", "Yes."), (2, 2, "u", "> Yes.\nthanks"), (2, 3, "u", "> Never.\nwhat"),
        (3, 0, "u", "> zzz\nThis paragraph is\nin two lines.\n> yyy\nAnother text."), (3, 1, "u", "> This paragraph is in two\n> lines.\nsure"),
    ]
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in chat.conversations(_rows(spark, rows)).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {(1, 1): 0, (1, 2): 0, (1, 3): 0, (1, 4): 0, (1, 5): 1, (2, 2): 1, (3, 1): 0}
