from pyspark.sql import functions as F

from pricelens.llm import chat
from pricelens.llm.queries import QUERIES
from oracle import duck, same

SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    assert same(QUERIES["op7_perspective_rotation"](spark, d), duck(d), chat.QUERY_SQL)


def shown(df):
    return {(r.conv_id, r.perspective): (r.text, [r.text[m.start:m.end] for m in r.mask]) for r in df.collect()}


def test_three_speakers(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi \U0001f600"), (1, 2, "bob", "Hello"), (1, 3, "cy", "Hey <|end|>"), (1, 4, "ann", "Bye")]
    got = shown(chat.rotate_perspectives(spark.createDataFrame(rows, SCHEMA)))
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy")}
    text, trained = got[1, "ann"]
    assert text == ("<|system|>\nBe kind.\n<|end|>\n<|assistant|>\nHi \U0001f600\n<|end|>\n<|user name=bob|>\nHello\n<|end|>\n"
                    "<|user name=cy|>\nHey < |end|>\n<|end|>\n<|assistant|>\nBye\n<|end|>\n")
    assert trained == ["Hi \U0001f600\n<|end|>", "Bye\n<|end|>"]
    assert got[1, "cy"][1] == ["Hey < |end|>\n<|end|>"]


def test_edge_rows(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, 0, "b", None), (1, None, None, "first"), (2, 0, "system", "alone"),
            (None, 0, "a", ""), (None, 1, "b", "y"), (3, 5, "a", "z" * 100_000), (4, -1, "a", "m")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("segment", F.lit("clash")).withColumn("mask", F.lit(1))
    out = chat.rotate_perspectives(df)
    got = {(r.conv_id, r.perspective, r.segment): r for r in out.collect()}
    assert len(got) == out.count()
    assert got[1, "a", 0].n_messages == 2 and got[1, "a", 0].n_trained == 1          # the repeated row counts once
    assert got[1, "unknown", -1].n_trained == 1 and got[1, "a", -1].n_trained == 0   # null turns come first
    assert not [k for k in got if k[0] == 2]
    assert got[None, "b", 0].n_messages == 2
    assert len(got[3, "a", 0].text) > 100_000 and got[4, "a", -1].n_messages == 1
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_parts_follow_the_order_of_turns(spark):
    """Segments of any number of messages: read by (segment, part) they are in turn order."""
    rows = [(1, i % 60, "ab"[i % 2], f"t{i:04d}") for i in range(900)] + [(2, 0, "ab"[i % 2], f"t{i:04d}") for i in range(300)]
    rows += [(None, None, "a", f"n{i:04d}") for i in range(130)] + [(3, i, "ab"[i % 2], f"s{i}") for i in range(50)] + rows[:40]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = chat.rotate_perspectives(df, part_messages=60).collect()
    said = {}
    for c, t, who, text in set(rows):
        said.setdefault(c, []).append((t if t is not None else -1, who, text))
    for conv, messages in said.items():
        for who in {w for _, w, _ in messages}:
            mine = sorted((r for r in out if r.conv_id == conv and r.perspective == who), key=lambda r: (r.segment, r.part))
            assert [r.part for r in mine] == list(range(len(mine)))
            assert [r.n_messages for r in mine[:-1]] == [60] * (len(mine) - 1) and 1 <= mine[-1].n_messages <= 60
            text = "".join(r.text for r in mine)
            assert [x for x in text.split("\n") if x[:1] in "tns" and x[1:].isdigit()] == [m[2] for m in sorted(messages)]
            assert sum(r.n_trained for r in mine) == sum(w == who for _, w, _ in messages)


def test_crowded_segments_match_sql(spark):
    rows = [(1, i % 30, "abc"[i % 3], f"t{i}") for i in range(700)] + [(2, None, "ab"[i % 2], f"t{i}") for i in range(300)] + [(3, 70, "a", "x"), (3, 1, "system", "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    got = same(chat.rotate_perspectives(df).withColumn("mask", F.array_join(spans, ",")), duck(conversations=df), chat.QUERY_SQL)
    assert len(got) == 3 * 3 + 2 * 2 + 2


def test_long_dialogues_are_cut_into_segments(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(300)]
    out = chat.rotate_perspectives(spark.createDataFrame(rows, SCHEMA), segment_turns=50).collect()
    assert len(out) == 2 * 6 and all(r.n_messages == 50 for r in out)
    first = [r for r in sorted(out, key=lambda r: (r.segment, r.part)) if r.perspective == "b"]
    assert "".join(r.text for r in first).count("<|assistant|>") == 150
