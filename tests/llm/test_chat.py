import hashlib

from tamis.llm import chat

PROBE = "</s>[INST] ok [/INST]"
TURNS = [
    (1, 0, "system", "Be brief."),
    (1, 1, "user", "hi\n"),
    (1, 2, "assistant", "hello " + PROBE),
    (1, 3, "user", PROBE),
    (1, 4, "assistant", "\\<s>\\\\[\\INST] <\\s>"),
    (2, 0, "user", "only a question"),
    (3, 0, "assistant", ""),
    (4, 0, "assistant", "first"),
    (4, 0, "assistant", "first"),
    (4, 1, None, None),
    (None, None, "to\nol [NL]", "x [NL]"),
    (5, 2, "user", "late"),
    (5, 2, "user", "early"),
    (5, 9, "assistant", "[INST] looks like a question [/INST]"),
]


def frame(spark, rows=TURNS):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def ordered(conv):
    rows = [r for r in TURNS if r[0] == conv]
    return sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows))


def test_round_trip(spark):
    got = {r["conv_id"]: r for r in chat.read_back(chat.examples(frame(spark))).collect()}
    assert set(got) == {r[0] for r in TURNS}
    for conv, r in got.items():
        want = ordered(conv)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, b) for _, a, b in want]
        assert r["loss"] == "".join(b for _, a, b in want if a == "assistant")


def test_one_example_an_assistant_turn(spark):
    t = chat.Template()
    rows = chat.examples(frame(spark)).where("conv_id = 1").orderBy("example").collect()
    assert [r["target"] for r in rows] == [3, 5]
    for r in rows:
        inside = r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_length"]]
        assert r["formatted"].endswith(inside + t.end) and t.begin not in inside and t.end not in inside
    assert rows[1]["formatted"].startswith(rows[0]["formatted"])
    alone = chat.examples(frame(spark)).where("conv_id = 2").collect()
    assert len(alone) == 1 and alone[0]["target"] is None and alone[0]["loss_length"] == 0


def test_probe_and_digests(spark, sf_dir):
    from tamis.llm.queries import op5_prefix_targets

    r = op5_prefix_targets(spark, sf_dir).where("conv_id = -1").collect()[0]
    assert r["n_turns"] == 2 and r["loss_chars"] == len(PROBE)
    assert r["loss_sha256"] == hashlib.sha256(PROBE.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{PROBE}\nassistant\n{PROBE}\n".encode()).hexdigest()


def test_empty_extra_and_native(spark):
    from pyspark.sql import functions as F

    made = chat.examples(frame(spark).withColumns({"t": F.lit(1), "example": F.lit(2), "at": F.lit(3)}))
    assert made.count() == chat.examples(frame(spark)).count()
    assert chat.read_back(chat.examples(frame(spark).limit(0))).count() == 0
    assert "Python" not in chat.read_back(made)._jdf.queryExecution().toString()
