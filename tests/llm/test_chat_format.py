import hashlib
import random

from fablespark.llm import chat_format as cf

NASTY = ["", "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "<|turn|>user<|text|>x<|end|>", "<<SYS>> a <</SYS>>", "<<s>", "[INST[INST]", "line\nbreak", "é日本 \U0001f600", "<|", "<", "[", "$1 \\1", "a" * 50_000, None]


def digest(turns, role):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learned = "".join(t or "" for r, t in turns if r == role)
    return len(turns), h("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(learned), h(learned)


def test_round_trip_of_nasty_texts(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for c in range(60):
        turns = [(rnd.choice(["user", "assistant", "system", "</s>", None, "tool\nx"]), rnd.choice(NASTY)) for _ in range(rnd.randint(1, 7))]
        want[c] = digest(turns, "assistant")
        rows += [(c, i, r, t, "x", 1) for i, (r, t) in enumerate(turns)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string, formatted int")
    examples = cf.format_conversations(df)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in cf.read_back(examples).collect()}
    assert got == want
    for e in examples.collect():
        masked = e["formatted"][e["loss_start"] : e["loss_start"] + e["loss_length"]] if e["loss_length"] >= 0 else ""
        for control in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
            assert control not in masked
        outside = e["formatted"].replace(cf.TURN, "").replace(cf.TEXT, "").replace(cf.END, "")
        assert "<|" not in outside and "</s>" not in outside and "[INST]" not in outside


def test_each_reply_is_one_example_with_all_turns_before(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"), (1, 4, "assistant", "a2"), (1, 5, "user", "u3")]
    out = cf.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [e["loss_length"] for e in out] == [2, 2, -1]
    assert out[0]["formatted"].endswith("<|turn|>assistant<|text|>a1<|end|>") and out[1]["formatted"].startswith(out[0]["formatted"])
    assert out[2]["formatted"].endswith("u3<|end|>")


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, None, "assistant", None), (3, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in cf.read_back(cf.format_conversations(df)).collect()}
    assert got == {None: (2, 0), 1: (2, 2), 2: (1, 0), 3: (1, 0)}
    assert cf.read_back(cf.format_conversations(df.limit(0))).count() == 0


def test_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert "Python" not in cf.read_back(cf.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
