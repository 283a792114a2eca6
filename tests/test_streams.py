"""Growing files: bytes once, whole lines, restarts; resumption and running status as keyed state."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import ledger as R
from ledgerloom.streaming.tail import grow_files, last_line_end, opened, tail


def collected(spark, path, state, **options):
    out = []
    q = tail(spark, path, **options).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(out)


@pytest.mark.parametrize("split", [3, 1 << 20])
def test_tail_gives_each_line_once(spark, tmp_path, split):
    folder = tmp_path / "in"
    folder.mkdir()
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    a.write_bytes(b"one\n\n  \ntwo\nhalf a li")
    assert collected(spark, str(folder), str(tmp_path / "s"), split_bytes=split) == [("a.jsonl", 0, "one"), ("a.jsonl", 8, "two")]
    a.write_bytes(a.read_bytes() + "ne\nlong ünï line\n".encode() + b"bad \xff byte\nrest")
    b.write_bytes(b"no end yet")
    (folder / "other.txt").write_text("x\n")
    got = collected(spark, str(folder), str(tmp_path / "s"), split_bytes=split)
    assert [x[2] for x in got] == ["half a line", "long ünï line", "bad � byte"] and got[0][1] == 12
    assert collected(spark, str(folder), str(tmp_path / "s"), split_bytes=split) == []
    a.write_bytes(a.read_bytes() + b"\n")
    b.write_bytes(b"no end yet\n" * 40)
    got = collected(spark, str(folder), str(tmp_path / "s"), split_bytes=split)
    assert got[0][2] == "rest" and [x[1] for x in got[1:]] == [11 * i for i in range(40)]


def test_tail_of_one_file_and_of_one_that_shrinks(spark, tmp_path):
    one = tmp_path / "one.jsonl"
    one.write_text("a\nb\n")
    assert [x[2] for x in collected(spark, str(one), str(tmp_path / "s"))] == ["a", "b"]
    one.write_text("a\n")
    with pytest.raises(Exception, match="shorter than what was read"):
        collected(spark, str(one), str(tmp_path / "s"))
    assert collected(spark, str(tmp_path / "nothing"), str(tmp_path / "s2")) == []


def test_last_line_end_looks_back_in_steps(tmp_path, monkeypatch):
    monkeypatch.setattr("ledgerloom.streaming.tail.LOOK_BYTES", 4)
    (tmp_path / "x").write_bytes(b"ab\n" + b"c" * 30)
    fs, path = opened(str(tmp_path / "x"))
    assert last_line_end(fs, path, 0, 33) == 3 and last_line_end(fs, path, 5, 33) == 5


def grown(spark, path, rows):
    df = spark.createDataFrame([(f"{k}.jsonl", i, json.dumps(x)) for i, (k, x) in enumerate(rows)], "file string, i int, line string")
    return grow_files(df, path, "file", ["i"], "line")


def test_last_valid_wins_and_replay_adds_nothing(spark, tmp_path):
    row = lambda p, text, error=None: ("f", {"prompt_id": p, "model": "m", "response_text": text, "error": error})
    first = [row("p1", "good"), row("p2", None, "timeout"), row("p3", "early"), row(None, "no key")]
    then = [row("p1", None, "failed again"), row("p2", "at last"), row("p3", "late"), row("p3", "")]
    valid = (F.coalesce("response_text", F.lit("")) != "") & F.col("error").isNull()
    for rows in (first, first + then, first + then):
        assert grown(spark, str(tmp_path / "in"), rows) == 1
        lines = tail(spark, str(tmp_path / "in"))
        stream = R.last_valid(R.attempts(lines, "prompt_id string, model string, response_text string, error string"), ["prompt_id", "model"], valid, ["response_text"])
        R.keep_batches(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = R.newest(spark, str(tmp_path / "out"), ["prompt_id", "model"]).collect()
    assert {r.prompt_id: (r.response_text, r.n_valid) for r in got} == {"p1": ("good", 1), "p2": ("at last", 1), "p3": ("late", 2)}
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("batch").count().count() == 2


def test_append_new_keeps_state_and_never_repeats(spark, tmp_path):
    rows = [("f", {"k": 1, "value": 5.0}), ("f", {"k": 1, "value": 6.0}), ("f", {"k": 2, "value": 0.0})]
    for n in (3, 4, 4):
        grown(spark, str(tmp_path / "in"), (rows + [("f", {"k": 2, "value": 2.0})])[:n])
        stream = R.attempts(tail(spark, str(tmp_path / "in")), "k int, value double").drop("file", "offset")
        R.append_new(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "state"), F.col("value") >= 1).awaitTermination()
        assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ([1] if n == 3 else [1, 2])


def test_progress_by_model(spark, tmp_path):
    hour = lambda m, at, good=True: ("f", {"model": m, "good": good, "at": 3600.0 * at})
    first = [hour("a", 0), hour("a", 1), hour("a", 2, False), hour("b", 5)]
    then = [hour("a", 3), hour("a", 4), hour("b", 5, False)]
    for rows in (first, first + then):
        grown(spark, str(tmp_path / "in"), rows)
        stream = R.attempts(tail(spark, str(tmp_path / "in")), "model string, good boolean, at double")
        R.keep_batches(R.progress(stream.select("model", "good", "at"), 10), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    status = R.newest(spark, str(tmp_path / "out"), ["model"])
    got = {r.model: (r.ok, r.errors, r.remaining, r.average_per_hour, r.recent_per_hour, r.eta_hours) for r in status.collect()}
    assert got == {"a": (4, 1, 6, 1.0, 1.0, 6.0), "b": (1, 1, 9, None, None, None)}
    assert R.slowest(status).first()["eta_hours"] == 6.0


def test_strict_reads_name_the_first_bad_line(spark, tmp_path):
    from ledgerloom.operators.contracts import ContractError
    from ledgerloom.sources import ledgers as L

    folder = tmp_path / "strict"
    folder.mkdir()
    good = [json.dumps({"k": i, "v": "x" * (i % 7)}) for i in range(200)]
    (folder / "a.jsonl").write_text("\n".join([*good[:150], "", '{"k": 1, "v', *good[150:], "no json"]) + "\n")
    (folder / "b.jsonl").write_text("\n".join(good))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, "300" if "max" in c else "1")
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
        got = [(r.file.rsplit("/", 1)[-1], r.line, r.text) for r in L.bad_lines(spark, str(folder), "k long, v string").collect()]
        assert got == [("a.jsonl", 152, '{"k": 1, "v')]
        with pytest.raises(ContractError, match="a.jsonl:152"):
            L.read_strict(spark, str(folder), "k long, v string")
        assert L.read_strict(spark, str(folder / "b.jsonl"), "k long, v string").count() == 200
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_snapshots_swap_by_a_pointer(spark, tmp_path):
    import os

    from ledgerloom.operators.contracts import ContractError
    from ledgerloom.sources import ledgers as L

    path = str(tmp_path / "snap")
    with pytest.raises(ContractError):
        L.read_snapshot(spark, path)
    L.replace_snapshot(spark.range(3), path)
    old = L.read_snapshot(spark, path)
    L.replace_snapshot(spark.range(5), path)
    # Who reads the version before goes on reading it; a version that was being written when its writer died is no one's.
    spark.range(9).write.parquet(f"{path}/version-dead")
    assert (old.count(), L.read_snapshot(spark, path).count()) == (3, 5)
    L.replace_snapshot(spark.range(7), path)
    assert L.read_snapshot(spark, path).count() == 7 and sum(n.startswith("version-") for n in os.listdir(path)) == 2


def test_yaml_lists_and_deny_maps(spark, tmp_path):
    from ledgerloom.operators.contracts import ContractError
    from ledgerloom.sources import ledgers as L

    text = """---
# what is left out
version: 2
excluded_qids:
  Q12:   # first
    issue: 'it''s # one'
    reason: >
      two lines
      of text: really

  Q345:
    issue: "two"
models:
- a-1
- "b # not a comment"   # a comment
- c#d
empty: []
short: [x, 'y', 3]   # in one line
pairs:
  - id: 7
    name: seven
  - id: 8
"""
    (tmp_path / "c.yaml").write_text(text)
    got = [tuple(r) for r in L.read_yaml_lists(spark, str(tmp_path / "c.yaml")).collect()]
    assert got == [
        ("excluded_qids", 1, None, "Q12"), ("excluded_qids", 1, "issue", "it's # one"), ("excluded_qids", 1, "reason", "two lines of text: really"),
        ("excluded_qids", 2, None, "Q345"), ("excluded_qids", 2, "issue", "two"), ("models", 1, None, "a-1"), ("models", 2, None, "b # not a comment"), ("models", 3, None, "c#d"),
        ("short", 1, None, "x"), ("short", 2, None, "y"), ("short", 3, None, "3"), ("pairs", 1, "id", "7"), ("pairs", 1, "name", "seven"), ("pairs", 2, "id", "8"),
    ]
    for bad in ("a:\n  Q1: {x: 1}\n  what is this", "  - early\n", "a:\n  - 'open\n"):
        with pytest.raises(ContractError):
            L.yaml_entries(bad)


def test_forbidden_fields_and_keys(spark):
    from ledgerloom.operators import contracts as K

    df = spark.createDataFrame([(1, '{"a": {"API_Key": 1}, "b": [{"x\\"y": 2}]}'), (2, '{"t": "\\"api_key\\": 3"}'), (3, None)], "id int, payload string")
    assert [(r.word, r.key, r.n) for r in K.forbidden_keys(df, "payload", ["api_key", "reasoning"]).collect()] == [("api_key", "API_Key", 1)]
    nested = spark.createDataFrame([], "a struct<Account: int, l: array<struct<reasoning_text: string>>>, m map<string, struct<apikey: int>>, fine int")
    assert K.forbidden_fields(nested, ["account", "reasoning", "apikey"]) == [("a.Account", "account"), ("a.l[].reasoning_text", "reasoning"), ("m{}.apikey", "apikey")]
    with pytest.raises(K.ContractError, match="a.Account"):
        K.refuse_forbidden(nested, ["account"])
    with pytest.raises(K.ContractError, match="API_Key"):
        K.refuse_forbidden(df, ["api_key"], ["payload"])
    assert K.refuse_forbidden(df, ["secret"], ["payload"]) is df


def test_retry_plan(spark):
    """Names count without a status, what can't be read as a number is no wish, and waits stop growing."""
    rows = [(1, None, "APIConnectionError", 1, None), (2, 404, "NotFound", 1, "9"), (3, 429, "RateLimitError", 12, "-3"), (4, 503, None, 1, "100"), (5, None, None, 1, "x"), (6, 408, "E", 3, "later")]
    df = spark.createDataFrame(rows, "id int, status int, error string, attempt int, retry_after string")
    got = {r.id: r for r in R.retry_plan(df, "id", "s").collect()}
    assert {i: r.transient for i, r in got.items()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True}
    assert got[2].retry_delay_seconds is None and got[2].retry_after_seconds == 9 and got[3].retry_after_seconds == 0 and got[6].retry_after_seconds is None
    assert 1 <= got[1].retry_delay_seconds < 1.75 and 60 <= got[3].retry_delay_seconds < 60.75 and got[4].retry_delay_seconds == 100 and 4 <= got[6].retry_delay_seconds < 4.75
    assert got[3].is_rate_limit and not got[1].is_rate_limit
