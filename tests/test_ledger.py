"""Replies asked for once."""

import json
import os
import threading
import time

from pyspark.sql import functions as F

from tabfold.plans import ledger, prompting as P
from tabfold.plans.ledger import NO_PROMPT, scan_ledger


def _noting(folder, answer=lambda t: t + "!"):
    """A completion that writes down every prompt it is asked."""

    def complete(texts):
        with open(f"{folder}/{os.getpid()}-{threading.get_ident()}-{time.time_ns()}", "w") as file:
            file.write("".join(t + "\n" for t in texts))
        return [answer(t) for t in texts]

    return complete


def _asked(folder):
    return sorted(line for name in os.listdir(folder) for line in open(f"{folder}/{name}").read().splitlines())


def test_equal_prompts_are_asked_for_once(spark, tmp_path):
    prompts = spark.range(300).select("id", F.concat(F.lit("p"), F.col("id") % 50).alias("prompt"))
    rows = P.score_prompts(prompts, _noting(tmp_path), batch_rows=7)
    assert {(r["prompt"], r["reply"], r["error"]) for r in rows.collect()} == {(f"p{i}", f"p{i}!", None) for i in range(50)}
    assert rows.count() == 300 and _asked(tmp_path) == sorted(f"p{i}" for i in range(50))


def test_a_failing_task_pays_nothing_twice(spark, tmp_path):
    """The task dies after some calls have returned; the job is run again over the same ledger."""
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    prompts = spark.range(60).select(F.concat(F.lit("q"), "id").alias("prompt"))
    noting = _noting(calls)

    def dying(texts):
        if len(os.listdir(calls)) >= 5:
            raise SystemExit("executor lost")  # no Exception: ends the task
        return noting(texts)

    try:
        P.score_prompts(prompts, dying, batch_rows=4, concurrency=1, parallelism=2, ledger=ledger).count()
        raise AssertionError("the first run should break off")
    except AssertionError:
        raise
    except BaseException:
        pass
    before = scan_ledger(spark, ledger).count()
    assert 0 < before < 60
    rows = P.score_prompts(prompts, noting, batch_rows=4, parallelism=2, ledger=ledger)
    assert rows.where("reply = concat(prompt, '!')").count() == 60
    assert _asked(calls) == sorted(f"q{i}" for i in range(60))


def test_a_task_run_again_finds_its_calls(spark, tmp_path):
    from tabfold.plans.ledger import _task

    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    scan_ledger(spark, ledger)
    prompts = spark.range(20).select(F.format_string("h%02d", "id").alias("prompt_hash"), F.concat(F.lit("q"), "id").alias("prompt"))
    work = _task(_noting(calls), ledger, 3, 2, "run")
    for _ in range(2):
        prompts.coalesce(1).sortWithinPartitions("prompt_hash").mapInArrow(work, "paid long").collect()
    assert _asked(calls) == sorted(f"q{i}" for i in range(20))
    assert scan_ledger(spark, ledger).where("reply IS NOT NULL").count() == 20


def test_errors_are_asked_for_again(spark, tmp_path):
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()

    def picky(texts):
        if "q3" in texts:
            raise ValueError("busy")
        return [t + "!" for t in texts]

    prompts = spark.createDataFrame([(f"q{i}",) for i in range(10)] + [(None,), ("",)], "prompt string")
    first = {r["prompt"]: (r["reply"], r["error"]) for r in P.score_prompts(prompts, picky, ledger=ledger).collect()}
    assert first["q3"] == (None, "ValueError: busy") and first[None] == (None, NO_PROMPT) and first[""] == ("!", None)
    again = {r["prompt"]: r["reply"] for r in P.score_prompts(prompts, _noting(calls), ledger=ledger).collect()}
    assert again["q3"] == "q3!" and _asked(calls) == ["q3"]


def test_calls_of_a_task_overlap_and_stay_bounded(spark, tmp_path):
    prompts = spark.range(24).select(F.concat(F.lit("p"), "id").alias("prompt"))

    def slow(texts):
        name = f"{tmp_path}/{time.time_ns()}-{threading.get_ident()}"
        begin = time.time()
        time.sleep(0.2)
        with open(name, "w") as file:
            file.write(f"{begin} {time.time()}")
        return texts

    P.score_prompts(prompts, slow, batch_rows=2, concurrency=3, parallelism=1).count()
    spans = [tuple(map(float, open(tmp_path / n).read().split())) for n in os.listdir(tmp_path)]
    most = max(sum(b <= t < e for b, e in spans) for t, _ in spans)
    assert len(spans) == 12 and 2 <= most <= 3


def test_one_prompt_for_most_rows(spark):
    prompts = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("prompt"))
    rows = P.score_prompts(prompts, lambda texts: [t.upper() for t in texts])
    assert rows.where("reply = upper(prompt)").select("id").distinct().count() == rows.count() == 4000


def test_files_of_calls_become_few(spark, tmp_path):
    calls, folder = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    prompts = spark.range(600).select(F.concat(F.lit("q"), "id").alias("prompt"))
    rows = P.score_prompts(prompts, _noting(calls), batch_rows=2, parallelism=3, ledger=folder)
    assert rows.where("reply = concat(prompt, '!')").count() == 600 and len(_asked(calls)) == 600
    kept = [n for _, _, names in os.walk(folder) for n in names if not n.startswith((".", "_"))]
    assert len(kept) == 3, "300 calls of three tasks leave a file each"
    assert scan_ledger(spark, folder).where("reply IS NOT NULL").count() == 600
    P.score_prompts(prompts, _noting(calls), ledger=folder).count()
    assert len(_asked(calls)) == 600


def test_neighbouring_equal_prompts_are_one(spark, tmp_path):
    from tabfold.plans.ledger import _task

    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    scan_ledger(spark, ledger)
    rows = spark.range(40).select(F.format_string("h%02d", (F.col("id") / 2).cast("int")).alias("prompt_hash"), F.lit("p").alias("prompt"))
    work = _task(_noting(calls), ledger, 3, 2, "run", replies=True)
    for _ in range(2):
        told = rows.coalesce(1).sortWithinPartitions("prompt_hash").mapInArrow(work, "prompt_hash string, reply string, error string").collect()
        assert sorted(r["prompt_hash"] for r in told) == [f"h{i:02d}" for i in range(20)] and {r["reply"] for r in told} == {"p!"}
    assert len(_asked(calls)) == 20


def test_a_line_of_a_journal_is_what_the_encoder_writes():
    rows = [("a" * 64, '{"classification": 1}', None), ("b" * 64, None, 'ValueError: é\n"q" %s \\  '), ("c", "", None)]
    line = ledger._line(rows)
    assert line.endswith(b"]\n") and line.count(b"\n") == 1
    assert json.loads(line) == [dict(zip(ledger._KINDS.names, row)) for row in rows]
