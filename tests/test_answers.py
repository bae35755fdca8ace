"""The table of answers: calls are counted through files, as they happen in other processes."""

import json
import os
import subprocess
import sys
import uuid
from collections import Counter
from pathlib import Path

import pytest

from claimspark.operators import answers
from claimspark.session import written

ROOT = Path(__file__).resolve().parents[1]


def client_of(log, refuse="refused", stop_after=None):
    """A client that notes its calls in ``log`` and can end its task after some of them."""

    def make():
        made = []

        def ask(prompt):
            if stop_after is not None and len(made) >= stop_after:
                raise SystemExit("lost")
            made.append(prompt)
            with open(log, "a") as out:
                out.write(json.dumps(prompt) + "\n")
            if refuse in prompt:
                raise ValueError("no")
            return {"size": len(prompt)}

        return ask

    return make


def calls(log):
    return Counter(json.loads(line) for line in open(log)) if os.path.exists(log) else Counter()


def run(df, log, table, name, client=None, callers=3, **options):
    return answers.answered(
        df, "prompt", "id", client or client_of(log), "size INT", {"size": -1}, table, name, callers, written,
        **{"backoff": 0.0, "max_attempts": 1, "every": 1, **options},
    )


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "calls"), str(tmp_path / f"answers-{uuid.uuid4().hex}")


@pytest.fixture(scope="module")
def prompts(spark):
    rows = [(i, f"prompt {i % 40}") for i in range(200)] + [(1000 + i, "hot") for i in range(400)]
    rows += [(2000, None), (2001, ""), (2002, "refused"), (2003, "refused"), (2004, None)]
    return spark.createDataFrame(rows, "id long, prompt string").repartition(5)


DISTINCT = 43


def test_each_prompt_is_asked_once_and_known_ones_not_again(prompts, place):
    log, table = place
    first = {r["id"]: r for r in run(prompts.where("id < 100"), log, table, "one").collect()}
    assert len(first) == 100 and calls(log) == Counter({f"prompt {i}": 1 for i in range(40)})
    rows = {r["id"]: r for r in run(prompts, log, table, "two").collect()}
    assert len(rows) == prompts.count()
    assert len(calls(log)) == DISTINCT and set(calls(log).values()) == {1}
    assert rows[5]["run"] == "one" and rows[1000]["run"] == "two" and rows[1000]["size"] == 3
    assert all(r["size"] == len(r["prompt"]) and r["ok"] for i, r in rows.items() if i < 2000)
    assert (rows[2001]["size"], rows[2001]["ok"]) == (0, True)
    for i in (2002, 2003):
        assert (rows[i]["size"], rows[i]["ok"], rows[i]["error"], rows[i]["attempts"]) == (-1, False, "ValueError: no", 1)
    for i in (2000, 2004):
        assert (rows[i]["size"], rows[i]["ok"], rows[i]["error"], rows[i]["attempts"], rows[i]["run"]) == (-1, False, "no prompt", 0, None)
    # What failed is asked again in another run only.
    run(prompts, log, table, "two")
    assert calls(log)["refused"] == 1
    again = run(prompts, log, table, "three", client_of(log, refuse="nothing")).where("id = 2002").first()
    assert calls(log)["refused"] == 2 and again["ok"] and again["run"] == "three"
    assert sum(calls(log).values()) == DISTINCT + 1


def test_a_run_that_broke_off_goes_on_where_it_was(prompts, place):
    log, table = place
    with pytest.raises(Exception):
        run(prompts, log, table, "one", client_of(log, stop_after=4))
    made = sum(calls(log).values())
    assert 4 <= made < DISTINCT
    assert run(prompts, log, table, "one").count() == prompts.count()
    assert len(calls(log)) == DISTINCT and set(calls(log).values()) == {1}


def test_tasks_that_call_and_their_pauses_are_bounded(prompts, place, tmp_path):
    log, table = place
    pauses = str(tmp_path / "pauses")

    def sleep(seconds):
        with open(pauses, "a") as out:
            out.write(f"{seconds}\n")

    run(prompts, log, table, "one", callers=2, pause=0.5, every=7, sleep=sleep)
    slots = os.listdir(f"{table}/run=one")
    assert len(slots) == 2
    assert open(pauses).read().split() == ["0.5"] * (DISTINCT - 2)
    files = [f for slot in slots for f in os.listdir(f"{table}/run=one/{slot}") if f.endswith(".parquet")]
    assert len(files) <= DISTINCT // 7 + 2


def test_empty_table_and_extra_columns(spark, place):
    log, table = place
    df = spark.createDataFrame([(1, "a", "x", 9)], "id long, prompt string, digest string, n int")
    assert run(df.limit(0), log, table, "one").collect() == []
    assert run(df, log, table, "two").first().asDict() == {
        "id": 1, "prompt": "a", "digest": "x", "n": 9, "size": 1, "ok": True, "error": None, "attempts": 1, "run": "two",
    }


LOST = """
import json, os, sys
from pyspark import TaskContext
from claimspark.operators import answers
from claimspark.session import local_session, written
log, table = sys.argv[1:]
spark = local_session("2,3", **{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "1g"})

def make():
    made = []
    def ask(prompt):
        if len(made) >= 3 and TaskContext.get().attemptNumber() == 0:
            os._exit(1)
        made.append(prompt)
        with open(log, "a") as out:
            out.write(json.dumps(prompt) + "\\n")
        return {"size": len(prompt)}
    return ask

df = spark.range(100).selectExpr("id", "concat('p', id % 30) AS prompt")
done = answers.answered(df, "prompt", "id", make, "size INT", {}, table, "one", 2, written, every=1)
assert done.where("ok").count() == 100
spark.stop()
"""


def test_a_lost_task_asks_only_the_rest(place):
    log, table = place
    done = subprocess.run([sys.executable, "-c", LOST, log, table], cwd=ROOT, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(calls(log)) == 30 and set(calls(log).values()) == {1}


def test_answers_of_a_table_that_is_not_there(spark, place):
    empty = answers.read_answers(spark, place[1], "size INT")
    assert empty.columns == ["digest", "size", "ok", "error", "attempts", "run"] and empty.count() == 0
