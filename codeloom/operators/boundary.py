"""Work that leaves the engine: compiling, running, asking a model. Each is an interface that a partition works through;
tests and dry runs supply their own."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of runs that had no exit code of their own.
TIMED_OUT, NOT_FOUND, BROKE = -1, -2, -3


@dataclass
class Outcome:
    code: int
    out: str = ""
    err: str = ""

    @property
    def ok(self) -> bool:
        return self.code == 0


def run_command(command: list[str], given: str = "", seconds: float = 10.0) -> Outcome:
    """One process, never raising."""
    try:
        done = subprocess.run(command, input=given, capture_output=True, text=True, timeout=seconds, errors="replace")
        return Outcome(done.returncode, done.stdout, done.stderr)
    except subprocess.TimeoutExpired:
        return Outcome(TIMED_OUT, err=f"timeout after {seconds:g} s")
    except FileNotFoundError:
        return Outcome(NOT_FOUND, err=f"not found: {command[0]}")
    except OSError as e:
        return Outcome(BROKE, err=str(e))


def code_meaning(code: Column) -> Column:
    return F.when(code == 0, "ok").when(code == TIMED_OUT, "timeout").when(code == NOT_FOUND, "not found").when(code == BROKE, "error").otherwise("failed")


#: (source, input) -> outcome. Made once per task, so that it can keep compiled programs.
Runner = Callable[[str, str], Outcome]


def execute(cases: DataFrame, make_runner: Callable[[], Runner], source: str = "source", given: str = "input") -> DataFrame:
    """Adds ok and output to every case. Equal (source, input) pairs are run once: distinct pairs are grouped by source, so that
    a task meets the cases of a program one after the other and compiles it once, and the results are joined back."""
    keyed = cases.withColumn("_s", F.xxhash64(source, F.lit(1))).withColumn("_k", F.sha2(F.concat_ws("\0", F.sha2(F.col(source).cast("binary"), 256), F.sha2(F.col(given).cast("binary"), 256)), 256))
    # Salted by input, so that a program with very many cases is spread over tasks.
    runs = keyed.select("_k", "_s", F.col(source).alias("s"), F.col(given).alias("g")).dropDuplicates(["_k"]).repartition("_s", F.pmod(F.xxhash64("g"), F.lit(16))).sortWithinPartitions("_s")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner = make_runner()
        for pdf in batches:
            made = [runner(s, g) for s, g in zip(pdf["s"], pdf["g"])]
            yield pd.DataFrame({"_k": pdf["_k"], "ok": [o.ok for o in made], "output": [o.out for o in made], "code": [o.code for o in made]})

    done = runs.mapInPandas(work, "_k string, ok boolean, output string, code int")
    return keyed.join(done, "_k").drop("_k", "_s")


def compiling_runner(command: Callable[[str, str], list[str]], seconds: float = 30.0, limit: float = 10.0, keep: int = 64) -> Callable[[], Runner]:
    """A runner that compiles each source once per task with ``command(source path, program path)`` and keeps ``keep`` programs."""

    def make() -> Runner:
        import hashlib
        import os
        import tempfile
        from collections import OrderedDict

        folder = tempfile.mkdtemp(prefix="programs-")
        built: OrderedDict[str, Outcome | str] = OrderedDict()

        def run(source: str, given: str) -> Outcome:
            name = hashlib.sha256(source.encode()).hexdigest()
            if name not in built:
                path, program = os.path.join(folder, name + ".cpp"), os.path.join(folder, name)
                with open(path, "w", encoding="utf-8") as f:
                    f.write(source)
                made = run_command(command(path, program), seconds=seconds)
                built[name] = program if made.ok else made
                if len(built) > keep:
                    old, was = built.popitem(last=False)
                    for p in (os.path.join(folder, old + ".cpp"), os.path.join(folder, old)):
                        if os.path.exists(p):
                            os.remove(p)
            built.move_to_end(name)
            program = built[name]
            return program if isinstance(program, Outcome) else run_command([program], given, limit)

        return run

    return make


def ask(prompts: DataFrame, make_client: Callable[[], Callable[[str], str]], prompt: str = "prompt", attempts: int = 3, retryable: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """Adds answer, tries and error: a model is asked once per distinct prompt, transient failures are tried again after 1, 2, ... seconds."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        client, wait = make_client(), sleep or time.sleep
        for pdf in batches:
            rows = []
            for p in pdf["_p"]:
                answer = error = None
                for tries in range(1, attempts + 1):
                    try:
                        answer, error = client(p), None
                        break
                    except Exception as e:  # noqa: BLE001 - reported per row
                        error = f"{type(e).__name__}: {e}"
                        if not retryable(e) or tries == attempts:
                            break
                        wait(2.0 ** (tries - 1))
                rows.append((p, answer, tries, error))
            yield pd.DataFrame(rows, columns=["_p", "answer", "tries", "error"])

    done = prompts.select(F.col(prompt).alias("_p")).distinct().mapInPandas(work, "_p string, answer string, tries int, error string")
    return prompts.join(done, F.col(prompt) == F.col("_p"), "left").drop("_p")
