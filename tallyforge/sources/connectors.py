"""Edges to the outside: recorded model replies, and compiling and running C. Execution is off unless it is allowed."""

from __future__ import annotations

import contextlib
import os
import signal
import subprocess
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import RETRYABLE

COMPILE_SECONDS, RUN_SECONDS = 30, 15


def replayed(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """Prompts (prompt) with the recorded reply of each, by the hash of the prompt; null without one."""
    by = F.sha2("prompt", 256)
    return prompts.withColumn("__h", by).join(replies.select(F.sha2("prompt", 256).alias("__h"), "reply").dropDuplicates(["__h"]), "__h", "left").drop("__h")


def retried(call: Callable[[], object], attempts: int = 3, delay: Callable[[int], float] = lambda n: 5.0):
    """The result of call, tried again while its error names a network fault; other errors are raised at once.

    delay gives the seconds before the next try by the number of failed ones; ``lambda n: min(60, 4 * 2**n)`` backs off.
    """
    for n in range(attempts):
        try:
            return call()
        except Exception as error:
            if n + 1 == attempts or not any(x in str(error).lower() for x in RETRYABLE):
                raise
            time.sleep(delay(n))


def completed(prompts: DataFrame, engine: Callable[[], Callable[[str], str]], attempts: int = 3) -> DataFrame:
    """prompts (key, prompt) with the reply of an engine, made once for each task, or the error; no row fails the task."""

    def work(batches):
        import pandas as pd

        ask = engine()
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["key"], batch["prompt"], strict=True):
                try:
                    rows.append((key, retried(lambda p=prompt: ask(p), attempts), None))
                except Exception as error:
                    rows.append((key, None, str(error)))
            yield pd.DataFrame(rows, columns=["key", "reply", "error"])

    return prompts.select("key", "prompt").mapInPandas(work, "key long, reply string, error string")


def command(args: list[str], seconds: float, folder: str) -> tuple[int | None, str, str]:
    """(exit code, stdout, stderr) of a process group; the code is None after a timeout, when the group is killed."""
    run = subprocess.Popen(args, cwd=folder, stdout=subprocess.PIPE, stderr=subprocess.PIPE, stdin=subprocess.DEVNULL, start_new_session=True)
    try:
        out, err = run.communicate(timeout=seconds)
        return run.returncode, out.decode(errors="replace"), err.decode(errors="replace")
    except subprocess.TimeoutExpired:
        with contextlib.suppress(OSError):
            os.killpg(run.pid, signal.SIGKILL)
        run.communicate()
        return None, "", "timeout"


def run_c(code: str, bench: str, compiler: str = "gcc") -> dict:
    """Compiles code and bench together and runs them: compiled, exit_code, output, error."""
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "module.c").write_text(code)
        Path(folder, "tb.c").write_text(bench)
        status, _, err = command([compiler, "module.c", "tb.c", "-o", "run", "-lm"], COMPILE_SECONDS, folder)
        if status != 0:
            return {"compiled": False, "exit_code": status, "output": "", "error": f"Compilation failed: {err}" if status is not None else "Compilation timeout"}
        status, out, err = command(["./run"], RUN_SECONDS, folder)
        return {"compiled": True, "exit_code": status, "output": out, "error": err}


def executed(pairs: DataFrame, allow: bool = False) -> DataFrame:
    """pairs (key, code, bench) with compiled, exit_code, output and error. Runs untrusted code, so it must be allowed.

    A mutant that doesn't compile counts as passed, that is as undetected; ``compiled`` tells it apart.
    """
    if not allow:
        raise PermissionError("running generated code is off; pass allow=True on machines meant for it")

    def work(batches):
        import pandas as pd

        for batch in batches:
            rows = [{"key": k, **run_c(c or "", b or "")} for k, c, b in zip(batch["key"], batch["code"], batch["bench"], strict=True)]
            frame = pd.DataFrame(rows, columns=["key", "compiled", "exit_code", "output", "error"])
            frame["exit_code"] = frame["exit_code"].astype("Int64")
            yield frame

    return pairs.select("key", "code", "bench").mapInPandas(work, "key long, compiled boolean, exit_code long, output string, error string")
