"""The extension surface: model calls as injected functions, and validation as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def classify_once(df: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], batch: int = 64) -> DataFrame:
    """Calls a model once for each distinct prompt, in batches, and joins its answers back: a cache of
    model calls. Null prompts get no answer."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f[prompt].iloc[at : at + batch].tolist()
                yield pd.DataFrame({prompt: part, "answer": model(part)})

    answers = df.select(prompt).where(f"`{prompt}` is not null").distinct().mapInPandas(call, f"`{prompt}` string, answer string")
    return df.join(answers, prompt, "left")


@udtf(returnType="position: int, code: string")
class Problems:
    """SQL table function problems(text): one row for each problem of a text."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        if isinstance(text, Row):
            text = text[0]
        found = []
        if text is None or not text.strip():
            found.append("empty")
        else:
            if len(text) > 5000:
                found.append("long")
            if any(c in text for c in "#*$%"):
                found.append("symbols")
            if "\t" in text:
                found.append("tab")
        yield from enumerate(found)


def ask_until_valid(df: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], problem: Callable[[str], str | None], refuse: Callable[[str], bool], tries: int = 3, batch: int = 64) -> DataFrame:
    """Asks a model once for each distinct prompt, and again with the problem named while its answer has one, `tries` times at
    most. Prompts that `refuse` holds back are never sent. Adds answer (null without a valid one), asked (times) and outcome:
    ok, refused or invalid; null prompts get none."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f[prompt].iloc[at : at + batch].tolist()
                out = {p: (None, 0, "refused") if refuse(p) else (None, 0, "invalid") for p in part}
                waiting = {p: p for p in part if out[p][2] != "refused"}
                for n in range(1, tries + 1):
                    for p, answer in zip(waiting, model(list(waiting.values())), strict=True):
                        wrong = problem(answer)
                        out[p] = (None, n, "invalid") if wrong else (answer, n, "ok")
                        waiting[p] = f"{p}\n{wrong}" if wrong else ""
                    waiting = {p: q for p, q in waiting.items() if q}
                    if not waiting:
                        break
                yield pd.DataFrame([(p, *out[p]) for p in part], columns=[prompt, "answer", "asked", "outcome"])

    answers = df.select(prompt).where(f"`{prompt}` is not null").distinct().mapInPandas(call, f"`{prompt}` string, answer string, asked int, outcome string")
    return df.join(answers, prompt, "left")


class Tools:
    """A registry of declared tools: a name, a description, the parameters, and a SQL function registered under the name. What
    is called by name is checked against the declaration: unknown tools, missing parameters and tools that fail are an outcome, not an error."""

    def __init__(self, spark: SparkSession):
        self.spark, self.declared, self.functions = spark, {}, {}

    def add(self, name: str, description: str, required: list[str], function: Callable, returns: str = "string") -> None:
        self.spark.udf.register(f"tool_{name}", function, returns)
        self.declared[name] = {"description": description, "required": required}
        self.functions[name] = function

    def call(self, df: DataFrame, tool: str, arguments: str) -> DataFrame:
        """Dispatches each row to the tool it names, with its map of arguments (string to string): adds outcome and result (as text).
        outcome: unknown_tool (a null or undeclared name), missing_argument (one that is absent or null, or no map), failed (the tool
        raised; no result), or ok. A tool sees only rows that name it and hold its arguments. Columns outcome and result of df are replaced.
        """
        functions = dict(self.functions)
        given = F.lit(None).cast("array<string>")
        for name, d in self.declared.items():
            given = F.when(F.col(tool) == name, F.array(*[F.col(arguments)[r] for r in d["required"]]).cast("array<string>")).otherwise(given)
        whole = F.col(arguments).isNotNull() & ~F.exists(given, lambda v: v.isNull())
        checked = F.when(given.isNull(), "unknown_tool").when(~whole, "missing_argument").otherwise("ok")

        @F.pandas_udf("outcome string, result string")
        def dispatch(outcome: pd.Series, names: pd.Series, values: pd.Series) -> pd.DataFrame:
            out = pd.DataFrame({"outcome": outcome, "result": pd.Series(None, index=outcome.index, dtype=object)})
            for name, at in names[outcome == "ok"].groupby(names).groups.items():
                for k in at:
                    try:
                        answer = functions[name](*values[k])
                        out.at[k, "result"] = None if answer is None else str(answer)
                    except Exception:  # a tool's own failure is its row's outcome
                        out.at[k, "outcome"] = "failed"
            return out

        return df.withColumn("outcome", dispatch(checked, F.col(tool), given)).withColumn("result", F.col("outcome.result")).withColumn("outcome", F.col("outcome.outcome"))


def minted(df: DataFrame, order: str, value: str, mint: Callable[[list[str]], list[str]], at_once: int = 8, batch: int = 100) -> DataFrame:
    """An injected function over the rows, by at most `at_once` tasks, a batch at a time; `order` stays with each row.
    What comes before keeps its own tasks: rows are dealt to these by a shuffle of the two columns."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({order: part[order], value: part[value], "minted": mint(part[value].tolist())})

    kinds = dict(df.dtypes)
    return df.select(order, value).repartition(at_once).mapInPandas(call, f"{order} {kinds[order]}, {value} {kinds[value]}, minted string")
