"""Answers: confidence from retrieval alone, error classes, console text, and a pluggable generator."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confidence(queries: DataFrame, rendered: DataFrame) -> DataFrame:
    """query_id, label, percentage: 40 % best score, 30 % mean score, 15 % documents (three count in full), 15 % any entity."""
    got = rendered.groupBy("query_id").agg(F.max("score").alias("best"), F.avg("score").alias("mean"), F.countDistinct("document").alias("docs"), F.bool_or(F.size("entities") > 0).alias("named"))
    points = 100 * (0.4 * F.col("best") + 0.3 * F.col("mean") + 0.15 * F.least(F.col("docs") / 3, F.lit(1.0)) + 0.15 * F.col("named").cast("int"))
    # No blocks, no points; least() alone would take the cap for them.
    capped = F.least(F.coalesce(points, F.lit(0.0)), F.lit(100.0))
    own = queries.select("query_id").join(got, "query_id", "left").select("query_id", F.round(F.round(capped, 6), 1).alias("percentage"), capped.alias("__p"))
    return own.select("query_id", F.when(F.col("__p") >= 80, "High").when(F.col("__p") >= 50, "Medium").otherwise("Low").alias("label"), "percentage")


def error_class(message: Column) -> Column:
    low = F.lower(message)
    has = lambda *words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
    return (
        F.when(has("connection", "refused", "unreachable"), "connection")
        .when(has("timeout", "timed out"), "timeout")
        .when(has("not found") & has("model"), "model_not_found")
        .when(has("context") & has("overflow", "exceed", "too large"), "context_overflow")
        .otherwise("connection")
    )


def retryable(kind: Column) -> Column:
    return kind.isin("connection", "timeout")


_RULE = "-" * 60
#: Figures of an answer: seconds of retrieval and generation, tokens in and out, and who answered.
METADATA = ("retrieval_time", "generation_time", "prompt_tokens", "completion_tokens", "model_name")


def _figures(answers: DataFrame) -> list[Column]:
    """The lines on time, tokens and model, if the answers know them."""
    if not set(METADATA) <= set(answers.columns):
        return []
    ms = lambda *c: sum((F.col(x) for x in c[1:]), F.col(c[0])) * 1000
    return [
        F.format_string("Retrieval: %.0fms | Generation: %.0fms | Total: %.0fms", ms("retrieval_time"), ms("generation_time"), ms("retrieval_time", "generation_time")),
        F.format_string("Tokens: %d prompt + %d completion = %d total", F.col("prompt_tokens").cast("bigint"), F.col("completion_tokens").cast("bigint"), (F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint")),
        F.concat(F.lit("Model: "), "model_name"),
    ]


def _sources(title: str) -> Column:
    one = lambda c: F.concat(F.lit("  "), c["document"], F.lit(" (Page "), c["page"].cast("string"), F.lit(")"), F.when(c["section"] != "", F.concat(F.lit(" | Section: "), c["section"])).otherwise(""))
    return F.when(F.size("sources") > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(F.transform("sources", one), "\n")))


def _foot(answers: DataFrame) -> list[Column]:
    figures = _figures(answers)
    return [_sources("Sources"), F.lit(""), F.format_string("Confidence: %s (%.0f%%)", "label", "percentage"), *figures, F.lit(_RULE if figures else "\n" + _RULE)]


def console_text(answers: DataFrame) -> DataFrame:
    """query_id, text of ``answers(query_id, question, mode, answer, sources array<struct<document,page,section>>, label, percentage)`` and, if it has them, METADATA."""
    text = F.concat_ws("\n", F.concat(F.lit("Question: "), "question"), F.lit(""), F.concat(F.lit("Answer ["), "mode", F.lit("]")), "answer", *_foot(answers))
    return answers.select("query_id", text.alias("text"))


def stream_texts(answers: DataFrame) -> DataFrame:
    """query_id, header and footer: what stands before and after an answer that is shown as it comes."""
    header = F.concat(F.lit("Question: "), "question", F.lit("\n\nAnswer ["), "mode", F.lit("]:\n"))
    return answers.select("query_id", header.alias("header"), F.concat_ws("\n", *_foot(answers)).alias("footer"))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """One row: how many questions, mean seconds of generation and in all, mean confidence, completion tokens, and the model (the greatest name)."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return answers.agg(F.count(F.lit(1)).alias("total_questions"), mean(F.col("generation_time")).alias("avg_generation_time"), mean(F.col("retrieval_time") + F.col("generation_time")).alias("avg_total_latency"), mean(F.col("percentage")).alias("avg_confidence"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.max("model_name"), F.lit("")).alias("model_name"))


def extract_answer(prompt: str) -> str:
    """The generator without a model: the first line of the first text of the context."""
    _, _, rest = prompt.partition("<text>\n")
    return rest.split("\n", 1)[0] or "The context does not say."


def generate(made: DataFrame, generator: Callable[[str], str] = extract_answer, retries: int = 3, delays: tuple[float, ...] = (1, 4, 10)) -> DataFrame:
    """query_id, answer, error: the generator runs in the tasks, with retries for lost connections and timeouts only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(prompt: str) -> tuple[str | None, str | None]:
            for k in range(retries):
                try:
                    said = generator(prompt)
                    if not said:
                        raise ValueError("empty response")
                    return said, None
                except (ConnectionError, TimeoutError) as e:
                    if k == retries - 1:
                        return None, str(e)
                    time.sleep(delays[min(k, len(delays) - 1)])
                except Exception as e:
                    return None, str(e)
            return None, "no attempt"

        for f in frames:
            got = [ask(p) for p in f["prompt"]]
            yield pd.DataFrame({"query_id": f["query_id"], "answer": [a for a, _ in got], "error": [e for _, e in got]})

    return made.select("query_id", "prompt").mapInPandas(run, "query_id bigint, answer string, error string")


# Clients -----------------------------------------------------------------------------------------------------------------


class Client(Protocol):
    """What answers prompts: the tokens of one answer, in order. Lost connections and timeouts raise ConnectionError and TimeoutError."""

    def stream(self, prompt: str, **options) -> Iterator[str]: ...


class ExtractClient:
    """The client without a model: the words of ``extract_answer``."""

    def stream(self, prompt: str, **options) -> Iterator[str]:
        words = extract_answer(prompt).split(" ")
        yield words[0]
        yield from (f" {w}" for w in words[1:])


#: Options of a request unless it has its own (fixed values).
OPTIONS = {"temperature": 0.1, "top_p": 0.9, "repeat_penalty": 1.1, "num_ctx": 8192, "num_predict": 2048}


class Engine:
    """A client with options and retries: only lost connections and timeouts are tried again, an empty answer is an error."""

    def __init__(self, client: Client | None = None, retries: int = 3, delays: tuple[float, ...] = (1, 4, 10), **options):
        self.client, self.retries, self.delays, self.options = client or ExtractClient(), retries, delays, OPTIONS | options

    def generate(self, prompt: str, **options) -> str:
        for k in range(self.retries):
            try:
                said = "".join(self.client.stream(prompt, **(self.options | options)))
                if not said:
                    raise ValueError("empty response")
                return said
            except (ConnectionError, TimeoutError):
                if k == self.retries - 1:
                    raise
                time.sleep(self.delays[min(k, len(self.delays) - 1)])
        raise ValueError("no attempt")

    def stream(self, prompt: str, **options) -> "TokenStream":
        return TokenStream(self.client.stream(prompt, **(self.options | options)))


class TokenStream:
    """The tokens of one answer as they come, with their number and the text so far."""

    def __init__(self, tokens: Iterator[str]):
        self._tokens, self.count, self.parts = iter(tokens), 0, []

    def __iter__(self) -> Iterator[str]:
        for t in self._tokens:
            if t:
                self.count += 1
                self.parts.append(t)
                yield t

    @property
    def text(self) -> str:
        return "".join(self.parts)


def stream_answers(made: DataFrame, engine: Engine | None = None) -> Iterator[tuple[int, TokenStream]]:
    """query_id and token stream for each prompt, one after the other on the driver, which holds one prompt at a time."""
    own = engine or Engine()
    for r in made.select("query_id", "prompt").orderBy("query_id").toLocalIterator():
        yield r["query_id"], own.stream(r["prompt"])
