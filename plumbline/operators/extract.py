"""Records from prompts by a pluggable client: fallback chain, retries, one re-prompt, validation."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.specs import resolve_attribute
from ..functions.text import strip_code_fences
from ..sources import tables
from .constraints import RECORD, faults, told

TRANSIENT = frozenset({429, 500, 502, 503, 504})


class ClientError(Exception):
    """A failure of a client; `status` where the provider gave one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


class Retrying:
    """Up to `attempts` tries on transient statuses, with growing pauses; an empty answer is an error."""

    def __init__(self, client: Client, attempts: int = 3, pause: float = 1.0):
        self.client, self.attempts, self.pause = client, attempts, pause

    def complete(self, prompt: str) -> str:
        for k in range(self.attempts):
            try:
                answer = self.client.complete(prompt)
            except ClientError as error:
                if error.status not in TRANSIENT or k + 1 == self.attempts:
                    raise
                time.sleep(self.pause * (k + 1))
                continue
            if not answer:
                raise ClientError("empty answer")
            return answer
        raise ClientError("no attempt was made")


@dataclass(frozen=True)
class Attempt:
    """One client's try at a prompt: its answer, or its error and status."""

    client: str
    answer: str | None = None
    error: str | None = None
    status: int | None = None


def attempts(clients: Iterable[Client], prompt: str) -> Iterator[Attempt]:
    """A row for each client in turn, worked out when it is asked for."""
    for client in clients:
        label = type(client).__name__
        try:
            row = Attempt(label, answer=client.complete(prompt))
        except ClientError as problem:
            row = Attempt(label, error=str(problem), status=problem.status)
        yield row


def first_answer(rows: Iterable[Attempt]) -> tuple[str | None, list[Attempt]]:
    """The first answer among the rows, which are read no further, and the failures before it."""
    failed: list[Attempt] = []
    found = next((row.answer for row in rows if row.answer is not None or failed.append(row)), None)
    return found, failed


class Fallback:
    """A client over several: the first that answers counts; if none does, its error names each one's error and carries the last status."""

    def __init__(self, clients: Sequence[Client]):
        if len(clients) == 0:
            raise ValueError("at least one client is needed")
        self.clients = tuple(clients)

    def complete(self, prompt: str) -> str:
        answer, failed = first_answer(attempts(self.clients, prompt))
        if answer is None:
            raise ClientError("; ".join(f"{row.client}: {row.error}" for row in failed), failed[-1].status)
        return answer


class ChatClient:
    """A provider that answers chat requests as JSON over HTTP: {"model", "messages"} in, the first choice's message out.

    A status of 400 or more, a refused connection and an answer of another form are errors of the client.
    """

    def __init__(self, url: str, model: str, key: str = "", seconds: float = 60.0):
        self.url, self.model, self.key, self.seconds = url, model, key, seconds

    def complete(self, prompt: str) -> str:
        asked = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, asked, headers), timeout=self.seconds) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as problem:
            raise ClientError(f"status {problem.code}", problem.code) from problem
        except OSError as problem:
            raise ClientError(str(problem)) from problem
        except (ValueError, LookupError, TypeError) as problem:
            raise ClientError(f"unexpected answer: {problem}") from problem


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """The session's plumbline.<name>, or the default."""
    return spark.conf.get(f"plumbline.{name}", default)


def default_chain(spark: SparkSession) -> Callable[[], Client]:
    """What makes the chain of the session's providers on an executor: the first is tried again on transient statuses, others once.

    plumbline.providers names them in order, separated by commas; each has plumbline.<name>.url and .model, and may have .key and
    .attempts. A provider without a url is left out; without any there is an error.
    """
    found = []
    for name in (x.strip() for x in (setting(spark, "providers", "") or "").split(",")):
        url = setting(spark, f"{name}.url") if name else None
        if url:
            tries = int(setting(spark, f"{name}.attempts", "1" if found else "3"))
            found.append((url, setting(spark, f"{name}.model", "") or "", setting(spark, f"{name}.key", "") or "", tries))
    if not found:
        raise ValueError("no provider is set: name them in plumbline.providers, each with plumbline.<name>.url")

    def make() -> Client:
        return Fallback([Retrying(ChatClient(url, model, key), attempts=tries) if tries > 1 else ChatClient(url, model, key) for url, model, key, tries in found])

    return make


class KeyValueClient:
    """A deterministic client: `key: value` lines of the prompt's blocks become specifications."""

    LINE = re.compile(r"^(?:\[(?P<block>b\d{4,})\] \w+(?: \([^)]*\))?: )?(?P<key>[A-Za-z][A-Za-z ]*): (?P<value>.+)$")

    def complete(self, prompt: str) -> str:
        block, name, specs = None, None, []
        for line in prompt.split("Content blocks:\n")[-1].splitlines():
            if m := self.LINE.match(line):
                block = m["block"] or block
                if m["key"].lower() in ("name", "product name"):
                    name = name or m["value"].strip()
                else:
                    specs.append({"attribute": m["key"], "value": m["value"].strip(), "unit": None, "confidence": 0.9, "status": "extracted", "source": {"type": "document", "reference": block}})
        return json.dumps({"product_name": name or "", "specifications": specs})


_STR, _SPECS = "string", "array<struct<attribute: string, value: string, unit: string, status: string, reference: string>>"


def record_fields(value: Column) -> list[Column]:
    """The columns of a record, from a variant that has no faults: those that feeds take and its specifications, canonical names where they are known."""
    at = lambda path, kind=_STR, v=value: F.try_variant_get(v, path, kind)

    def spec(x: Column) -> Column:
        name = at("$.attribute", v=x)
        return F.struct(F.coalesce(resolve_attribute(name), name).alias("attribute"), at("$.value", v=x).alias("value"), at("$.unit", v=x).alias("unit"), F.coalesce(at("$.status", v=x), F.lit("extracted")).alias("status"), at("$.source.reference", v=x).alias("reference"))

    price = F.struct(at("$.commercial.price.value", "double").alias("value"), at("$.commercial.price.currency").alias("currency"))
    specs = F.transform(F.coalesce(at("$.specifications", "array<variant>"), F.array().cast("array<variant>")), spec)
    return [
        at("$.product_name").alias("product_name"), at("$.product_id").alias("product_id"), at("$.brand").alias("brand"), F.coalesce(at("$.description"), F.lit("")).alias("description"),
        F.struct(F.coalesce(at("$.category.predicted"), F.lit("")).alias("predicted"), F.coalesce(at("$.category.confidence", "double"), F.lit(0.0)).alias("confidence")).alias("category"),
        F.struct(*(at(f"$.identifiers.{k}").alias(k) for k in ("sku", "gtin", "mpn"))).alias("identifiers"), F.coalesce(at("$.media.images", "array<string>"), F.array().cast("array<string>")).alias("images"),
        F.when(at("$.commercial.price.value", "double").isNotNull() | at("$.commercial.price.currency").isNotNull(), price).alias("price"), at("$.commercial.availability").alias("availability"), specs.alias("specifications"),
    ]


def ask(prompts: DataFrame, make_client: Callable[[], Client], doc: str) -> DataFrame:
    """(doc, prompt, answer, error) of each prompt, by one client a task; a client's error is the row's. A null prompt is an empty one."""
    schema = f"`{doc}` {dict(prompts.dtypes)[doc]}, prompt string, answer string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            rows = [first_answer(attempts([client], prompt or "")) for prompt in batch.column(1).to_pylist()]
            columns = [pa.array([answer for answer, _ in rows], pa.string()), pa.array([failed[0].error if failed else None for _, failed in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[doc, "prompt", "answer", "error"])

    return prompts.select(doc, "prompt").mapInArrow(run, schema)


def extract_records(prompts: DataFrame, make_client: Callable[[], Client], doc: str = "doc_id", keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc, product_name, specifications, attempts, error, and the other fields that feeds take) of each prompt.

    Answers are held against constraints.RECORD in expressions. One with faults is asked for once more with them; a second
    failure, or a client's error, is the row's `error` and never the task's. `keep` writes a table and reads it back, so that no
    prompt is asked twice for one attempt; by default to the shared folder.
    """
    keep = keep or kept

    good = F.col("answer").isNotNull() & F.col("faults").isNull()
    error = F.coalesce("error", F.concat(F.lit("invalid record: "), F.col("faults")))
    fields = [F.when(good, c).alias(name) for c, name in zip(record_fields(F.col("value")), FIELDS)]

    def judged(answers: DataFrame, tries: int) -> DataFrame:
        """Answers with their faults and fields, written, as a filter on faults would work both out again."""
        value = F.try_parse_json(strip_code_fences(F.col("answer")))
        rows = answers.withColumn("value", value).withColumn("faults", F.when(F.col("answer").isNotNull(), told(faults(F.col("value"), RECORD))))
        return keep(rows.select(doc, *fields, F.lit(tries).alias("attempts"), error.alias("error"), F.when(F.col("faults").isNotNull(), F.col("prompt")).alias("prompt"), "faults"))

    first = judged(keep(ask(prompts, make_client, doc)), 1)
    again = F.concat(F.coalesce("prompt", F.lit("")), F.lit("\n\nThe last answer was not valid ("), F.col("faults"), F.lit("). Answer with one valid JSON object only."))
    second = judged(keep(ask(first.filter("faults is not null").select(doc, again.alias("prompt")), make_client, doc)), 2)
    return first.filter("faults is null").unionByName(second).select(doc, *FIELDS, "attempts", "error")


FIELDS = ["product_name", "product_id", "brand", "description", "category", "identifiers", "images", "price", "availability", "specifications"]


def kept(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back."""
    return tables.kept(df, "answers")
