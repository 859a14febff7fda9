"""Extraction of a thread's pieces as a table function (H4, H6): one call a batch, one answer a piece.

The function gets a thread's pieces in order, joins them to numbered batches, and calls the model once for
each. A piece that the answer does not name gets an empty document, so that answers never shift from one
piece to another; a batch whose answer cannot be read is asked once more and then marked as failed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

#: Pieces of a thread that go into one call.
BATCH = 12


def prompt(pieces: list[str]) -> str:
    """Pieces under the marks that answers refer to them by."""
    return "\n\n".join(f"[S{i}]\n{p}" for i, p in enumerate(pieces))


def by_place(answer: str, n: int) -> list[dict]:
    """A document for each of ``n`` pieces; of documents for one piece the first counts, and missing ones are empty."""
    found: dict[str, dict] = {}
    for doc in json.loads(answer).get("docs") or []:
        found.setdefault(str(doc.get("source_id", "")).strip(), doc)
    docs = [found.get(f"S{i}") or found.get(str(i)) or {} for i in range(n)]
    return [{k: v for k, v in d.items() if k != "source_id"} for d in docs]


def thread_extraction(complete: Callable[[str], str], thread: str, place: str, text: str, batch: int = BATCH, tries: int = 2):
    """A table function for ``extract``; ``analyze`` asks for the thread's rows together and in order."""

    class Extraction:
        def __init__(self, analyzed: AnalyzeResult | None = None) -> None:
            self.thread, self.held = None, []

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the pieces have to be a table")
            kinds = {f.name: f.dataType for f in rows.dataType.fields}
            fields = [(thread, kinds[thread]), (place, kinds[place]), ("call", T.IntegerType()), ("doc", T.StringType()), ("is_padded", T.BooleanType()), ("is_failed", T.BooleanType())]
            schema = T.StructType([T.StructField(n, k) for n, k in fields])
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn(thread)], orderBy=[OrderingColumn(place)])

        def eval(self, row) -> Iterator[tuple]:
            if self.held and row[thread] != self.thread:
                yield from self.ask()
            self.thread = row[thread]
            self.held.append((row[place], row[text] or ""))

        def terminate(self) -> Iterator[tuple]:
            yield from self.ask()

        def ask(self) -> Iterator[tuple]:
            for call, at in enumerate(range(0, len(self.held), batch)):
                own = self.held[at : at + batch]
                docs = self.answer([t for _, t in own])
                for (p, _), doc in zip(own, docs or [{}] * len(own)):
                    said = json.dumps(doc, ensure_ascii=False, sort_keys=True) if doc else None
                    yield self.thread, p, call, said, not doc, docs is None
            self.held = []

        def answer(self, pieces: list[str]) -> list[dict] | None:
            for _ in range(tries):
                try:
                    return by_place(complete(prompt(pieces)), len(pieces))
                except ValueError:
                    continue
            return None

    return udtf(Extraction)


def extract(pieces: DataFrame, complete: Callable[[str], str], thread: str, place: str, text: str, batch: int = BATCH) -> DataFrame:
    """(thread, place, call, doc as JSON, is_padded, is_failed), one row a piece, whatever the model leaves out.

    A thread's pieces meet in one task and are held there; pieces without a thread are one thread. An
    answer that is no JSON is asked for once more; other errors of the model go up. NULL texts are empty
    pieces. The answers should be stored before they are used twice.
    """
    fn = thread_extraction(complete, thread, place, text, batch)
    return fn(pieces.select(thread, place, text).asTable())


def fields_of(answers: DataFrame, schema: str) -> DataFrame:
    """The answers with a document's fields as columns."""
    parsed = answers.withColumn("_d", F.from_json("doc", schema))
    return parsed.select(*[c for c in answers.columns if c != "doc"], "_d.*")
