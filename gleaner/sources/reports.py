"""Reports made in the pass that writes: aggregates observed on the way, gathered in one JSON document."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from gleaner.sources.durable import write_text


class Report:
    """report = Report(); report.watch("corpus", df, n=F.count("*")).write...; report.save(spark, path)

    Numbers of a section are known once its rows were written (or otherwise used up); nothing is read for them.
    """

    def __init__(self):
        self.sections: dict[str, Observation] = {}

    def watch(self, section: str, df: DataFrame, **numbers: Column) -> DataFrame:
        """df, observed: each number is an aggregate over all of its rows."""
        if section in self.sections:
            raise ValueError(section)
        self.sections[section] = Observation(section)
        return df.observe(self.sections[section], *(c.alias(n) for n, c in numbers.items()))

    def numbers(self) -> dict[str, dict]:
        """By section; waits for the sections whose rows are still being written."""
        return {name: dict(seen.get) for name, seen in self.sections.items()}

    def save(self, spark: SparkSession, path: str) -> None:
        write_text(spark, path, json.dumps(self.numbers(), indent=1, ensure_ascii=False, default=str))

    def say(self) -> str:
        """The document as lines of text."""
        return "\n".join(f"{section}: " + ", ".join(f"{n} {v}" for n, v in numbers.items()) for section, numbers in self.numbers().items())
