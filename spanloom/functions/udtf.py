"""SQL surface: a table function that extracts facts from one text, for LATERAL joins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from spanloom.operators.local import LocalParser
from spanloom.plans.grammar import Compiled, Node


def register_extract(spark: SparkSession, name: str, grammar: Node) -> None:
    """SELECT ... FROM docs, LATERAL <name>(text): match_no, byte_start, byte_stop, text, name, fields."""
    compiled = Compiled(grammar)

    class Extract:
        def __init__(self):
            self.parser = LocalParser(compiled)

        def eval(self, text: str):
            for i, m in enumerate(self.parser.findall(text or "")):
                record = m.fact()
                yield i, *m.span, m.text, record and record.name, record and record.fields_json()

    columns = "match_no int, byte_start int, byte_stop int, text string, name string, fields string"
    spark.udtf.register(name, udtf(Extract, returnType=columns))
