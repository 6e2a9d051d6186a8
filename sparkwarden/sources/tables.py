"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import LongType, StringType, StructType

from sparkwarden.sources.framing import MOST, Framer


@udtf
class Deframe:
    """``SELECT * FROM deframe(TABLE(chunks))``: the messages (conn, n, raw) of chunks (conn, seq, data), as ``framing.deframe`` gives them.

    The function itself asks for its table by connection and in order, so a query needn't. An optional second argument is the bytes of a message at most.
    """

    @staticmethod
    def analyze(chunks: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        missing = {"conn", "seq", "data"} - set(chunks.dataType.names if chunks.isTable else [])
        if missing:
            raise ValueError(f"deframe needs a table with the columns {sorted(missing)}")
        schema = StructType().add("conn", StringType()).add("n", LongType()).add("raw", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("conn")], orderBy=[OrderingColumn("seq")])

    def __init__(self):
        self.framer, self.conn, self.n = None, None, 0

    def _rows(self, messages):
        for m in messages:
            yield self.conn, self.n, m.decode("utf-8", "replace")
            self.n += 1

    def eval(self, chunk: Row, most: int = MOST):
        if self.framer is None:
            self.framer, self.conn = Framer(most), chunk["conn"]
        yield from self._rows(self.framer.feed(bytes(chunk["data"])))

    def terminate(self):
        if self.framer is not None:
            yield from self._rows(self.framer.end())


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    spark.udtf.register("deframe", Deframe)
