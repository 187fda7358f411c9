"""The engine's functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quarry.functions import chunking as C

_CHUNKS = T.StructType([T.StructField("chunk_index", T.LongType()), T.StructField("chunk_text", T.StringType())])


class _Cutter:
    """A table function over one text: what comes out is known before it runs, and its constants are checked then."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError(f"the text is a {text.dataType.simpleString()}")
        for name, arg in (("size", size), ("overlap", overlap)):
            if not arg.isConstantExpression or arg.value is None:
                raise ValueError(f"{name} must be a constant")
        if not 0 <= overlap.value < size.value:
            raise ValueError("overlap must be at least 0 and less than the size")
        return AnalyzeResult(_CHUNKS)

    def eval(self, text, size, overlap):
        yield from enumerate(self.cut(text, size, overlap))


class RecursiveChunks(_Cutter):
    cut = staticmethod(C.recursive_cuts)


class TextPages(_Cutter):
    """Pages of `size` characters that end at a line break of the next `overlap` ones where there is one."""

    cut = staticmethod(C.page_cuts)


def register(spark: SparkSession) -> None:
    """recursive_chunks and text_pages as table functions (text, size, overlap or search), for LATERAL in SQL."""
    for name, cutter in (("recursive_chunks", RecursiveChunks), ("text_pages", TextPages)):
        spark.udtf.register(name, F.udtf(cutter))

