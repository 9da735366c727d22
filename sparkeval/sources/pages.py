"""Line streams -> pages (SRC11 / WIN03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import py_strip
from ..functions.text import col
from ..operators.sampling import distributed_cumsum


def is_page_heading(line) -> F.Column:
    """A level-1 heading after rewriting '= = =' -> '===' and '= =' -> '==' and stripping:
    starts with '= ' and ends with ' ='."""
    r = py_strip(F.replace(F.replace(col(line), F.lit("= = ="), F.lit("===")), F.lit("= ="), F.lit("==")))
    return r.startswith("= ") & r.endswith(" =")


def segment_pages(lines: DataFrame, file: str = "file", line_no: str = "line_no", text: str = "line") -> DataFrame:
    """SRC11: every heading line starts a new page (and belongs to it); pages whose text is
    blank are dropped except the file's last page, which is always kept.
    Output: (file, page_no, page)."""
    flagged = lines.withColumn("_h", is_page_heading(text).cast("long"))
    numbered = distributed_cumsum(flagged, file, [col(line_no)], F.col("_h"), "page_no")
    pages = (numbered.groupBy(file, "page_no")
                     .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(col(line_no).alias("n"),
                                                                                         col(text).alias("t")))),
                                                   lambda s: s["t"]), "\n").alias("page")))
    last = numbered.groupBy(file).agg(F.max("page_no").alias("_last"))
    return (pages.join(last, file)
                 .filter((F.length(py_strip(F.col("page"))) > 0) | (F.col("page_no") == F.col("_last")))
                 .drop("_last"))


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Split a text column into (file, line_no, line) rows (Python ``str.split('\\n')``)."""
    return docs.select(col(id_col).alias("file"),
                       F.posexplode(F.split(col(text_col), "\n", -1)).alias("line_no", "line"))
