"""Pages of uploaded documents, by a table function that each document is joined with."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = "page_no int, start int, page string"


class PagesOf:
    """Rows of page_no (from 1), start (in characters, from 0) and page for a text: pages end at form feeds, and one longer than `size` characters goes on on the next."""

    def eval(self, text: str | None, size: int) -> Iterator[tuple[int, int, str]]:
        number, start = 0, 0
        for part in (text or "").split("\f") if text else ():
            for lo in range(0, len(part), size) or (0,):
                number += 1
                yield number, start + lo, part[lo : lo + size]
            start += len(part) + 1


def paged(docs: DataFrame, key: list[str], size: int = 3_000) -> DataFrame:
    """key, page_no, start, page of docs(key, text); the text of a service that reads PDF files has a form feed behind each page.

    Null and empty texts have no pages; an empty page between two form feeds is a page; repeated rows have their pages each.
    """
    spark = docs.sparkSession
    pages = F.udtf(PagesOf, returnType=PAGE)
    spark.udtf.register("evidara_pages", pages)
    docs.select(*key, "text").createOrReplaceTempView("evidara_paged")
    names = ", ".join(f"d.`{k}`" for k in key)
    return spark.sql(f"SELECT {names}, p.page_no, p.start, p.page FROM evidara_paged d, LATERAL evidara_pages(d.text, {int(size)}) p")
