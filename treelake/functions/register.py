"""The functions that SQL text can use: scalar functions and a table function."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from treelake.functions import digests, text, urls
from treelake.html.compile import compile_page, flatten
from treelake.sources import readers


class PageElements:
    """Rows of ``page_elements(html, url)``: the elements of a page in pre-order."""

    def eval(self, html: str, url: str):
        som = compile_page(html, url)
        for at, (region, depth, via, e) in enumerate(flatten(som["regions"])):
            attrs = json.dumps(e["attrs"], ensure_ascii=False, sort_keys=True) if "attrs" in e else None
            yield region, at, depth, via, e["id"], e["role"], e.get("text"), e.get("label"), attrs


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session."""
    for name, f in {"normalize_text": text.normalize, "outbound_policy": urls.outbound_policy, "action_key": digests.action_keys, "xxh3": digests.xxh3, "decode_body": readers.decoded}.items():
        spark.udf.register(name, f)
    rows = "region_ord int, el_ord int, depth int, via string, id string, role string, text string, label string, attrs string"
    spark.udtf.register("page_elements", udtf(PageElements, returnType=rows))
