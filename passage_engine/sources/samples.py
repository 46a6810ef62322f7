"""Small files of every format that is read without other programs, to try the readers with, and a small evaluation set."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BOOK = '<workbook xmlns:r="urn:r"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>'
_RELS = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def contents(words: str) -> dict[str, bytes]:
    """Extension to a file that holds the words and the heading ``Title``."""
    x = escape(words)
    return {
        "txt": f"Title\n{words}".encode(),
        "html": f"<title>Title</title><script>var a = '<p>';</script><p>{x}</p>".encode(),
        "xml": f"<a><b>Title</b><c>{x}</c></a>".encode(),
        "csv": f"Title,words\n1,{words}\n,\n".encode("utf-8-sig"),
        "tsv": f"Title\twords\n1\t{words}\n".encode(),
        "json": json.dumps({"n": 1, "title": "Title", "parts": [{"body": words}, None, True]}).encode(),
        "rtf": (r"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}Title\par " + words + "}").encode("latin1"),
        "docx": _archive({"word/document.xml": f"<w:p>Title</w:p><w:p>{x}</w:p>"}),
        "pptx": _archive({"ppt/slides/slide10.xml": f"<a:p>{x}</a:p>", "ppt/slides/slide2.xml": "<a:p>Title</a:p>"}),
        "odt": _archive({"content.xml": f"<text:h>Title</text:h><text:p>{x}</text:p>"}),
        "xlsx": _archive({"xl/workbook.xml": _BOOK, "xl/_rels/workbook.xml.rels": _RELS, "xl/sharedStrings.xml": f"<sst><si><t>{x}</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row></worksheet>'}),
        "epub": _archive({
            "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>',
            "O/c.opf": '<package xmlns:dc="urn:dc"><metadata><dc:title>Title</dc:title></metadata><manifest><item id="a" href="a%20b.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>',
            "O/a b.xhtml": f"<p>{x}</p>",
        }),
        "doc": b"old",
    }


def files(name: Column | str, words: Column) -> Column:
    """Map of file names, made of a column and the kinds' extensions, to bytes."""

    @F.pandas_udf("map<string,binary>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, bodies in batches:
            yield pd.Series([{f"{n}.{k}": v for k, v in contents(w or "").items()} for n, w in zip(names, bodies, strict=True)])

    return run((F.col(name) if isinstance(name, str) else name).cast("string"), words)


def evaluation_set(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, judgements) of three texts and four questions, each answered by one text."""
    bodies = {
        "bread": ("Rye dough rests overnight in the cellar. A sour starter is fed with flour and water twice a day. ", ["When does the rye dough rest?", "What is the starter fed with?"]),
        "clock": ("The tower clock is wound by hand each Monday. Its pendulum swings behind an oak panel. ", ["Who winds the tower clock?"]),
        "river": ("Salmon climb the weir in October. Wardens count them at a glass pane below the mill. ", ["Where do wardens count salmon?"]),
    }
    corpus = [(k, t * 12) for k, (t, _) in bodies.items()]
    asked = [(f"{k}-{n}", q, k) for k, (_, qs) in bodies.items() for n, q in enumerate(qs)]
    return (
        spark.createDataFrame(corpus, "doc_id string, text string"),
        spark.createDataFrame([r[:2] for r in asked], "query_id string, query string"),
        spark.createDataFrame([(r[0], r[2]) for r in asked], "query_id string, id string"),
    )
