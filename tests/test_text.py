import sqlite3

import pytest
from pyspark.sql import functions as F

from passage_engine.functions import chunking, plain, porter, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_tokens_and_terms(spark):
    assert one(spark, text.tokens("a"), a="Café No. 3, x_y") == ["caf", "no", "3", "x", "y"]
    assert one(spark, text.tokens("a"), a=None) == []
    assert one(spark, text.content_terms("a"), a="the Owner of the owner barn") == ["owner", "barn"]
    assert one(spark, text.content_terms("a"), a="What is the what") == ["what", "is", "the"]


def test_normalisation(spark):
    assert one(spark, text.normalize_tag("a"), a="  Two \t　 Words ") == "two words"
    assert len(one(spark, text.normalize_tag("a"), a="x" * 80)) == 64
    assert one(spark, text.normalize_doc_type("a"), a=" Agent-Memories ") == "memory"
    assert one(spark, text.normalize_doc_type("a"), a="") == "document"
    assert one(spark, text.normalize_doc_type("a", allow_empty=True), a="") is None
    with pytest.raises(Exception, match="unknown doc_type"):
        one(spark, text.normalize_doc_type("a"), a="photo")
    assert one(spark, text.safe_filename("a"), a="a/b:c é.md") == "a_b_c é.md"
    assert one(spark, text.safe_filename("a"), a="  ") == "file"
    assert one(spark, text.title_filename("a"), a="My note") == "My note.md"
    assert one(spark, text.title_filename("a"), a="My note.TXT") == "My note.TXT"


def test_html_and_boilerplate(spark):
    raw = "<style>p{}</style><p>A &amp;lt; B</p><script>var t='</p>';</script>\n\n\n<b>C</b>"
    assert one(spark, text.html_text("a"), a=raw) == "A &lt; B \n\n C"
    marked = "x\n*** START OF THE PROJECT GUTENBERG EBOOK T ***\n\nBody here.\n\n*** END OF THE PROJECT GUTENBERG EBOOK T ***\ny"
    assert one(spark, text.without_boilerplate("a"), a=marked) == "Body here."
    assert one(spark, text.without_boilerplate("a"), a="no markers") == "no markers"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Yes. So it is. Mrs. Brown left. Ok.", ["Yes.", "So it is.", "Mrs. Brown left.", "Ok."]),
        ("One two.  Three!\nFour? “Five.” Six", ["One two.", "Three!", "Four?", "“Five.”", "Six"]),
        ("Dr. J. R. Ray saw e.g. this. Mr.\n\nNext", ["Dr. J. R. Ray saw e.g. this.", "Mr.", "Next"]),
        ("", []),
    ],
)
def test_sentences(spark, raw, want):
    assert one(spark, text.sentences("a"), a=raw) == want
    assert plain.sentence_list(raw) == want


def test_stemmer_against_full_text_index():
    words = "running runs flies relational conditional rationally caresses ponies agreed plastered motoring hoping hopped falling filing happy sky digitizer vietnamization feudalism decisiveness hopefulness formaliti sensibiliti triplicate formative electricity goodness revival allowance inference adjustable adoption communism activate probate rate cease controlling roll naïve café as us bus was ies generalization".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61 remove_diacritics 2')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    for w in words:
        db.execute("DELETE FROM t")
        db.execute("INSERT INTO t VALUES (?)", (w,))
        assert porter.index_tokens(w) == [r[0] for r in db.execute("SELECT term FROM v")], w


def test_chunks_overlap_and_fallback(spark):
    sentences = [c * n + "." for c, n in (("a", 880), ("b", 200), ("c", 100))]
    packed = chunking.pack(sentences)
    assert all(len(c) <= 1000 for c in packed)
    assert sum(c.count("a" * 880) for c in packed) == 1
    rows = [(1, "Short note."), (2, " ".join(f"Sentence number {k} is here." for k in range(120))), (3, ""), (4, None)]
    out = chunking.chunk_table(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "chunk_no").collect()
    assert [r["text"] for r in out if r["doc_id"] == 1] == ["Short note."]
    assert {r["doc_id"] for r in out} == {1, 2}
    assert [r["chunk_id"] for r in out if r["doc_id"] == 2][:2] == ["2:0", "2:1"]
    with pytest.raises(ValueError):
        chunking.pack(["x"], 10, 10)


def test_split_text_in_sql(spark):
    chunking.register(spark)
    spark.createDataFrame([("Hello there.",)], "text string").createOrReplaceTempView("notes")
    assert [tuple(r) for r in spark.sql("SELECT chunk_no, chunk FROM notes, LATERAL split_text(notes.text)").collect()] == [(0, "Hello there.")]


def test_content_hash(spark):
    assert one(spark, text.content_hash("a"), a="abc") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert spark.range(1).select(F.lit(1)).count() == 1
