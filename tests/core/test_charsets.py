"""Documents written in several charsets are read in the one they were written in."""

import pytest

from ledgerline.sources import charsets as C

from ..conftest import SMALL

LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Letters of other scripts that stand for Latin ones, so that words keep their lengths and repeats.
SCRIPTS = {
    "cp1251": "абцдефгхийклмнопярстувжыьз", "koi8_r": "абцдефгхийклмнопярстувжыьз", "cp1253": "άβψδέφγηίξκλμνόπθρστύωςχυζ",
    "shift_jis": "あきくけこしすせそたちつてとなにぬねのはひふまやらん", "euc_jp": "あきくけこしすせそたちつてとなにぬねのはひふまやらん",
    "gb18030": "的一是不了人我在有他这为之大来以个中上们到说国和地", "big5": "的一是不了人我在有他這為之大來以個中上們到說國和地", "euc_kr": "가나다라마바사아자차카타파하고노도로모보소오조초코토",
}


def written(text, charset):
    letters = SCRIPTS.get(charset)
    if letters:
        text = text.lower().translate({ord(a): letters[i % len(letters)] for i, a in enumerate(LATIN)})
    return text.encode(charset, "ignore").decode(charset), text.encode(charset, "ignore")


@pytest.mark.parametrize("charset", ["cp1252", "mac_roman", "cp437", *SCRIPTS])
def test_documents_are_recovered(spark, charset):
    """Of the documents that are not plain ASCII at least 97 of 100 are read as they were written (nearly all in each charset)."""
    docs = [(r.doc_id, *written(r.text, charset)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null").collect()]
    docs = [d for d in docs if any(b > 127 for b in d[2])]
    got = {r.k: r.text for r in C.with_charset(spark.createDataFrame([(i, bytearray(b)) for i, _, b in docs], "k long, content binary"), "k").collect()}
    right = sum(got[i] == text for i, text, _ in docs)
    assert len(docs) > 50 and right >= 0.97 * len(docs), (right, len(docs))


def test_edges(spark):
    rows = [(1, None), (2, bytearray()), (3, bytearray(b"plain")), (4, bytearray("é".encode())), (5, bytearray("Crème brûlée à la façon".encode("cp1252")))]
    got = {r.k: (r.charset, r.text) for r in C.with_charset(spark.createDataFrame(rows, "k long, content binary"), "k").collect()}
    assert got == {1: (None, None), 2: ("utf-8", ""), 3: ("utf-8", "plain"), 4: ("utf-8", "é"), 5: ("cp1252", "Crème brûlée à la façon")}


@pytest.mark.parametrize("text,charset", [("的 的 的 的", "big5"), ("фр ер фр ер", "koi8_r"), ("анен. анен. анен.", "koi8_r"), ("ергеер ергеер", "koi8_r")])
def test_texts_of_one_word_repeated(text, charset):
    """Readings in letters beside those of a charset's languages cost more; of readings that cost the same the likelier charset's counts."""
    assert text.encode(charset).decode(C.guessed(text.encode(charset))) == text
