import numpy as np
import pytest

from lodestrata.llm import prose_quality
from lodestrata.llm.prose_quality import autocorrelation, label_lines, measure, not_prose, periodicity, running, statistics, text_quality

PROSE = [
    "The old reader keeps what it has found, and nobody has to wait for it.",
    "der leser zählt die alten zeilen, bevor der nächste lauf beginnt",
    "LE LECTEUR GARDE LA LISTE DES APPELS, ET PERSONNE NE DOIT ATTENDRE.",
    "El lector guarda la lista\nde llamadas, y nadie\ntiene que esperar\npor ella.",
    "user: Should the reader be the one that waits?\nassistant: It should, because the queue is not empty.",
    "Call `readQueue` first, because the reader of the 12 rows is not ready.",
    "The old reader keeps what it has ::=>>!= found, and nobody has to wait for it.",
    "The old reader keeps it.  Nobody has to wait\nfor the new one.  It is all that the queue has\nto offer.  There is no more of it for us.",
    "Читатель хранит старые записи, и никому не нужно ждать их.",
]
OTHER = [
    "- readQueue\n- writeQueue\n* openFile\n1. packet row",
    "| the | a |\n|-----|---|\n| of  | 1 |\n| to  | 2 |",
    "name    12   0.5\nother   13   0.7\nthird   14   0.9",
    "for (const of in the) {\n  the.push({ of, to: 5 });\n}",
    "2025-06-24T06:32:01Z debug the reader of the queue took=5\n2025-06-24T06:32:02Z debug the reader of it took=5",
    "next next next next next next next next next next",
    "Axnxfvgu nob emvdhogp qhvjso? Dfejic khlz dvvzsdj ujachemjfv.",
    "Home\nSign in\nBack\nNext\nSearch\nSign in",
    "RLYTWx9fOtpJktDtU/pIPlDe+ymr+/ONU9mnBRZXwDf1j+d5Orm9zN3AyD9QSxI8E2umDDt8cCEfGOfLm5I+6vI90XgB6J4IW",
    "c v g m r o g n y r e c b o d l o n o u w m y a i o",
    "[{\"id\": 7, \"the\": 0.4}, {\"id\": 8, \"of\": 0.5}]",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert statistics(text)["kind"] == "prose"


@pytest.mark.parametrize("text", OTHER)
def test_other(text):
    assert statistics(text)["prose_share"] < 0.5 and statistics(text)["kind"] not in ("prose", "empty")


def test_mixture_is_weighed_by_characters():
    table = "\n".join(f"row_{i}_name    {i * 37}   0.{i}" for i in range(20))
    assert 0.1 < statistics(PROSE[0] + "\n\n" + table)["prose_share"] < 0.5
    assert statistics("\n\n".join(PROSE[:2] * 1 + ["- one item"]))["prose_share"] > 0.8


def test_layout_measures():
    assert autocorrelation(np.array([3, 9, 3, 9, 3, 9, 3, 9.0])) > 0.7 and autocorrelation(np.arange(3.0)) == 0
    assert periodicity(np.array([0, 2, 0, 2, 0, 2])) == 1 and periodicity(np.zeros(8)) == 0
    assert label_lines(["a  1", "b  2", "", "- x", "2025-01-01 10:00 y"]) == ["table", "table", "blank", "item", "log"]
    assert not running("")


def test_operator(spark):
    df = spark.createDataFrame([(1, PROSE[0], "a"), (2, OTHER[0], "b"), (3, None, None), (4, "", "d"), (5, " \n\t", "e"), (2, OTHER[0], "b"), (6, "x" * 300_000, "f")], "doc_id long, text string, kind string")
    got = text_quality(df, ["doc_id"])
    assert sorted(r.doc_id for r in not_prose(got).collect()) == [2, 2, 6]
    assert {r.doc_id: r.kind for r in got.collect() if r.kind == "empty"} == {3: "empty", 4: "empty", 5: "empty"}
    assert text_quality(df.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "Klockan stod stilla i köket när barnen kom hem från skolan. Ingen hade dragit upp den sedan i våras.",
        "Zegar stoi w kuchni, a babcia czeka na list z Warszawy. Nikt nie wie, kiedy przyjdzie listonosz.",
        "Kello pysähtyi keittiössä eikä kukaan vetänyt sitä enää. Lapset tulivat kotiin koulusta.",
        "Kubernetes schedules pods onto nodes. Operators watch custom resources. Controllers reconcile desired state.",
        "今日はとても良い天気ですから、公園に行きましょう。",
    ],
)
def test_prose_of_languages_without_a_word_list(text):
    assert statistics(text)["kind"] == "prose"


@pytest.mark.parametrize("text", ["the of and to a in is it that for on with as was be by at this are or from an not but have had", "shard owner branch rest packet owner anchor trace total lease", "next next next next next next"])
def test_heaps_of_words(text):
    assert statistics(text)["prose_share"] < 0.5


LISTS = [
    "\n".join(f"- {a}" for a in ("batch of the limit", "report", "the evidence", "anchor and entry", "policy state", "chunk owner")),
    "name of reader    old queue     the open list\nsecond reader     new queue     a longer list\nthird of them     its queue     no list at all",
    "Anchor ledger p. 137\nProfile of chunks p. 128\nQuota report p. 27\nChunk symbol p. 279\nBucket ledger p. 329",
]


@pytest.mark.parametrize("text", LISTS)
def test_layout_decides(text):
    assert measure([text])["prose_share"][0] < 0.5 <= measure([text], layout=False)["prose_share"][0]


def test_many_texts_at_once_are_as_one_by_one():
    texts = [*PROSE, *OTHER, *LISTS, None, "", "\n\n", " x"]
    together = measure(texts)
    for i, t in enumerate(texts):
        assert {n: v[i] for n, v in together.items()} == {n: v[0] for n, v in measure([t]).items()}


def test_very_long_texts_are_measured_in_segments(monkeypatch):
    monkeypatch.setattr(prose_quality, "LONG_CHARS", 400)
    prose = "".join(f"In the year {i} the old reader kept what it had found, and nobody had to wait for it.\n" for i in range(40))
    table = "".join(f"row_{i}_name    {i * 37}   0.{i}\n" for i in range(200))
    whole = measure([prose, None, table, prose + table, "x" * 2000])
    assert whole["prose_share"][0] > 0.95 and whole["kind"].tolist() == ["prose", "empty", "table", "table", "junk"]
    monkeypatch.undo()
    one = measure([prose, None, table, prose + table])
    assert np.allclose(one["prose_share"], whole["prose_share"][:4], atol=0.05) and one["n_words"].tolist() == whole["n_words"][:4].tolist()
    assert len(measure([])["kind"]) == 0
