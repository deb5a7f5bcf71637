"""Titles, numbers, names, incipits and small expressions on hand vectors."""

from pyspark.sql import functions as F

from tonefold.functions import metadata, notes, scores
from tonefold.operators import framing


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_opus_forms(spark):
    rows = [("17", "4"), ("op 31", "nr 2"), ("Opus 120", ""), ("", "6"), ("", ""), ("Posthumous", "5"), ("WoO 59", None), (None, None), ("op.5b", "no.12")]
    found = values(spark, rows, "a string, b string", metadata.opus_form(F.col("a"), F.col("b")))
    assert [x for x, in found] == ["Op. 17 No. 4", "Op. 31 No. 2", "Op. 120", "No. 6", "", "Posthumous No. 5", "WoO 59", "", "Op. 5b No. 12"]


def test_works_in_texts(spark):
    texts = ["Three Mazurkas, opus 59 nr. 2, for two hands", "Quintet no. 3 (Op.44b)", "Op. 5; No. 7 is another", "OP. 11,NO. 4", "Rondo alla turca", "", None, "hop 3, shop 4", "Trio op. 70 no. 1 and op. 97"]
    assert [x for x, in values(spark, [(t,) for t in texts], "t string", metadata.opus(F.col("t")))] == ["Op. 59 No. 2", "Op. 44b", "Op. 5", "Op. 11 No. 4", "", "", "", "", "Op. 70 No. 1"]
    texts = ["Suite in D, BWV  1012", "Concerto (Hob. XVIII:11), slow", "Variations K.265, after a song", "Deutsche Tänze D 783", "woo 39", "Sonata 14", None, "Sz. 107 and BB 105"]
    assert [x for x, in values(spark, [(t,) for t in texts], "t string", metadata.catalogue(F.col("t")))] == ["BWV 1012", "Hob. XVIII:11", "K.265", "D 783", "woo 39", "", "", "Sz. 107"]


def test_composers(spark):
    rows = [("E. Satie",), ("Grieg, Edvard Hagerup",), ("Rachmaninov, S.",), ("Ludwig van Beethoven",), ("Clara Wieck (1819-1896)",), ("Dvořák, Antonín",), ("Joh. Seb. Bach Jr.",), (None,)]
    found = values(spark, rows, "n string", metadata.composer(F.col("n")), metadata.composer_key(F.col("n")))
    assert found == [("Erik Satie", "satie"), ("Edvard Grieg", "grieg"), ("Sergei Rachmaninoff", "rachmaninov"), ("Ludwig van Beethoven", "beethoven"), ("Clara Wieck", "wieck"), ("Antonín Dvořák", "dvorak"), ("Johann Sebastian Bach", "bach"), ("", "")]
    assert values(spark, [("Łódź ﬁn ÅÉ Việt",)], "t string", metadata.decomposed(F.col("t")), metadata.folded(F.col("t"))) == [("łodz fin ae viet", "łodz ﬁn ae viet")]


def test_titles(spark):
    rows = [("Bagatelle, Op. 33, No. 4", None, "Op. 33 No. 4", "", "Andante"), ("24 Caprices", "24 Caprices", "Op. 1", "MS 25", None), ("", "", "", "", ""), ("Badinerie", "Ouverture", "", "BWV 1067", "badinerie")]
    found = values(spark, rows, "t string, p string, o string, c string, m string", metadata.display(*map(F.col, "tpocm")))
    assert [x for x, in found] == ["Bagatelle, Op. 33, No. 4 - Andante", "24 Caprices, Op. 1, MS 25", "(untitled)", "Ouverture: Badinerie, BWV 1067"]
    labels = values(spark, [("C", "W", "9", "2"), ("C", "", None, "2"), (None, "W", "", "")], "c string, w string, o string, n string", metadata.theme_label(*map(F.col, "cwon")))
    assert [x for x, in labels] == ["C, W, Op. 9 No. 2", "C, No. 2", "W"]
    assert values(spark, [("op. 58",), ("Opus 3",), (" 7 ",), ("op.",)], "o string", metadata.opus_number(F.col("o"))) == [("58",), ("3",), ("7",), (None,)]


def test_licences_of_scores(spark):
    rows = [("Creative Commons Attribution-ShareAlike", None), ("CC BY-NC 4.0", None), ("", "Public Domain"), (None, None), ("cc-by 3", None), ("all rights", None)]
    found = values(spark, rows, "a string, b string", *metadata.licence(F.col("a"), F.col("b")))
    assert [ok for _, ok in found] == [True, False, True, False, True, False] and found[3][0] == "unstated" and found[2][0] == "Public Domain"


def test_numbers(spark):
    row = values(spark, [([1.0, 2.5, 2.5],)], "o array<double>", metadata.durations(F.col("o")), metadata.numbers_text(F.array(F.lit(1), F.lit(2))), metadata.numbers_of(F.lit("3,4,x"), "int"))[0]
    assert row == ([1.5, 0.0, 0.0], "1,2", [3, 4, None])
    assert [x for x, in values(spark, [("true",), ("-7",), ("1.5",), ("x",)], "t string", metadata.typed(F.col("t")))] == ["boolean", "integer", "number", "text"]
    assert values(spark, [(1,)], "x int", metadata.cite(F.lit("C"), F.lit("W"), F.lit("s"), F.lit("CC0"))) == [("C, W [s; CC0]",)]


def test_small_note_expressions(spark):
    contact = values(spark, [(0.0,), (64.0,), (127.0,)], "v double", F.round(notes.pedal_contact(F.col("v")), 3), F.round(notes.pedal_contact(F.col("v"), scale=0.0), 3), notes.pedal_contact(F.col("v"), knee=0.0, leak=0.0))
    assert contact == [(1.0, 1.0, 1.0), (0.691, 1.0, 1.0), (0.02, 1.0, 0.0)]
    assert values(spark, [(bytes.fromhex("903C0a"),)], "b binary", notes.hex_bytes(F.col("b"))) == [("90 3c 0a",)]
    assert values(spark, [(21,), (108,), (20,)], "n int", notes.key_index(F.col("n")), notes.note_of_key(notes.key_index(F.col("n")))) == [(0, 21), (87, 108), (None, None)]
    assert values(spark, [("G G F E D C B C D G",), ("C4 F# Bb5 a",), ("C F#",)], "m string", notes.spelled(F.col("m"))) == [([67, 67, 65, 64, 62, 60, 59, 60, 62, 67],), ([60, 54, 82, 81],), ([60, 54],)]
    assert values(spark, [(5,), (5_000_000,), (2_500_000_000,)], "n long", notes.duration_text(F.col("n"))) == [("5 ns",), ("5.000 ms",), ("2.500 s",)]
    lengths = values(spark, [(x,) for x in (0x90, 0xC0, 0xF1, 0xF2, 0xF4, 0xF5, 0xF7, 0xF0, 0xF8, 0x40)], "s int", notes.message_length(F.col("s")))
    assert [n for n, in lengths] == [3, 2, 2, 3, None, None, None, None, 1, None]


def test_classes_of_messages(spark):
    data = ["903C64", "B04005", "C005", "F07E01F7", "F07E01", "F8", "F4", "F9", "90", "3C", "", "F23040"]
    kinds = values(spark, [(bytes.fromhex(x),) for x in data], "b binary", framing.classify(F.col("b"))[0])
    assert [k for k, in kinds] == ["note_on", "control", "program", "system", "undecodable", "system", "undecodable", "undecodable", "undecodable", "undecodable", "undecodable", "system"]
    assert framing.split_packet(bytes.fromhex("903CE0F4903C64")) == [bytes.fromhex("903CE0"), bytes.fromhex("F4903C64")]


def test_incipits_in_groups_and_bars():
    assert scores.incipit("8'(CDE)4F") == ([60, 62, 64, 65], [0.0, 0.33333, 0.66667, 1.0])
    assert scores.incipit("4xC''C/C") [0] == [61, 73, 72]
    assert scores.incipit("4'gDC+C-E") == ([62, 60, 64], [0.0, 0.0, 3.0])
    assert scores.incipit("8(5'CDEFG)4A")[1][-1] == 1.0
