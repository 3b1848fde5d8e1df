import pytest

from wordloom.llm import pii

NAMES = [("Wendy", "given"), ("Götz", "given"), ("Holdock", "family"), ("Belmosley", "family"), ("Marreau", "family"), ("Zelarojo", "family")]


@pytest.fixture(scope="module")
def spotter():
    return pii.Spotter(pii.Names.learn(NAMES))


CASES = {
    "write to ann.lee+x@lab.site.example.": [("email", "ann.lee+x@lab.site.example")],
    "<mailto:A_B@EXAMPLE.ORG>": [("email", "A_B@EXAMPLE.ORG")],
    "contact=zoe_k [at] site[dot]test now": [("email", "zoe_k [at] site[dot]test")],
    "E: max at mail (dot) site (dot) example": [("email", "max at mail (dot) site (dot) example")],
    "See pkg@1.2.3 and @who/vectors#4, look at it": [],
    "Tel. +44 (0)1632 960045": [("phone", "+44 (0)1632 960045")],
    "☎ 1 (212) 555 0196": [("phone", "1 (212) 555 0196")],
    "My desk phone is 808.555.0124.": [("phone", "808.555.0124")],
    "0221/4710962": [("phone", "0221/4710962")],
    "T: +33 1 99 00 66 53 1234567890": [("phone", "+33 1 99 00 66 53")],
    "Passport QQ979264C 1234567890": [("idnum", "QQ979264C")],
    "It has 1 234 567 rows, 910 362 453 types, 0.123456 loss at 2023-04-05": [],
    "teléfono en la línea 2185966": [],
    "Passport QQ979264C was used": [("idnum", "QQ979264C")],
    "tax ID 666-53-9901 is on the invoice": [("idnum", "666-53-9901")],
    "carte d'identité 2.54.18.41.677.042.": [("idnum", "2.54.18.41.677.042")],
    "Id 064cb27064cb27 is the hash": [],
    "Office: 12-14 Old Mill Road": [("address", "12-14 Old Mill Road")],
    "Anschrift: An der Eiche 43 b": [("address", "An der Eiche 43 b")],
    "Adresse : 51 bis, bd Saint-Orlan": [("address", "51 bis, bd Saint-Orlan")],
    "(Plaza de los Hornos, n.º 149, 25585 Villaorbe)": [("address", "Plaza de los Hornos, n.º 149")],
    "3 Hidden Hollow\n12345 Townsend": [("address", "3 Hidden Hollow")],
    "Thanks to Wendy Holdock for it": [("person", "Wendy Holdock")],
    "Reviewed-by: HOLDOCK Wendy": [("person", "HOLDOCK Wendy")],
    "Name: Belmosley, Götz": [("person", "Belmosley, Götz")],
    "Wendy R. van der Holdock": [("person", "Wendy R. van der Holdock")],
    "Dr. Belmosley signed": [("person", "Belmosley")],
    "R. Marreau": [("person", "R. Marreau")],
    "Ask Iseult Belmosley about it": [("person", "Iseult Belmosley")],
    "Wendy.Holdock@site.example": [("email", "Wendy.Holdock@site.example")],
    "The Orchard Corpus has 9 shards": [],
}


@pytest.mark.parametrize("text", CASES)
def test_boundaries(spotter, text):
    assert [(k, text[s:e]) for s, e, k in spotter.find(text)] == CASES[text]


def test_masking_changes_nothing_else(spotter):
    text = "Hi,\nask Wendy Holdock <w@site.example>\r\nTel. 0121-496-0466 …"
    assert spotter.mask(text) == "Hi,\nask <PERSON> <<EMAIL>>\r\nTel. <PHONE> …"


def test_query_shape_nulls_and_repeats(spark):
    texts = [(1, "a@b.example a@b.example"), (2, None), (3, ""), (4, "x " * 300_000 + "c@d.test"), (1, "a@b.example")]
    df = spark.createDataFrame([(*r, "k") for r in texts], "doc_id long, text string, kind string")
    names = spark.createDataFrame([(*n, "en") for n in [*NAMES, (None, "given")]], "name string, kind string, lang string")
    got = sorted(tuple(r) for r in pii.find_personal_data(df, names).collect())
    assert got == [(1, "email", "a@b.example")] * 2 + [(4, "email", "c@d.test")]
    masked = {r[0]: r[1] for r in pii.mask_personal_data(df.where("doc_id > 1"), names.limit(0)).collect()}
    assert masked[2] is None and masked[3] == "" and masked[4].endswith("x <EMAIL>")
    assert pii.find_personal_data(df.limit(0), names).count() == 0


@pytest.mark.parametrize(
    "text, address",
    [
        ("We are at 11 Hollow Bridge now", "11 Hollow Bridge"),
        ("Office: 35 Hollow Bridge", "35 Hollow Bridge"),
        ("visit us (72 Hollow Bridge, 18513 Hollowmere)", "72 Hollow Bridge"),
        ("ours is 72 Hollow Bridge, 18513 Hollowmere", "72 Hollow Bridge"),
        ("Office: 5B Upper Fen Close It works", "5B Upper Fen Close"),
        ("go to 12 Old Mill Ln", "12 Old Mill Ln"),
        ("bei Lindenhof 12", "Lindenhof 12"),
        ("le 5 ruelle des Lilas", "5 ruelle des Lilas"),
        ("en Rambla de Flores 14", "Rambla de Flores 14"),
    ],
)
def test_addresses_within_a_line(spotter, text, address):
    assert [(k, text[s:e]) for s, e, k in spotter.find(text)] == [("address", address)]
