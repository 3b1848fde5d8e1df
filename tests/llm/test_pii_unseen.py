"""Texts outside the test tables: ordinary personal data in four languages, and
figures and names that are none.  Recall and precision over all are asserted."""

import pytest

from wordloom.llm import pii

P, T, I, A, E = "person", "phone", "idnum", "address", "email"
CASES = [
    # English
    ("My name is Jane Okonkwo.", [(P, "Jane Okonkwo")]),
    ("Contact Maria Lindqvist at the desk", [(P, "Maria Lindqvist")]),
    ("signed, Tomasz Wojciechowski", [(P, "Tomasz Wojciechowski")]),
    ("She lives at 12 Highfield Rise", [(A, "12 Highfield Rise")]),
    ("45 Oakwood Circle", [(A, "45 Oakwood Circle")]),
    ("reach me on 020 7946 0958", [(T, "020 7946 0958")]),
    ("my number: 555-867-5309", [(T, "555-867-5309")]),
    ("Aadhaar 4991 1866 5246", [(I, "4991 1866 5246")]),
    ("his tax no. 12-3456789 is here", [(I, "12-3456789")]),
    ("Mark Twain wrote it", [(P, "Mark Twain")]),
    ("I am Priya Raghavan from billing", [(P, "Priya Raghavan")]),
    ("Yesterday Chidi Anagonye said no", [(P, "Chidi Anagonye")]),
    ("Sarah Whitcombe will call back", [(P, "Sarah Whitcombe")]),
    ("Please tell Robert J. Halloran", [(P, "Robert J. Halloran")]),
    ("Mr Abernathy left", [(P, "Abernathy")]),
    ("Dr. Nkemelu is out", [(P, "Nkemelu")]),
    ("call me: (415) 555-2671", [(T, "(415) 555-2671")]),
    ("office 212-555-0143 ext", [(T, "212-555-0143")]),
    ("fax 312.555.0177", [(T, "312.555.0177")]),
    ("+1 650 555 0199 works", [(T, "+1 650 555 0199")]),
    ("+44 20 7946 0321", [(T, "+44 20 7946 0321")]),
    ("ring 0161 496 0752 after six", [(T, "0161 496 0752")]),
    ("SSN 536-22-8145", [(I, "536-22-8145")]),
    ("my social is 219-09-9999 ok", [(I, "219-09-9999")]),
    ("National Insurance QQ 12 34 56 C", [(I, "QQ 12 34 56 C")]),
    ("it was AB123456C on file", [(I, "AB123456C")]),
    ("passport number 533380006", [(I, "533380006")]),
    ("send to j.smith+news@mail.example.org", [(E, "j.smith+news@mail.example.org")]),
    ("write jane (at) corp (dot) example", [(E, "jane (at) corp (dot) example")]),
    ("x" * 120 + "@long.example", [(E, "x" * 120 + "@long.example")]),
    ("221B Baker Street", [(A, "221B Baker Street")]),
    ("moved to 9 Elm Grove last week", [(A, "9 Elm Grove")]),
    ("at 1600 Pennsylvania Ave today", [(A, "1600 Pennsylvania Ave")]),
    ("77 Sunset Blvd.", [(A, "77 Sunset Blvd.")]),
    ("ship to 8 Cedar Parkway", [(A, "8 Cedar Parkway")]),
    ("in 31 Harbour Esplanade now", [(A, "31 Harbour Esplanade")]),
    ("deliver to 14 Larch Cottages", [(A, "14 Larch Cottages")]),
    # German
    ("Lindenbühl 7", [(A, "Lindenbühl 7")]),
    ("Wohnhaft Goethestraße 15a", [(A, "Goethestraße 15a")]),
    ("in der Kirchgasse 3", [(A, "Kirchgasse 3")]),
    ("Am Alten Hafen 22", [(A, "Am Alten Hafen 22")]),
    ("jetzt Eichenhain 4", [(A, "Eichenhain 4")]),
    ("Berliner Allee 120", [(A, "Berliner Allee 120")]),
    ("Ich heiße Annegret Wollschläger", [(P, "Annegret Wollschläger")]),
    ("Mein Name ist Ayşe Demir", [(P, "Ayşe Demir")]),
    ("Ansprechpartner: Jörg Petersen", [(P, "Jörg Petersen")]),
    ("Herr Kowalczyk kommt", [(P, "Kowalczyk")]),
    ("Frau Dr. Steinbrück kommt", [(P, "Steinbrück")]),
    ("Klaus Hinrichsen schrieb gestern", [(P, "Klaus Hinrichsen")]),
    ("gez. Hannelore Vogt", [(P, "Hannelore Vogt")]),
    ("Tel. 030 901820", [(T, "030 901820")]),
    ("Rückruf 0171/2345678", [(T, "0171/2345678")]),
    ("Mobil 0151 23456789", [(T, "0151 23456789")]),
    ("oder 0221/4710-962 tagsüber", [(T, "0221/4710-962")]),
    ("+49 89 636-48018", [(T, "+49 89 636-48018")]),
    ("Steuer-ID 86 095 742 719", [(I, "86 095 742 719")]),
    ("Steuernummer 93/815/08152", [(I, "93/815/08152")]),
    ("Personalausweis L01X00T471", [(I, "L01X00T471")]),
    ("Reisepass C01X0006H", [(I, "C01X0006H")]),
    ("Mail an petra.k@firma.example", [(E, "petra.k@firma.example")]),
    # French
    ("Je m'appelle Amélie Rousselin", [(P, "Amélie Rousselin")]),
    ("Je suis Moussa Diallo", [(P, "Moussa Diallo")]),
    ("signé Laurent Perrichon", [(P, "Laurent Perrichon")]),
    ("Sophie Delacourt a écrit hier", [(P, "Sophie Delacourt")]),
    ("Mme Beaulieu est là", [(P, "Beaulieu")]),
    ("M. Kerbrat a signé", [(P, "Kerbrat")]),
    ("12 rue de la Paix", [(A, "12 rue de la Paix")]),
    ("au 5 bis, avenue Foch", [(A, "5 bis, avenue Foch")]),
    ("48 boulevard Voltaire", [(A, "48 boulevard Voltaire")]),
    ("7 impasse des Lilas", [(A, "7 impasse des Lilas")]),
    ("joignable au 06 12 34 56 78", [(T, "06 12 34 56 78")]),
    ("sinon 01.42.68.53.00 le soir", [(T, "01.42.68.53.00")]),
    ("+33 6 45 23 89 10", [(T, "+33 6 45 23 89 10")]),
    ("sécurité sociale 2 55 08 14 168 025 38", [(I, "2 55 08 14 168 025 38")]),
    ("Passeport 12AB34567", [(I, "12AB34567")]),
    ("numéro fiscal 30 23 217 600 053", [(I, "30 23 217 600 053")]),
    ("lucie.m arobase poste.example", [(E, "lucie.m arobase poste.example")]),
    # Spanish
    ("Me llamo Lucía Fernández", [(P, "Lucía Fernández")]),
    ("Mi nombre es Iker Zubizarreta", [(P, "Iker Zubizarreta")]),
    ("firmado Rosario Benítez", [(P, "Rosario Benítez")]),
    ("Carlos Ibarra escribió ayer", [(P, "Carlos Ibarra")]),
    ("el señor Aristegui viene", [(P, "Aristegui")]),
    ("Sra. Montenegro llama", [(P, "Montenegro")]),
    ("Calle Mayor 23", [(A, "Calle Mayor 23")]),
    ("Avenida de la Constitución, 8", [(A, "Avenida de la Constitución, 8")]),
    ("vivo en Plaza Nueva 4", [(A, "Plaza Nueva 4")]),
    ("Paseo del Prado 36", [(A, "Paseo del Prado 36")]),
    ("móvil 612 345 678", [(T, "612 345 678")]),
    ("Teléfono: 91 411 25 40", [(T, "91 411 25 40")]),
    ("+34 915 55 12 34", [(T, "+34 915 55 12 34")]),
    ("DNI 12345678Z", [(I, "12345678Z")]),
    ("consta 12345678Z en acta", [(I, "12345678Z")]),
    ("NIE X1234567L", [(I, "X1234567L")]),
    ("Pasaporte XDB123456", [(I, "XDB123456")]),
    ("ana arroba correo.example", [(E, "ana arroba correo.example")]),
    # several kinds at once
    ("Jane Okonkwo, 12 Highfield Rise, 020 7946 0958", [(P, "Jane Okonkwo"), (A, "12 Highfield Rise"), (T, "020 7946 0958")]),
    ("Peter Sandgren <p.sandgren@x.example>", [(P, "Peter Sandgren"), (E, "p.sandgren@x.example")]),
    ("Eva Mattsson\nTel. +46 8 123 456 78", [(P, "Eva Mattsson"), (T, "+46 8 123 456 78")]),
    # nothing
    ("IBAN DE89 3704 0044 0532 0130 00", []),
    ("12 Green Park units were sold", []),
    ("The Orchard Corpus has 9 shards", []),
    ("Table 3 shows 1 234 567 rows", []),
    ("loss 0.123456 at step 1000000", []),
    ("version 2.10.3 of 2024-05-17", []),
    ("order 4711-0815-2342 shipped", []),
    ("New York Times reported it", []),
    ("see section 12 Data Model", []),
    ("12345678A is no valid letter", []),
    ("ratio 16:9 and 1920x1080", []),
    ("United Nations said so in Geneva", []),
    ("Kapitel 7 der Studie", []),
    ("Artikel 12 Absatz 3", []),
    ("page 45, line 12", []),
    ("Monte Carlo Methods", []),
    ("@user look at #4567", []),
    ("el 12 de Mayo de 2023", []),
    ("les 35 heures", []),
    ("ISBN 978-3-16-148410-0", []),
    ("May January be cold", []),
    ("Python 3 and Java 21", []),
]


@pytest.fixture(scope="module")
def spotter():
    return pii.Spotter(pii.Names.learn([("Wendy", "given"), ("Holdock", "family"), ("Belmosley", "family")]))


def test_recall_and_precision_on_unseen_texts(spotter):
    hit = missed = wrong = 0
    said = []
    for text, want in CASES:
        got = {(k, text[s:e]) for s, e, k in spotter.find(text)}
        hit, missed, wrong = hit + len(got & set(want)), missed + len(set(want) - got), wrong + len(got - set(want))
        if got != set(want):
            said.append((text[:60], sorted(got - set(want)), sorted(set(want) - got)))
    recall, precision = hit / (hit + missed), hit / (hit + wrong)
    print(f"{len(CASES)} texts, recall {recall:.3f}, precision {precision:.3f}", *said, sep="\n")
    assert recall >= 0.95 and precision >= 0.95, said
