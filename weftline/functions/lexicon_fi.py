"""Fixed values of the Finnish normalizer: word lists and tables."""

from __future__ import annotations

# fixed values: abbreviations as spoken
ABBREVIATIONS = {
    "yms.": "ynnä muuta sellaista", "tms.": "tai muuta sellaista", "jne.": "ja niin edelleen", "vrt.": "vertaa", "huom.": "huomaa",
    "esim.": "esimerkiksi", "ts.": "toisin sanoen", "ks.": "katso", "ym.": "ynnä muuta", "mm.": "muun muassa", "nk.": "niin kutsuttu",
    "ns.": "niin sanottu", "ko.": "kyseinen", "ao.": "asianomainen", "ed.": "edellinen", "eKr.": "ennen Kristusta", "jKr.": "jälkeen Kristuksen",
    "eaa.": "ennen ajanlaskun alkua", "jaa.": "jälkeen ajanlaskun alun", "prof.": "professori", "dos.": "dosentti", "fil.": "filosofian",
    "maist.": "maisteri", "kand.": "kandidaatti", "toim.": "toimittaja", "kpl.": "kappaletta", "milj.": "miljoonaa", "mrd.": "miljardia",
    "n.": "noin", "v.": "vuonna", "kk.": "kuukautta", "klo.": "kello", "pvm.": "päivämäärä", "nim.": "nimittäin", "ml.": "mukaanlukien",
    "pl.": "paitsi", "tark.": "tarkoittaa", "tav.": "tavallisesti", "lyh.": "lyhennys",
}

# fixed values: acronyms as spoken
ACRONYMS = {
    "EU": "Euroopan unioni", "EY": "Euroopan yhteisö", "EEC": "Euroopan talousyhteisö", "YK": "Yhdistyneet kansakunnat", "USA": "Yhdysvallat",
    "NATO": "Nato", "UNESCO": "Unesco", "WTO": "W T O", "ILO": "I L O", "UN": "U N", "ALR": "A L R", "ABGB": "A B G B", "BGB": "B G B",
    "HGB": "H G B", "StGB": "St G B", "StPO": "St P O", "ZPO": "Z P O", "RL": "R L", "SL": "S L", "PDF": "P D F", "URL": "U R L", "API": "A P I",
}

# fixed values: short words that are no acronyms
NOT_ACRONYMS = frozenset("JA JO ON OS SE EI EN JOS KUN NYT MUT TAI MIT NIN".split())

# fixed values: units in the order in which they are tried
UNITS = [
    ("°C", "celsiusastetta"), ("°F", "fahrenheitastetta"), ("km", "kilometriä"), ("cm", "senttimetriä"), ("mm", "millimetriä"), ("m", "metriä"),
    ("kg", "kilogrammaa"), ("mg", "milligrammaa"), ("g", "grammaa"), ("t", "tonnia"), ("ml", "millilitraa"), ("dl", "desilitraa"),
    ("cl", "senttilitraa"), ("l", "litraa"), ("min", "minuuttia"), ("€", "euroa"), ("£", "puntaa"), ("%", "prosenttia"), ("‰", "promillea"),
    ("mk", "markkaa"),
]

# fixed values: words after a century
CENTURY_SUFFIXES = tuple(
    """
    luvulla luvulta luvulle luvuilla luvusta luvut luvun luku
    """.split()
)

# fixed values: words before a number, and the case they ask for
BEFORE = {
    "vuonna": "nominative", "vuoden": "nominative", "vuodelta": "ablative", "vuoteen": "illative", "vuodesta": "elative", "vuosina": "essive",
    "sivu": "nominative", "sivut": "nominative", "sivulla": "adessive", "sivulta": "ablative", "sivulle": "allative", "sivusta": "elative",
    "sivuun": "illative", "sivuilla": "adessive", "sivuilta": "ablative", "sivuille": "allative", "sivuista": "elative", "sivuihin": "illative",
    "luku": "nominative", "luvussa": "inessive", "lukuun": "illative", "luvun": "genitive", "luvusta": "elative", "luvulla": "adessive",
    "pykälä": "nominative", "pykälässä": "inessive", "pykälästä": "elative", "pykälään": "illative", "kappale": "nominative",
    "kappaleessa": "inessive", "kappaleesta": "elative", "osa": "nominative", "osassa": "inessive", "osasta": "elative", "kohta": "nominative",
    "kohdassa": "inessive", "kohdasta": "elative", "kohtaan": "illative", "kohdalla": "adessive", "rivi": "nominative", "rivillä": "adessive",
    "riviltä": "ablative", "riville": "allative", "riveillä": "adessive", "riveiltä": "ablative", "riveille": "allative", "klo": "nominative",
    "kello": "nominative",
}

# fixed values: words after a number, all of which ask for the nominative
AFTER = dict.fromkeys(
    """
    prosenttia prosentin promillea kertaa kerran kappaletta kpl vuotta kuukautta viikkoa päivää tuntia minuuttia sekuntia metriä kilometriä
    senttiä senttimetriä millimetriä grammaa kiloa kilogrammaa euroa markkaa milligrammaa millilitraa desilitraa senttilitraa litraa tonnia
    celsiusastetta fahrenheitastetta dollaria puntaa miljoonaa miljardia
    """.split(),
    "nominative",
)

# fixed values: words for year
YEAR_WORDS = frozenset(
    """
    vuonna vuoden vuodelta vuoteen vuodesta vuosina
    """.split()
)

# fixed values: acronyms that look like Roman numerals
ROMAN_NOT = frozenset(
    """
    DC LCD MVP CV CI MD ID
    """.split()
)

# fixed values: names of rulers
REGNAL = frozenset(
    """
    Kustaa Kaarle Juhana Eerik Henrik Pius Leo Aleksanteri Nikolai Katariina Elisabet Yrjö Fredrik Adolf Oskar Erik
    """.split()
)

# fixed values: titles of rulers
TITLES = frozenset(
    """
    paavi Paavi kuningas Kuningas keisari Keisari tsaari Tsaari sulttaani Sulttaani
    """.split()
)

# fixed values: words before an ordinal numeral
ORDINAL_BEFORE = frozenset(
    """
    luku Luku luvussa luvun pykälä Pykälä pykälässä kohta kohdassa
    """.split()
)

# fixed values: words after an ordinal numeral
ORDINAL_AFTER = frozenset(
    """
    vuosisata vuosisadalla vuosisadalta vuosisatana luku luvulla luvulta luvussa luvun kappale kappaleessa kappaletta
    """.split()
)

# fixed values: stems before -ismi
ISMI_STEMS = frozenset(
    """
    absolut aktiv anabapt dogmat empir feodal formal gallikan histor human ideal imperial individual jansen kalvin kapital kolonial konsensual
    konsiliar liberal lutheran material mekan merkantil modern national natural nominal oikeusplural oikeuspositiv pap pasif paternal piet
    plural positiv protestant rational real republikan sosial utilitar
    """.split()
)

# fixed values: stems before -tio
TIO_STEMS = frozenset(
    """
    ac administraa auktorisaa conduc constitu delegaa evaluaa federaa fik fundaa funk graduaa harmonisaa inkorporaa innovaa instituu instruk
    interpretaa justifikaa kausaa klassifikaa kodifikaa kollaboraa kommunikaa kompensaa konfirmaa konstituu legitimaa loca modernisaa modifikaa
    negaa observaa operaa organisaa posi preskrip produk publikaa ratifikaa regulaa relaa renovaa representaa resep restrik sank separaa
    sertifikaa simulaa spesifikaa stipula transak
    """.split()
)

# fixed values: Latin phrases as spoken
LATIN = {
    "ius commune": "jus kommune", "ius proprium": "jus proprium", "ius publicum": "jus publikkum", "ius gentium": "jus gentium",
    "ius naturale": "jus naturale", "ius civile": "jus siviilë", "corpus iuris": "korpus juuris",
    "corpus iuris civilis": "korpus juuris siviilis", "usus modernus pandectarum": "uusus modernus pandektarum",
    "usus modernus": "uusus modernus", "ratio scripta": "ratsio skripta", "modus vivendi": "modus vivendi",
    "iuris prudentia": "juuris prudentsia", "iurisprudentia": "juurisprudentsia", "lex mercatoria": "leks merkatorria",
    "lex naturalis": "leks naturalis", "lex specialis": "leks spetsiiaalis", "lex generalis": "leks generalis", "bona fides": "bona fides",
    "culpa in contrahendo": "kulpa in kontrahendo", "pacta sunt servanda": "pakta sunt servanda", "rebus sic stantibus": "reebus sik stantibus",
    "ex nunc": "eks nunk", "ex tunc": "eks tunk", "ex lege": "eks leege", "de iure": "de juure", "de facto": "de fakto", "in dubio": "in duubio",
    "mutatis mutandis": "mutaatis mutandis",
}

# fixed values: foreign names as spoken
NAMES = {
    "Wittenberg": "Vittenberg", "Reichskammergericht": "Raihskammergeriht", "Rechtsgeschichte": "Rehtsgeshihte",
    "Gerichtsordnung": "Gerihtsorndung", "Landrecht": "Landreht", "Allgemeines Landrecht": "Allgemaaines Landreht", "Reichsrecht": "Raihsreht",
    "München": "Mynhen", "Nürnberg": "Nyrnberg", "Heidelberg": "Haidellberg", "Leipzig": "Laiptsig", "Zürich": "Syyrih",
    "Strasbourg": "Strasburg", "Leiden": "Leiden", "Savigny": "Saviinji", "Thomasius": "Toomasius", "Wolff": "Volf", "Leibniz": "Laibnits",
    "Hegel": "Heegel", "Pufendorf": "Puufendorf", "Grotius": "Grootiuss",
}

# fixed values: months in the partitive
MONTHS = tuple(
    """
    tammikuuta helmikuuta maaliskuuta huhtikuuta toukokuuta kesäkuuta heinäkuuta elokuuta syyskuuta lokakuuta marraskuuta joulukuuta
    """.split()
)

# fixed values: forms of hundred and ten, the partitive before the illative
MORPHEME_STEMS = tuple(
    """
    sataa kymmentä sadan kymmenen sadassa kymmenessä sadasta kymmenestä sadalla kymmenellä sadalta kymmeneltä sadalle kymmenelle satana
    kymmenenä sadaksi kymmeneksi satoja sataan kymmeneen
    """.split()
)

# fixed values: how a digit begins within a compound
DIGIT_PREFIXES = tuple(
    """
    yks yhd yht kak kah kol nel vii kuu sei kym
    """.split()
)
